"""Relational operators as compositions of DataFrame operations."""
