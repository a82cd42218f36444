"""Syntax trees to plans: names and types are settled here, and each plan node knows its DataFrame."""
