"""Lodestar: a strictly typed SQL dialect and analytics engine that compiles to Spark DataFrames."""
