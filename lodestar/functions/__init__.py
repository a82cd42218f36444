"""Scalar building blocks that Spark's own functions don't give as they are."""
