"""Operators that a statement alone does not express well in Spark."""
