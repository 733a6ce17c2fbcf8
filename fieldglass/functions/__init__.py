"""Scalar functions over columns; all are built from Spark's own expressions."""
