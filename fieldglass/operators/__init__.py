"""Operators over DataFrames: first and last rows of a key, merges, overlaps, groups of names, traversals."""
