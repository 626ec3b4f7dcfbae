"""Operators: each takes and returns lazy DataFrames."""
