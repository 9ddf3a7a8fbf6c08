"""Operators: each takes DataFrames and returns a lazy DataFrame."""
