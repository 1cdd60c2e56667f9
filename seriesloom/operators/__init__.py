"""Operators: each takes DataFrames and column names and returns a DataFrame; nothing is collected but bounds, folds and metrics."""
