"""Operators: each takes DataFrames (of many queries at once) and returns a DataFrame keyed by ``query_id``."""
