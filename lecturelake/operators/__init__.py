"""Operators: each takes DataFrames and returns DataFrames; "now" and settings are parameters."""
