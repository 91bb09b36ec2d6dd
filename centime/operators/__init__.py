"""Relational and grouped operators; each maps DataFrames to a DataFrame."""
