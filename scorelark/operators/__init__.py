"""Relational operators of the catalog: DataFrames in, DataFrames out."""
