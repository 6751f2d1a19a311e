"""Operators of the playlist engine: DataFrames in, DataFrames out."""
