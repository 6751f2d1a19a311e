"""Playlist, similarity and graph analytics on Spark DataFrames."""
