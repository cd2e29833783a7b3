"""Stages of molecule-level deduplication, each a function from DataFrames to a DataFrame."""
