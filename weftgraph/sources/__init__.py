"""Graphs over DataFrames, and where they come from."""
