"""Pipelines of pattern steps over a graph."""
