"""Streams of rows met with a graph."""
