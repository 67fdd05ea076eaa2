"""What pattern steps do to DataFrames."""
