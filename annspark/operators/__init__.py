"""Search, index, classification and evaluation operators (all lazy DataFrames)."""
