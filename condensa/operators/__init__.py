"""Dataset operators: each takes and returns DataFrames."""
