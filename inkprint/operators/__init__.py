"""Dataset-level transformations. Every function takes and returns DataFrames."""
