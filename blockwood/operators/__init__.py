"""Trees, blocks and matrices as DataFrames."""
