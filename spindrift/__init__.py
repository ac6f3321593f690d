"""Sparse graph and linear-algebra analytics on Spark DataFrames."""
