"""Sequence and similarity-graph analytics on Spark DataFrames."""
