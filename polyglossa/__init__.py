"""Parallel-corpus and document analytics on Spark DataFrames."""
