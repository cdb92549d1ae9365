"""Matched-context analytics on Spark DataFrames."""
