"""Ranked retrieval over document collections, on Spark DataFrames."""
