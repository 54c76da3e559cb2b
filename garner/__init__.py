"""Garner: personal-archive analytics on Spark DataFrames."""
