"""Batch search, scoring and recommendation over product catalogs, on Spark DataFrames."""
