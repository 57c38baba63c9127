"""Bitmap-index analytics on Spark DataFrames."""
