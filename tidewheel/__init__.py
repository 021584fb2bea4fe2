"""Rhythm analytics on Spark DataFrames."""
