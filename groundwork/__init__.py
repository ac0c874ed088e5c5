"""Groundwork: evidence retrieval and answer measurement on Spark DataFrames."""
