"""Observation analytics on Spark DataFrames."""
