"""Threat-feed analytics on Spark DataFrames."""
