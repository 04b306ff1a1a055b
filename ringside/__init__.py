"""Granular combat-sports analytics on Spark DataFrames."""
