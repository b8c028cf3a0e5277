"""Allele-count analytics on Spark DataFrames."""
