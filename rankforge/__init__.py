"""Pairwise comparison, judging and ranking analytics on Spark DataFrames."""
