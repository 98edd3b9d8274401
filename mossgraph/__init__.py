"""Corpus search, link graph, change log and training-data operators on Spark DataFrames."""
