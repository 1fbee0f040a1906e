"""Corpus curation and learning analytics as functions from DataFrames to DataFrames."""
