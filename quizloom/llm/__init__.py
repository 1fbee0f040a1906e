"""Operators of a training-data pipeline, each a function from DataFrames to DataFrames.

Nothing outside this subpackage imports it; ``queries.py`` registers one query per operator.
"""
