"""Operators of a training-data pipeline, each a function from DataFrames to a DataFrame.

Nothing outside this subpackage imports it, so that it can be taken away whole.
"""
