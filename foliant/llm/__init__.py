"""Operators of a training-data pipeline, each a plain function from DataFrames to DataFrames."""
