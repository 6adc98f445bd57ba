"""Operators for preparing training corpora, each one a function from DataFrames to DataFrames."""
