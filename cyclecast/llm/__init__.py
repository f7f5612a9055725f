"""Operators for large text and vector corpora, each on plain DataFrames."""
