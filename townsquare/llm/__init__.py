"""Operators for training corpora of language models.

Each is a function of DataFrames. ``plans`` binds them to the sample tables;
nothing outside this package imports it.
"""
