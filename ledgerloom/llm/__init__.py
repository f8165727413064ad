"""Operators for training-data pipelines: filtering, deduplication, mixing, sharding, scoring, encoding.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames and has
its contract (nulls, empty texts, ties, repeated rows) in its docstring.
"""
