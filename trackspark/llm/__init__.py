"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the thin production queries over the tables.
"""
