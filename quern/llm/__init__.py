"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames (or adds one column), keeps all rows, and carries the texts it was
given unchanged.
"""
