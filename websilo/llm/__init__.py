"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; queries with fixed result columns are in ``queries``.
"""
