"""Operators that a large-scale training-data pipeline needs.

Nothing outside this folder imports it.  Every operator is a function from DataFrames to a
DataFrame; `queries.py` holds the thin registered queries and their SQL.
"""
