"""Operators of a training-data pipeline: one module per operator.

Every operator takes DataFrames and column names and returns a DataFrame; the
registered queries (``queries.py``) derive their digest columns from operator
output. Nothing outside this package imports it.
"""
