"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries`` holds the thin registered queries and
``oracles`` the SQL that states the same results where SQL can.
"""
