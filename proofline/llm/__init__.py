"""Operators for training-data pipelines on Spark DataFrames.

One module per operator; ``entries`` holds the registered queries and their
SQL. Nothing outside this subpackage imports it.
"""
