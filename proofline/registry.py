"""Registered queries and their SQL."""

from .plans import cases, layout_oracle, more_oracle, oracle, queries, review_oracle

QUERIES = queries.QUERIES
SQL = oracle.SQL | review_oracle.SQL | cases.SQL | layout_oracle.SQL | more_oracle.SQL

__all__ = ["QUERIES", "SQL"]
