"""All log-analytics queries and their SQL."""

from __future__ import annotations

from . import line_queries, search_queries, table_queries

ALL = line_queries.QUERIES | search_queries.QUERIES | table_queries.QUERIES
QUERIES = {name: fn for name, (fn, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items() if sql}
