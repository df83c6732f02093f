"""All queries over the given tables, and the same in SQL for another engine."""

from __future__ import annotations

from .plans import book_queries, report_queries, run_queries, simulation_queries, source_queries

_ALL = book_queries.QUERIES | run_queries.QUERIES | simulation_queries.QUERIES | source_queries.QUERIES | report_queries.QUERIES
QUERIES = {name: f for name, (f, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
