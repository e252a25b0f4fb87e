"""Registry of the core queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from threadloom.plans import aggregate, corpus, features, io, metrics, pipelines, trees

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
for _plan in (trees, corpus, aggregate, features, metrics, pipelines, io):
    QUERIES.update(_plan.QUERIES)
    ORACLE_SQL.update(_plan.ORACLE_SQL)
