"""Registry of queries and of the SQL each is compared with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}

AS_OF = "2025-01-01"  # the day every age, tenure and fill is computed for


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its comparison SQL."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
