"""The catalogue of queries, and SQL that gives the same rows."""

from __future__ import annotations

from landreach.plans import core_queries, geo_queries, geo_sql, source_queries

PARTS = (core_queries, geo_queries, source_queries)


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in (core_queries, geo_sql, source_queries) for k, s in part.oracle_sql().items()}
