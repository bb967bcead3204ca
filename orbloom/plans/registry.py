"""Queries over the driver tables and the SQL that states their results."""

from __future__ import annotations

from orbloom.plans import base, chain_queries, coefficient_queries, field_queries, sequential_queries, series_queries

MODULES = (coefficient_queries, series_queries, field_queries, sequential_queries, chain_queries)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
