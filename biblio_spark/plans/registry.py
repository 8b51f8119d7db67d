"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, also: str | None = None):
    """Register a function (spark, sf_dir) under ``name``, with SQL that gives the same rows if there is any. ``also``: a further
    name under which it was known."""

    def register(function):
        for own in (name, also):
            if own in QUERIES:
                raise ValueError(f"{own} is registered twice")
            if own:
                QUERIES[own] = function
            if own and sql:
                ORACLE_SQL[own] = sql
        return function

    return register


def load() -> None:
    """Import the modules that register queries."""
    from biblio_spark.plans import catalog_queries, record_queries  # noqa: F401
