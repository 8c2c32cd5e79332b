"""Queries by name, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql
        return f

    return add
