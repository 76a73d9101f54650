"""Where the queries and their oracles are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.sql import expand

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when it has one, its equivalent SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = expand(sql)
        return f

    return add
