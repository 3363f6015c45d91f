"""Where queries over the test tables and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        if f.__name__ in QUERIES:
            raise ValueError(f"there are two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
