"""Where query modules enter their queries and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def also(name: str, known: str) -> None:
    """Register a known query under a second name."""
    QUERIES[name] = QUERIES[known]
    SQL[name] = SQL[known]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; `sql` is its DuckDB form, if SQL can express it."""

    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return enter
