"""Name -> (Spark query, SQL twin). A twin names the derived tables it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None, uses: str = "", recursive: bool = False):
    """Register a query. ``sql`` is the twin's last part: CTEs after ``uses``, then a select."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = derived.with_clause(uses.split(), sql, recursive)
        return fn

    return wrap
