"""Queries by name, each with its SQL where DuckDB can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators.keeping import release

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL. What an earlier query persisted is released before it runs."""

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release(spark)
            return f(spark, sf_dir)

        FOUND[f.__name__] = run, sql
        return f

    return add
