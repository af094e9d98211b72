"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL twin."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = in_utc
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from . import run_queries, scalar_queries, stream_queries, table_queries  # noqa: F401
