"""Named queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) function under name, with its oracle."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load() -> None:
    """Import all modules that register queries."""
    from ordwell.plans import dedup_queries, kernel_queries, pixel_queries, row_queries, stat_queries, state_queries, stream_queries  # noqa: F401


load()
