"""Registry of named queries: a Spark plan and, where SQL can say it, a DuckDB oracle.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the driver
tables (or data Spark derives from them). Column names and types are the
same on both sides: counts are BIGINT, measures DOUBLE rounded as stated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query; ``sql`` may be a string or a zero-argument builder."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql() if callable(sql) else sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module (registration happens on import)."""
    from . import (  # noqa: F401
        q_classify, q_dedup_text, q_history, q_plan, q_search, q_sources, q_stream, q_taxonomy,
    )
