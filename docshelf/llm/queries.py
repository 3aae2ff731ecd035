"""The registered queries of this subpackage: thin, over whole tables, with the production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the query modules (registration happens on import)."""
    from . import q_conversations, q_dedup, q_packing, q_pages, q_text, q_vectors  # noqa: F401
