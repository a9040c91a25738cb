"""Registry of the library's own queries: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def load() -> None:
    """Imports every module that registers queries."""
    from .plans import eval_queries, layout_queries, note_queries, source_queries, tensor_queries, text_queries, tool_queries  # noqa: F401


load()
