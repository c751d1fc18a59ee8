"""The named queries of this subpackage, with their checking SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ["text_queries", "vector_queries", "corpus_queries", "mining_queries"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def register(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"rainloom.llm.{module}")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
