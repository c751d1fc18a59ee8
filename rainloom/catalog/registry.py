from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = [
    "ingest", "feature_sets", "profiles", "matching", "scores", "ensembles", "splits", "tables", "models", "streams",
]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its checking SQL if there is one."""
    def register(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return register


def _load() -> None:
    import importlib.util
    for module in _MODULES:
        if importlib.util.find_spec(f"rainloom.catalog.{module}"):
            import_module(f"rainloom.catalog.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
