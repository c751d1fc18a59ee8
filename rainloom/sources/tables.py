"""Tables, SQL queries and small typed row sets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.functions.timeparts import as_of_or_now


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def from_sql(spark: SparkSession, text: str, args: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """A parametrised SQL query over the given frames."""
    return spark.sql(text, args=args or {}, **tables) if tables else spark.sql(text, args=args or {})


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every one of the columns present."""
    return df.dropna(subset=columns)


def up_to(df: DataFrame, time_col: str, as_of: Column | None = None, zone: str = "America/Sao_Paulo") -> DataFrame:
    """Rows not later than the as-of moment (default: the present local time)."""
    return df.where(F.col(time_col) <= as_of_or_now(as_of, zone))


def since(df: DataFrame, time_col: str, as_of: Column, lookback: str) -> DataFrame:
    """Rows later than ``as_of`` minus an interval such as ``'48 HOURS'``."""
    return df.where(F.col(time_col) > as_of - F.expr(f"INTERVAL {lookback}"))


def horizon(df: DataFrame, time_col: str, start: Column, length_hours: int, closed: str = "left") -> DataFrame:
    """``[start, start+n)`` for closed='left', ``(start, start+n]`` for closed='right'."""
    t, stop = F.col(time_col), start + F.expr(f"INTERVAL {int(length_hours)} HOURS")
    return df.where((t >= start) & (t < stop)) if closed == "left" else df.where((t > start) & (t <= stop))


def from_source(df: DataFrame, pattern: str, source_col: str = "_source_file") -> DataFrame:
    """Rows whose file of origin matches a LIKE pattern."""
    return df.where(F.col(source_col).like(pattern))


def small_rows(spark: SparkSession, rows: list[tuple], ddl: str, limit: int = 1000) -> DataFrame:
    """Driver rows as a typed frame; for ledgers only, hence the limit."""
    if len(rows) > limit:
        raise ValueError(f"{len(rows)} rows are data, not a ledger entry; write them with Spark")
    return spark.createDataFrame(rows, ddl)
