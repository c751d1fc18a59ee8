"""Continuous hourly (or daily, monthly) series from irregular rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.functions.numeric import missing_to_null
from rainloom.functions.timeparts import hour_floor, hour_from_index, hour_index
from rainloom.operators.keys import join_on

CHUNK_HOURS = 24 * 32


def span(df: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """First and last time per key; partially aggregated before its shuffle."""
    return df.groupBy(*keys).agg(F.min(time_col).alias("_first"), F.max(time_col).alias("_last"))


def hours_between(bounds: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """Every hour from ``_first`` to ``_last`` per key.

    Exploded in two steps, so no row ever holds more than one chunk of hours and
    a long series is spread over tasks before the second step.
    """
    lo, hi = hour_index(F.col("_first")), hour_index(F.col("_last"))
    chunk_no = F.sequence(F.floor(lo / CHUNK_HOURS), F.floor(hi / CHUNK_HOURS))
    chunks = bounds.select(*keys, lo.alias("_lo"), hi.alias("_hi"), F.explode(chunk_no).alias("_chunk")).repartition(
        *[F.col(k) for k in keys], F.col("_chunk")
    )
    start = F.greatest(F.col("_lo"), F.col("_chunk") * CHUNK_HOURS)
    stop = F.least(F.col("_hi"), (F.col("_chunk") + 1) * CHUNK_HOURS - 1)
    hour_no = chunks.select(*keys, F.explode(F.sequence(start, stop)).alias("_index"))
    return hour_no.select(*keys, hour_from_index(F.col("_index")).alias(time_col))


def months_between(bounds: DataFrame, keys: list[str], month_col: str) -> DataFrame:
    months = F.sequence(F.trunc(F.to_date("_first"), "MM"), F.trunc(F.to_date("_last"), "MM"), F.expr("INTERVAL 1 MONTH"))
    return bounds.select(*keys, F.explode(months).alias(month_col))


def hourly_cells(
    rows: DataFrame, keys: list[str], time_col: str, cells: dict[str, Column], hour_col: str = "observation_time"
) -> DataFrame:
    """Aggregate rows to (keys, hour); hours without rows are absent."""
    return rows.groupBy(*keys, hour_floor(F.col(time_col)).alias(hour_col)).agg(
        *[c.alias(name) for name, c in cells.items()]
    )


def dense_hourly(
    rows: DataFrame, keys: list[str], time_col: str, cells: dict[str, Column], hour_col: str = "observation_time"
) -> DataFrame:
    """Aggregate rows to a continuous hourly grid per key.

    The empty hours join the rows as rows without measures before the one
    aggregation, so the gap fill costs no join. Aggregates must ignore nulls.
    """
    measures = [c for c in rows.columns if c not in keys and c != time_col]
    frame = hours_between(span(rows, keys, time_col), keys, hour_col)
    observed = rows.select(*keys, hour_floor(F.col(time_col)).alias(hour_col), *measures)
    return (
        observed.unionByName(frame, allowMissingColumns=True)
        .groupBy(*keys, hour_col)
        .agg(*[c.alias(name) for name, c in cells.items()])
    )


def densify(cells: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """Put an hourly table with unique (keys, hour) on a continuous grid; gaps become nulls."""
    frame = hours_between(span(cells, keys, time_col), keys, time_col)
    return join_on(frame, cells, [*keys, time_col], "left")


def normalise_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: missing_to_null(F.col(c)) for c in columns})


def keep_one(df: DataFrame, keys: list[str], order: list[Column], latest: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the given order.

    An aggregate of structs rather than a ranked window: duplicates of a hot key
    are reduced before the shuffle. The order must be total.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    pick = F.max_by if latest else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), ranked).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def merge_repeated_hours(df: DataFrame, keys: list[str], hour_col: str, amount: str, state: list[str]) -> DataFrame:
    """Local hours repeated at the end of summer time: amounts are added (null if none is
    known), state variables keep the smallest known value so the choice is repeatable."""
    return df.groupBy(*keys, hour_col).agg(F.sum(amount).alias(amount), *[F.min(c).alias(c) for c in state])
