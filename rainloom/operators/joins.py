"""Alignment of series on keys and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rainloom.functions.timeparts import gauge_day, month_floor
from rainloom.operators.grid import months_between
from rainloom.operators.profile import sum_if_enough

T = "observation_time"


def align(series: dict[str, DataFrame], keys: list[str], complete: bool = True) -> DataFrame:
    """Several value series on their common keys; each frame holds the keys and one value."""
    named = [df.select(*keys, F.col(next(c for c in df.columns if c not in keys)).alias(name)) for name, df in series.items()]
    joined = reduce(lambda a, b: a.join(b, keys), named)
    return joined.dropna(subset=list(series)) if complete else joined


def attach(grid: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels on the hours of the grid; hours without a label get null."""
    return grid.join(labels, keys, "left")


def only_common(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur in the other frame too."""
    return df.join(other.select(*keys), keys, "left_semi")


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def monthly_index_filled(index: DataFrame, month_col: str, value: str, last_month: Column) -> DataFrame:
    """A monthly index on every month up to ``last_month``; months without a value take the
    last published one, never a later one. As many rows as months, so one small window."""
    bounds = index.agg(F.min(month_col).alias("_first")).withColumn("_last", last_month)
    calendar = months_between(bounds, [], month_col)
    so_far = Window.partitionBy().orderBy(month_col).rowsBetween(Window.unboundedPreceding, 0)
    return calendar.join(index, month_col, "left").select(
        month_col, F.last(value, ignorenulls=True).over(so_far).alias(value)
    )


def with_monthly_index(rows: DataFrame, filled: DataFrame, month_col: str, time_col: str = T) -> DataFrame:
    """Attach the index of the month of each row."""
    return rows.withColumn(month_col, month_floor(F.col(time_col))).join(filled, month_col, "left")


def all_but_own(totals: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """For each station the totals of all other stations: the grand total less its own.

    Replaces a join of every station with every other; needs additive measures.
    """
    own = totals.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures])
    grand = own.agg(F.struct(*[F.sum(m).alias(m) for m in measures])).scalar()
    return own.select(key, *[(grand[m] - F.col(m)).alias(m) for m in measures])


def gauge_days(
    hourly: DataFrame, keys: list[str], amount: str, reading_hour: int, shifts: list[int], at_least: int
) -> DataFrame:
    """Daily sums under each day convention, null for days with too few hours."""
    shifted = hourly.select(*keys, T, amount, F.explode(F.array(*[F.lit(s) for s in shifts])).alias("desloc"))
    day = gauge_day(F.col(T), reading_hour, F.col("desloc"))
    return shifted.groupBy(*keys, "desloc", day.alias("date")).agg(sum_if_enough(amount, at_least).alias(amount))
