"""Quantile summaries that are stored per day and merged on roll-up, beside the exact way of ``prefix``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Size of a sketch, and the share of rows by which the rank of an estimated quantile may be off.
#: The error of this size is about half a percent with 99 % certainty, however many are merged.
SIZE, RANK_ERROR = 800, 0.01


def sketched(df: DataFrame, keys: list[str], time_col: str, value: str, size: int = SIZE) -> DataFrame:
    """One sketch per (keys, day) with the number of its values; nulls and NaN take no part.

    A day without values has an empty count and no row, so that stored days can be added up later.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*keys, F.to_date(time_col).alias("day")).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def rolled_up(sketches: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """One sketch per (keys) from those of many days; no value is read again."""
    return sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch", size).alias("sketch"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("days")
    )


def quantiles(rolled: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """Estimated quantiles, one row per (keys, share)."""
    entries = F.array(*[
        F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias("quantile")) for s in shares
    ])
    return rolled.select(*keys, "n", "days", F.inline(entries))


def within_rank_error(estimates: DataFrame, rows: DataFrame, keys: list[str], value: str, error: float = RANK_ERROR) -> DataFrame:
    """Whether each estimate lies where its share of the rows says, within the stated error.

    Rows are counted below and up to every estimate of their keys in one aggregation.
    """
    listed = estimates.groupBy(*keys).agg(F.collect_list(F.struct("share", "quantile")).alias("_all"))
    each = rows.where(F.col(value).isNotNull()).join(listed, keys).select(*keys, value, F.inline("_all"))
    v, q, s = F.col(value).cast("double"), F.col("quantile"), F.col("share")
    counted = each.groupBy(*keys, "share").agg(
        (F.count_if(v < q) / F.count(F.lit(1)) <= F.first(s) + error).alias("_low"),
        (F.count_if(v <= q) / F.count(F.lit(1)) >= F.first(s) - error).alias("_high"),
    )
    return estimates.join(counted.select(*keys, "share", (F.col("_low") & F.col("_high")).alias("within")), [*keys, "share"])
