"""Which station periods still have to be loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STEP = {"day": ("DD", "INTERVAL 1 DAY"), "month": ("MM", "INTERVAL 1 MONTH"), "year": ("YEAR", "INTERVAL 1 YEAR")}


def missing_periods(
    stations: DataFrame,
    keys: list[str],
    loaded: DataFrame,
    first: str,
    as_of: Column,
    period: str = "month",
    delay_days: int = 0,
    stale_hours: int | None = None,
) -> DataFrame:
    """Periods per station that are absent from ``loaded(keys, period, fetched_at)``, or open.

    Closed periods are kept once loaded. The open period is fetched again, unless
    ``stale_hours`` is given and its file is younger than that. The archive lags
    ``delay_days`` behind ``as_of``.
    """
    unit, step = STEP[period]
    whole = lambda day: day if period == "day" else F.trunc(day, unit)
    last = whole(F.date_sub(F.to_date(as_of), delay_days))
    start = whole(F.lit(first).cast("date"))
    due = stations.select(*keys, F.explode(F.sequence(start, last, F.expr(step))).alias("period"))
    is_open = F.col("period") == last
    stale = F.lit(True) if stale_hours is None else (
        F.col("fetched_at").cast("timestamp_ntz") < as_of - F.expr(f"INTERVAL {stale_hours} HOURS")
    )
    known = loaded.select(*keys, "period", "fetched_at")
    return (
        due.join(known, [*keys, "period"], "left")
        .where(F.col("fetched_at").isNull() | (is_open & stale))
        .select(*keys, "period", F.when(F.col("fetched_at").isNull(), "missing").otherwise("open").alias("reason"))
    )
