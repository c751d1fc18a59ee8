"""Building the feature table and keeping it up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.constants import RAW_COLUMNS
from rainloom.operators.features import LOOKBACK, feature_store
from rainloom.operators.grid import densify, keep_one, normalise_missing
from rainloom.operators.keys import join_on
from rainloom.session import materialize
from rainloom.sinks import tables as sink
from rainloom.sources.tables import required, up_to

T = "observation_time"
CONTEXT_HOURS = 48
CRITICAL = ["precipitation", "temperature_2m", "relative_humidity"]


def clean_observations(table: DataFrame, keys: list[str], as_of=None) -> DataFrame:
    """Observed rows with their critical columns, on a continuous grid."""
    return densify(observed_hours(table, keys, as_of), keys, T)


def observed_hours(table: DataFrame, keys: list[str], as_of=None) -> DataFrame:
    """Rows with their critical columns, NaN counting as missing."""
    rows = up_to(table, T, as_of).select(*keys, T, *RAW_COLUMNS)
    numbers = [f.name for f in rows.schema if f.name in RAW_COLUMNS and f.dataType.typeName() in ("double", "float")]
    return required(normalise_missing(rows, numbers), CRITICAL)


def incremental_features(
    dense: DataFrame, store: DataFrame, keys: list[str], context_hours: int = CONTEXT_HOURS, late_hours: int = 0
) -> DataFrame:
    """Rows to append to ``store``: hours after its last one, per station.

    Reads only the new hours and ``context_hours`` before them. ``late_hours``
    moves the mark back to pick up rows that arrived late; the caller then
    replaces those hours. A station absent from the store is built in full.
    """
    if context_hours < LOOKBACK + 1:
        raise ValueError("the context must cover the longest lag")
    marks = store.groupBy(*keys).agg(
        (F.max(T) - F.expr(f"INTERVAL {int(late_hours)} HOURS")).alias("_mark")
    )
    with_mark = lambda df: join_on(df, marks, keys, "left") if keys else df.withColumn("_mark", marks.scalar())
    context_start = F.col("_mark") - F.expr(f"INTERVAL {int(context_hours)} HOURS")
    recent = with_mark(dense).where(F.col("_mark").isNull() | (F.col(T) > context_start)).drop("_mark")
    fresh = with_mark(feature_store(recent, keys))
    return fresh.where(F.col("_mark").isNull() | (F.col(T) > F.col("_mark"))).drop("_mark")


def update_feature_table(
    spark: SparkSession, observations: DataFrame, store_path: str, keys: list[str], as_of: Column | None = None,
    context_hours: int = CONTEXT_HOURS,
) -> None:
    """Append the new hours of every station to the feature table, or build it if it is absent or empty.

    A scan of keys and times alone finds the stations with new hours. Only those are read in
    full, from the oldest of their marks less the context, as a literal that reaches the parquet
    reader, and each from its own mark; stations that aren't in the table are read from their
    beginning. Of repeated hours one row is taken, on building as on updating.
    """
    rows = observed_hours(observations, keys, as_of)
    once = lambda df: densify(keep_one(df, [*keys, T], [F.struct(*RAW_COLUMNS)]), keys, T)
    marks = None
    if sink.exists(spark, store_path):
        marks = materialize(sink.read_evolved(spark, store_path).groupBy(*keys).agg(F.max(T).alias("_mark")).where("_mark IS NOT NULL"), "marks")
    if marks is None or marks.isEmpty():
        sink.append(feature_store(once(rows), keys), store_path)
        return
    newest = up_to(observations, T, as_of).groupBy(*keys).agg(F.max(T).alias("_newest"))
    compared = join_on(newest, marks, keys, "left") if keys else newest.withColumn("_mark", marks.select("_mark").scalar())
    behind = materialize(compared.where(F.col("_mark").isNull() | (F.col("_newest") > F.col("_mark"))), "behind")
    oldest, unknown, known = behind.agg(F.min("_mark"), F.count_if(F.col("_mark").isNull()), F.count("_mark")).first()
    if not unknown and not known:
        return
    context = F.expr(f"INTERVAL {int(context_hours)} HOURS")
    own = lambda part, scan: join_on(scan, behind.where(part).select(*keys, "_mark"), keys) if keys else scan.withColumn("_mark", F.lit(oldest))
    parts = []
    if known:
        recent = own(F.col("_mark").isNotNull(), rows.where(F.col(T) > F.lit(oldest) - context))
        parts.append(recent.where(F.col(T) > F.col("_mark") - context).drop("_mark"))
    if unknown:
        parts.append(own(F.col("_mark").isNull(), rows).drop("_mark"))
    fresh = once(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0])
    sink.append(incremental_features(fresh, marks.withColumnRenamed("_mark", T), keys, context_hours), store_path)
