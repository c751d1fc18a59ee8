"""Keeping the feature table current from a stream of raw rows, late rows included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.functions.timeparts import hour_from_index, hour_index
from rainloom.operators.features import LOOKAHEAD, LOOKBACK, feature_store
from rainloom.operators.grid import keep_one
from rainloom.operators.keys import join_on
from rainloom.session import materialize

T = "observation_time"
BATCH, DAY, HOUR, PART = "_batch", "_day", "_hour", "_part"
BLOCK_HOURS = 96


def hours_of(rows: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """The distinct (keys, hour number) of the rows; copies are reduced before the shuffle."""
    return rows.select(*keys, hour_index(F.col(time_col)).alias(HOUR)).distinct()


def extents(hours: DataFrame, keys: list[str]) -> DataFrame:
    return hours.groupBy(*keys).agg(F.min(HOUR).alias("_first"), F.max(HOUR).alias("_last"))


def touched_blocks(hours: DataFrame, before: DataFrame, keys: list[str], block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Per key and block of time the first and last hour whose features change, and the series' new ends.

    A landed hour reaches ``LOOKAHEAD`` back (as target) and ``LOOKBACK`` ahead (as history). Where
    it lies outside the series so far (``before``: the ends per key), the hours between are new too.
    """
    own = extents(hours, keys).withColumnsRenamed({"_first": "_own_first", "_last": "_own_last"})
    ends = join_on(own, before, keys, "left")
    first, last = F.least("_own_first", "_first"), F.greatest("_own_last", "_last")
    outside = F.filter(
        F.array(
            F.when(F.col("_first").isNull(), F.struct(F.col("_own_first").alias("lo"), F.col("_own_last").alias("hi"))),
            F.when(F.col("_own_first") < F.col("_first"), F.struct(F.col("_own_first").alias("lo"), (F.col("_first") - 1).alias("hi"))),
            F.when(F.col("_own_last") > F.col("_last"), F.struct((F.col("_last") + 1).alias("lo"), F.col("_own_last").alias("hi"))),
        ),
        lambda part: part.isNotNull(),
    )
    ends = ends.select(*keys, first.alias("_first"), last.alias("_last"), outside.alias("_outside"))
    new = ends.select(*keys, F.inline("_outside"))
    reached = hours.select(*keys, (F.col(HOUR) - LOOKAHEAD).alias("lo"), (F.col(HOUR) + LOOKBACK).alias("hi"))
    number = F.sequence(F.floor(F.col("lo") / block_hours), F.floor(F.col("hi") / block_hours))
    start = F.col(PART) * block_hours
    cut = reached.unionByName(new).select(*keys, "lo", "hi", F.explode(number).alias(PART)).groupBy(*keys, PART).agg(
        F.min(F.greatest("lo", start)).alias("_lo"), F.max(F.least("hi", start + block_hours - 1)).alias("_hi")
    )
    whole = join_on(cut, ends.drop("_outside"), keys)
    inside = whole.withColumns({"_lo": F.greatest("_lo", "_first"), "_hi": F.least("_hi", "_last")})
    return inside.where("_lo <= _hi")


def refreshed_features(
    raw: DataFrame, blocks: DataFrame, keys: list[str], time_col: str, cells: dict[str, Column], block_hours: int = BLOCK_HOURS
) -> DataFrame:
    """Features of the changed hours of every touched block.

    A block is a series of its own, with the rows around it as context: one late row costs its
    blocks, not the time up to now. Only days that a block needs are read.
    """
    low, high = F.greatest(F.col("_lo") - LOOKBACK, F.col("_first")), F.least(F.col("_hi") + LOOKAHEAD, F.col("_last"))
    reach = blocks.select(*keys, PART, "_lo", "_hi", low.alias("_from"), high.alias("_to"))
    date = lambda hour: F.to_date(hour_from_index(F.col(hour)))
    days = reach.select(F.explode(F.sequence(date("_from"), date("_to"))).alias(DAY)).distinct()
    measures = [c for c in raw.columns if c not in (BATCH, DAY, time_col, *keys)]
    hour = hour_index(F.col(time_col))
    near = F.array_distinct(F.transform(F.array(hour - LOOKAHEAD, hour, hour + LOOKBACK), lambda h: F.floor(h / block_hours)))
    lent = raw.join(days, DAY, "left_semi").select(*keys, *measures, hour.alias(HOUR), F.explode(near).alias(PART))
    around = join_on(lent, reach, [*keys, PART]).where(F.col(HOUR).between(F.col("_from"), F.col("_to")))
    frame = reach.select(*keys, PART, F.explode(F.sequence("_from", "_to")).alias(HOUR))
    own = [*keys, PART]
    dense = around.select(*own, HOUR, *measures).unionByName(frame, allowMissingColumns=True).groupBy(*own, HOUR).agg(
        *[c.alias(name) for name, c in cells.items()]
    )
    fresh = feature_store(dense.withColumn(T, hour_from_index(F.col(HOUR))).drop(HOUR), own)
    changed = join_on(fresh, reach, own).where(hour_index(F.col(T)).between(F.col("_lo"), F.col("_hi")))
    return changed.select(*[c for c in fresh.columns if c != PART])


def current_store(spark: SparkSession, store: str, keys: list[str]) -> DataFrame:
    """The newest version of each hour."""
    rows = spark.read.parquet(store)
    return keep_one(rows, [*keys, T], [F.col(BATCH)], latest=True).drop(BATCH)


def compact(spark: SparkSession, store: str, target: str, keys: list[str]) -> None:
    """Write the newest version of each hour as one batch of a new store, which the stream goes on with.

    ``store`` stays as it is, so readers and an interrupted run lose nothing.
    """
    newest = spark.read.parquet(store).agg(F.max(BATCH)).first()[0]
    current_store(spark, store, keys).write.mode("overwrite").parquet(f"{target}/{BATCH}={newest}")


def run_feature_stream(
    stream: DataFrame, keys: list[str], time_col: str, cells: dict[str, Column], landing: str, store: str, checkpoint: str
) -> None:
    """Land each micro-batch and write the feature hours it changes, then stop when no file waits.

    All writes go to a folder of the batch and replace it, so a repeated batch
    leaves the same result. The ends of the series are kept beside the landed rows.
    """
    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn(DAY, F.to_date(time_col))
        dated.write.mode("overwrite").partitionBy(DAY).parquet(f"{landing}/{BATCH}={number}")
        landed = spark.read.option("basePath", landing).parquet(f"{landing}/{BATCH}={number}")
        hours = materialize(hours_of(landed, keys, time_col), "hours")
        extents(hours, keys).write.mode("overwrite").parquet(f"{landing}_ends/{BATCH}={number}")
        earlier = spark.read.option("basePath", f"{landing}_ends").parquet(f"{landing}_ends").where(F.col(BATCH) < number)
        before = earlier.groupBy(*keys).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
        blocks = materialize(touched_blocks(hours, before, keys), "touched")
        fresh = refreshed_features(spark.read.parquet(landing), blocks, keys, time_col, cells)
        fresh.write.mode("overwrite").parquet(f"{store}/{BATCH}={number}")

    query = (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
