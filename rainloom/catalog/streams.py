"""Streaming runs over files derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import event_rows, observation_cells
from rainloom.catalog.feature_sets import FEATURED_SQL, STORE_OUT_SQL, rounded
from rainloom.catalog.registry import query
from rainloom.session import scratch_path
from rainloom.sources.tables import read_table
from rainloom.streaming.incremental import compact, current_store, run_feature_stream
from rainloom.streaming.landing import land


def _files(rows: DataFrame, path: str, files: int) -> DataFrame:
    """The rows as several files in an order unrelated to time, read one file per micro-batch."""
    rows.repartitionByRange(files, "ts").write.mode("append").parquet(path)
    spark = rows.sparkSession
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(FEATURED_SQL + STORE_OUT_SQL)
def stream_feature_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table kept current from a stream, compacted, and kept current with late rows equals the full build."""
    root, keys = scratch_path(spark, "stream"), ["station_id"]
    late = F.pmod(F.hash("ts", "user_id"), F.lit(500)) == 0
    rows = event_rows(spark, sf_dir)
    for part, files, store in ((~late, 3, "store"), (late, 1, "compacted")):
        if store == "compacted":
            compact(spark, f"{root}/store", f"{root}/compacted", keys)
        stream = _files(rows.where(part), f"{root}/in", files)
        run_feature_stream(stream, keys, "ts", observation_cells(), f"{root}/landing", f"{root}/{store}", f"{root}/checkpoint")
    return rounded(current_store(spark, f"{root}/compacted", keys))


@query("SELECT event_id, event_type, ts, value FROM events")
def stream_file_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files landed once each, although the run is started twice."""
    root = scratch_path(spark, "landing")
    rows = read_table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    stream = _files(rows, f"{root}/in", 3)
    for _ in range(2):
        land(stream, f"{root}/table", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/table")
