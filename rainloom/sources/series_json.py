"""Hourly series kept as JSON with parallel arrays: ``{"time": [...], "<variable>": [...]}``.

One file per station and period, named ``<station>_<period>.json``. The payload
is either the whole document or sits in an envelope (``data.hourly`` or ``hourly``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.constants import VENDOR_RENAMES
from rainloom.functions.timeparts import to_local

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"


def series_schema(variables: list[str]) -> str:
    return ", ".join(["`time` array<string>", *[f"`{v}` array<double>" for v in variables]])


def document_schema(variables: list[str], envelope: str | None = None) -> str:
    """DDL of the file; ``envelope`` is the dotted path to the payload, if any."""
    ddl = series_schema(variables)
    for level in reversed((envelope or "").split(".") if envelope else []):
        ddl = f"`{level}` struct<{ddl.replace('` ', '`:')}>"
    return ddl


def rows_of(series: Column, variables: list[str]) -> Column:
    """Array of row structs from a struct of parallel arrays."""
    return F.arrays_zip(series["time"], *[series[v] for v in variables])


def _inline(df: DataFrame, series: Column, variables: list[str], keep: list[str], time_col: str) -> DataFrame:
    names = ["time", *variables]
    zipped = df.select(*keep, F.explode(rows_of(series, variables)).alias("_row"))
    fields = [F.col("_row").getField(n).alias(n) for n in names]
    return zipped.select(*keep, *fields).select(
        *keep, to_local(F.col("time"), TIME_FORMAT).alias(time_col), *variables
    )


def read_series(
    spark: SparkSession,
    path: str,
    variables: list[str],
    envelope: str | None = None,
    station: str | None = None,
    time_col: str = "observation_time",
    stream: bool = False,
) -> DataFrame:
    """All series files under ``path`` as rows; ``station`` prunes by file name prefix.

    The station is the file name up to its last ``_``, the origin is kept in ``_source_file``.
    """
    reader = (spark.readStream if stream else spark.read).schema(document_schema(variables, envelope))
    reader = reader.option("multiLine", True).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", f"{station}_*.json" if station else "*.json")
    files = reader.json(path).withColumns({
        "station_id": F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)_[^_]*$", 1),
        "_source_file": F.col("_metadata.file_path"),
    })
    payload = F.struct(*[F.col(f"{envelope}.{c}" if envelope else c).alias(c) for c in ["time", *variables]])
    return _inline(files, payload, variables, ["station_id", "_source_file"], time_col)


_FOLDERS = r"station_id=([^/]+)/period=([^/]+)/"


def write_series(packed: DataFrame, path: str) -> None:
    """Add packed series (``station_id``, ``period``, ``payload``) as files in one folder per station and period."""
    packed.select("station_id", "period", "payload").write.mode("append").partitionBy("station_id", "period").text(path)


def stored_periods(spark: SparkSession, path: str) -> DataFrame:
    """(station_id, period, fetched_at) of the files in the folders of ``write_series``, from their names and
    times alone. The listing is a distributed scan that opens no file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return files.select(
        F.regexp_extract("path", _FOLDERS, 1).alias("station_id"), F.regexp_extract("path", _FOLDERS, 2).cast("date").alias("period"), "modificationTime"
    ).where("period IS NOT NULL").groupBy("station_id", "period").agg(F.max("modificationTime").alias("fetched_at"))


def read_stored(spark: SparkSession, path: str, variables: list[str], time_col: str = "observation_time") -> DataFrame:
    """The rows of the files in the folders of ``write_series``; station and period prune folders."""
    texts = spark.read.text(path).select(F.col("value").alias("payload"), F.col("station_id").cast("string"), F.col("period").cast("date"))
    return unpack_series(texts, "payload", variables, ["station_id", "period"], time_col)


def normalise_names(df: DataFrame, renames: dict[str, str] = VENDOR_RENAMES) -> DataFrame:
    return df.withColumnsRenamed(renames)


def pack_series(
    rows: DataFrame, keys: list[str], time_col: str, variables: list[str], payload: str = "payload"
) -> DataFrame:
    """One JSON text per (keys, day), hence at most 24 entries per array for hourly rows."""
    row = F.struct(F.date_format(time_col, TIME_FORMAT).alias("time"), *variables)
    ordered = rows.groupBy(*keys, F.to_date(time_col).alias("period")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    arrays = F.struct(*[F.col("_rows").getField(c).alias(c) for c in ["time", *variables]])
    return ordered.select(*keys, "period", F.to_json(arrays, {"ignoreNullFields": "false"}).alias(payload))


def unpack_series(
    packed: DataFrame, payload: str, variables: list[str], keep: list[str], time_col: str = "observation_time"
) -> DataFrame:
    parsed = packed.withColumn("_series", F.from_json(payload, series_schema(variables)))
    return _inline(parsed, F.col("_series"), variables, keep, time_col)
