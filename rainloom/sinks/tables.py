"""Parquet tables by path: overwrite, append, insert-only merge, update of matches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.operators.grid import keep_one
from rainloom.operators.keys import join_on
from rainloom.session import materialize


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the table and its schema. The path must not be one ``df`` reads from."""
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").parquet(path, partitionBy=partition_by)


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """A table whose parts were appended under growing schemas."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def create_if_absent(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """An empty table with the schema of ``df``; whether it had to be made."""
    if exists(df.sparkSession, path):
        return False
    df.limit(0).write.parquet(path, partitionBy=partition_by)
    return True


def with_columns_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def add_columns(spark: SparkSession, table: str, columns: dict[str, str]) -> list[str]:
    """Add absent columns to a catalog table; returns the added names."""
    have = set(spark.table(table).columns)
    new = {c: t for c, t in columns.items() if c not in have}
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{c}` {t}' for c, t in new.items())})")
    return list(new)


def not_yet_present(incoming: DataFrame, history: DataFrame, keys: list[str], pruned_by: str | None = None) -> DataFrame:
    """Incoming rows whose keys the history lacks.

    ``pruned_by`` names a key (a time) by which only the touched range of the history is read.
    """
    if pruned_by:
        lowest = incoming.agg(F.min(pruned_by)).scalar()
        history = history.where(F.col(pruned_by) >= lowest)
    return incoming.join(history.select(*keys), keys, "left_anti")


def one_of_equal_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key (a null key is one), the smallest by its other columns, so that a rerun takes the same."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return keep_one(df, keys, [F.struct(*rest)]) if rest else df.distinct()


def merge_insert_only(incoming: DataFrame, path: str, keys: list[str], pruned_by: str | None = None) -> None:
    """Append only what is not there yet, once per key: running it again changes nothing."""
    spark = incoming.sparkSession
    incoming = one_of_equal_keys(incoming, keys)
    if not exists(spark, path):
        append(incoming, path)
        return
    history = read_evolved(spark, path)
    append(not_yet_present(incoming, history, keys, pruned_by), path)


def updated_where_matched(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with the columns of matching update rows. A match flag decides, so an
    update may set a value to null. Write the result to a new path."""
    fresh = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_match"))
    pick = lambda c: F.when(F.col("_match"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return target.join(fresh, keys, "left").select(*[pick(c) if c in columns else F.col(c) for c in target.columns])


def merge_update_partitions(updates: DataFrame, path: str, keys: list[str], columns: list[str], partition_by: list[str]) -> None:
    """Write new values of matching rows into a partitioned table, touching only the partitions with matches.

    The touched partitions are found by a scan of keys alone, then read, updated and written
    to the shared folder, and put in place of the old ones; files of other partitions stay as they
    are. Of several updates of a key one is taken. Updates without a match add nothing. A run that is
    cut off before the last step has changed nothing, and running again gives the same table.
    """
    spark = updates.sparkSession
    fresh = materialize(one_of_equal_keys(updates.select(*keys, *columns), keys), "updates")
    target = spark.read.parquet(path)
    matched = target.select(*{*keys, *partition_by}).join(fresh.select(*keys), keys, "left_semi")
    touched = materialize(matched.select(*partition_by).distinct(), "touched")
    rows = materialize(updated_where_matched(join_on(target, touched, partition_by, "left_semi"), fresh, keys, columns), "partitions")
    if not touched.isEmpty():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def archive_raw(df: DataFrame, path: str, time_col: str) -> None:
    """Landed rows as JSON under year/month folders."""
    t = F.col(time_col)
    dated = df.withColumns({"year": F.date_format(t, "yyyy"), "month": F.date_format(t, "MM")})
    dated.write.mode("append").partitionBy("year", "month").json(path)


def register_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)
