"""Splits, gates and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import CELLS_SQL, REGION_DAYS_SQL, observations, region_days
from rainloom.catalog.registry import query
from rainloom.functions.numeric import share
from rainloom.operators.splits import (
    assign_folds, complete_in_all, large_enough, latest, months_before, new_rows_gate, newer_than_sink,
    rolling_split, split_at, trailing_per_group,
)

T = "observation_time"
KEY = ["station_id"]


def _moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _sizes(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(T).alias("first_t"), F.max(T).alias("last_t"),
        F.round(share(F.col("precipitation") > 0), 6).alias("wet"),
    )


_SIZES = "COUNT(*) AS n, MIN(observation_time) AS first_t, MAX(observation_time) AS last_t, ROUND(AVG(CAST(precipitation > 0 AS INTEGER)), 6) AS wet"


@query("WITH" + REGION_DAYS_SQL + f"""
SELECT CASE WHEN observation_time < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' WHEN observation_time < TIMESTAMP '2000-01-01 00:00:00' THEN 'validate'
       ELSE 'test' END AS split, {_SIZES} FROM rd GROUP BY 1""")
def fixed_date_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = split_at(region_days(spark, sf_dir), "1999-01-01", "2000-01-01", ("train", "validate", "test"))
    return _sizes(days, "split")


@query("WITH" + REGION_DAYS_SQL + f""",
e AS (SELECT MAX(observation_time) AS t FROM rd)
SELECT station_id, CASE WHEN observation_time < t - INTERVAL 12 MONTH - INTERVAL 12 MONTH THEN 'train' WHEN observation_time < t - INTERVAL 12 MONTH THEN 'calibrate'
       ELSE 'test' END AS split, {_SIZES} FROM rd, e GROUP BY 1, 2""")
def rolling_month_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train / calibrate / test by months before the last day."""
    days = region_days(spark, sf_dir)
    return _sizes(rolling_split(days, latest(days), 12, 12), "station_id", "split")


@query("WITH" + REGION_DAYS_SQL + """,
e AS (SELECT MAX(observation_time) AS t FROM rd)
SELECT CASE WHEN observation_time < t - INTERVAL 12 MONTH - INTERVAL 4 MONTH THEN 'train' WHEN observation_time < t - INTERVAL 12 MONTH THEN 'calibrate' ELSE 'test' END AS split,
       COUNT(*) AS n FROM rd, e GROUP BY 1""")
def archive_month_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four months of calibration before twelve of test."""
    days = region_days(spark, sf_dir)
    return rolling_split(days, latest(days), 4, 12).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + CELLS_SQL + """,
lab AS (SELECT * FROM cells WHERE windspeed > 1), c AS (SELECT MAX(observation_time) - INTERVAL 1 MONTH + INTERVAL 20 DAY AS cut FROM lab)
SELECT station_id, CAST(observation_time >= cut AS INTEGER) AS is_test, COUNT(*) AS n FROM lab, c GROUP BY 1, 2""")
def cut_at_last_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train before, test from a cut set back from the last labelled hour."""
    labelled = observations(spark, sf_dir).where("windspeed > 1").select("station_id", T)
    cut = months_before(latest(labelled), 1) + F.expr("INTERVAL 20 DAYS")
    return labelled.groupBy("station_id", (F.col(T) >= cut).cast("int").alias("is_test")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_suppkey AS station_id, COUNT(*) AS n, MIN(l_shipdate) AS first_t FROM (
  SELECT *, MAX(l_shipdate) OVER (PARTITION BY l_suppkey) AS e FROM lineitem) WHERE l_shipdate > e - INTERVAL 12 MONTH GROUP BY 1""")
def trailing_window_per_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve months of each station, counted from its own end."""
    from rainloom.sources.tables import read_table

    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station_id"), F.col("l_shipdate").alias(T))
    return trailing_per_group(rows, KEY, 12).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.min(T).alias("first_t"))


@query("SELECT event_id, event_type FROM events WHERE ts > (SELECT MAX(ts) FROM events WHERE user_id % 3 = 0 AND ts < TIMESTAMP '2024-01-25 00:00:00')")
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows newer than everything in the sink."""
    from rainloom.sources.tables import read_table

    rows = read_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts")
    sink = rows.where((F.col("user_id") % 3 == 0) & (F.col("ts") < _moment("2024-01-25 00:00:00")))
    return newer_than_sink(rows, sink, "ts").select("event_id", "event_type")


_VARIANT_SQL = """
a AS (SELECT observation_time, MAX(temperature_2m) FILTER (WHERE station_id = 'click') AS a, MAX(temperature_2m) FILTER (WHERE station_id = 'view') AS b,
             MAX(windspeed) FILTER (WHERE station_id = 'error') AS c FROM cells GROUP BY 1)"""


@query("WITH" + CELLS_SQL + "," + _VARIANT_SQL + " SELECT observation_time, a, b, c FROM a WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def same_rows_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only hours on which every compared variant can be measured."""
    of = lambda s, c: F.max(F.when(F.col("station_id") == s, F.col(c)))
    wide = observations(spark, sf_dir).groupBy(T).agg(
        of("click", "temperature_2m").alias("a"), of("view", "temperature_2m").alias("b"), of("error", "windspeed").alias("c")
    )
    return complete_in_all(wide, ["a", "b"], ["b", "c"])


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING COUNT(*) >= 600)""")
def minimum_group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of suppliers with at least 600 rows."""
    from rainloom.sources.tables import read_table

    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return large_enough(rows, ["l_suppkey"], 600)[0]


@query("SELECT l_suppkey, COUNT(*) AS rows FROM lineitem GROUP BY 1 HAVING COUNT(*) < 600")
def skipped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups the size gate left out."""
    from rainloom.sources.tables import read_table

    return large_enough(read_table(spark, sf_dir, "lineitem").select("l_suppkey"), ["l_suppkey"], 600)[1]


@query("WITH" + CELLS_SQL + """
SELECT COUNT(*) AS novos, COUNT(*) >= 720 AS retreinar FROM cells
WHERE observation_time > TIMESTAMP '2024-01-20 00:00:00' AND observation_time <= TIMESTAMP '2024-01-28 00:00:00'""")
def retrain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New hours since the last training and the decision to retrain."""
    return new_rows_gate(observations(spark, sf_dir), _moment("2024-01-20 00:00:00"), _moment("2024-01-28 00:00:00"), 720)


@query("WITH RECURSIVE" + REGION_DAYS_SQL + """,
g AS (SELECT strftime(observation_time, '%Y-%m') AS period, COUNT(*) AS n FROM rd GROUP BY 1),
o AS (SELECT period, n, ROW_NUMBER() OVER (ORDER BY n DESC, period) AS no FROM g),
dealt AS (
  SELECT CAST(0 AS BIGINT) AS no, CAST(NULL AS VARCHAR) AS period, -1 AS fold, CAST([0, 0, 0, 0] AS BIGINT[]) AS load
  UNION ALL
  SELECT o.no, o.period, CAST(list_position(d.load, list_min(d.load)) - 1 AS INTEGER),
         list_transform(d.load, lambda x, i: x + CASE WHEN i = list_position(d.load, list_min(d.load)) THEN o.n ELSE 0 END)
  FROM dealt d JOIN o ON o.no = d.no + 1)
SELECT d.period, CAST(d.fold AS INTEGER) AS fold, g.n FROM dealt d JOIN g ON d.period = g.period""")
def group_fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months to four folds: the largest month next, to the fold with fewest days."""
    days = region_days(spark, sf_dir).withColumn("period", F.date_format(T, "yyyy-MM"))
    return assign_folds(days, ["period"], 4).groupBy("period", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + REGION_DAYS_SQL + """
SELECT station_id, CAST(SUM(CAST(precipitation > 0 AS INTEGER)) AS BIGINT) AS wet_days,
       ROUND(AVG(CASE WHEN precipitation > 0 THEN precipitation END), 4) AS mean_wet FROM rd GROUP BY 1""")
def wet_only_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates over wet rows next to all rows, in one pass."""
    wet = F.col("precipitation") > 0
    return region_days(spark, sf_dir).groupBy("station_id").agg(
        F.count_if(wet).alias("wet_days"), F.round(F.avg(F.when(wet, F.col("precipitation"))), 4).alias("mean_wet")
    )
