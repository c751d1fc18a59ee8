"""Reading, gridding, cleaning and planning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import (
    CELLS_SQL, GRID_SQL, REGION_SQL, dense_observations, event_rows, observations, region_orders,
)
from rainloom.catalog.registry import query
from rainloom.functions.numeric import exact_mean, exact_sum, missing_to_null
from rainloom.functions.timeparts import hour_floor, month_floor, utc_to_zone
from rainloom.operators.grid import densify, keep_one, merge_repeated_hours
from rainloom.operators.profile import top
from rainloom.sources.planner import missing_periods
from rainloom.sources.series_json import normalise_names, pack_series, read_stored, stored_periods, unpack_series, write_series
from rainloom.session import scratch_path
from rainloom.sources.tables import from_source, from_sql, horizon, read_table, required, since, up_to


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_shipdate IS NOT NULL
  AND l_shipdate <= TIMESTAMP '1996-06-30 00:00:00'""")
def required_columns_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered projection, required columns and an as-of bound, all pushed to the scan."""
    rows = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    as_of = F.lit("1996-06-30 00:00:00").cast("timestamp_ntz")
    return required(up_to(rows, "l_shipdate", as_of), ["l_quantity", "l_extendedprice", "l_shipdate"])


@query("""
SELECT event_type AS station_id, COUNT(*) AS n, ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_type IN ('click', 'view') GROUP BY 1""")
def sql_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parametrised SQL text as a source."""
    return from_sql(
        spark,
        """SELECT event_type AS station_id, count(*) AS n,
                  round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
           FROM {events}
           WHERE ts >= CAST(:since AS TIMESTAMP_NTZ) AND array_contains(:stations, event_type) GROUP BY event_type""",
        {"since": "2024-01-10 00:00:00", "stations": F.array(F.lit("click"), F.lit("view"))},
        events=read_table(spark, sf_dir, "events"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "props")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(CELLS_SQL.replace("\nev AS", "WITH ev AS", 1) + """
SELECT station_id, observation_time, temperature_2m, relative_humidity AS relative_humidity_2m, windspeed
FROM cells""")
def columnar_json_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly cells packed to one parallel-array JSON text per station and day, then read back to rows."""
    cells = observations(spark, sf_dir).select(
        "station_id", "observation_time", "temperature_2m",
        F.col("relative_humidity").alias("relative_humidity_2m"), "windspeed",
    )
    variables = ["temperature_2m", "relative_humidity_2m", "windspeed"]
    packed = pack_series(cells, ["station_id"], "observation_time", variables)
    return unpack_series(packed, "payload", variables, keep=["station_id"]).select(
        "station_id", "observation_time", *variables
    )


@query("SELECT doc_id, lang, source FROM documents WHERE source LIKE '%src1%'")
def provenance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return from_source(docs, "%src1%", "source")


@query("WITH" + GRID_SQL + """
SELECT station_id, observation_time, temperature_2m, precipitation, relative_humidity FROM grid""")
def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous hourly series per station; hours without events are null."""
    return dense_observations(spark, sf_dir, narrow=True)


@query("WITH" + GRID_SQL + """
SELECT station_id, observation_time, windspeed FROM grid""")
def densify_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid from an hourly table that already has unique hours."""
    cells = observations(spark, sf_dir).select("station_id", "observation_time", "windspeed")
    return densify(cells, ["station_id"], "observation_time")


@query("WITH" + CELLS_SQL + """
SELECT station_id, observation_time, ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS precip_mm,
       MIN(k) AS k FROM ev GROUP BY 1, 2""")
def merge_repeated_local_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a local hour: amounts are summed, state variables reduced to one value."""
    rows = event_rows(spark, sf_dir).select(
        "station_id", hour_floor(F.col("ts")).alias("observation_time"),
        F.col("value").cast("decimal(18,2)").alias("precip_mm"), "k",
    )
    merged = merge_repeated_hours(rows, ["station_id"], "observation_time", "precip_mm", ["k"])
    return merged.withColumn("precip_mm", F.round(F.col("precip_mm").cast("double"), 2))


@query("""
SELECT event_type AS station_id, date_trunc('hour', ts) AS observation_time,
       first(event_id ORDER BY ts, event_id) AS event_id, first(value ORDER BY ts, event_id) AS value
FROM events GROUP BY 1, 2""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station and hour: the earliest event, ties by id."""
    rows = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station_id"), hour_floor(F.col("ts")).alias("observation_time"),
        "event_id", "value", "ts",
    )
    return keep_one(rows, ["station_id", "observation_time"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest row per composite key."""
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return keep_one(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], latest=True).drop("ts")


@query("""
SELECT station_id, MIN(v) AS lo, MAX(v) AS hi, COUNT(v) AS known, COUNT(*) AS n FROM (
  SELECT event_type AS station_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1""")
def missing_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN readings become nulls before any aggregate sees them."""
    broken = F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("station_id"), missing_to_null(broken).alias("v"))
    return rows.groupBy("station_id").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("known"), F.count(F.lit(1)).alias("n")
    )


@query("""
SELECT event_type AS station_id, event_id FROM events
WHERE ts > TIMESTAMP '2024-01-20 06:00:00' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20 06:00:00'""")
def lookback_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 48 hours up to an as-of moment."""
    as_of = F.lit("2024-01-20 06:00:00").cast("timestamp_ntz")
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("station_id"), "event_id", "ts")
    return since(up_to(rows, "ts", as_of), "ts", as_of, "48 HOURS").drop("ts")


@query("""
SELECT event_id, 'next24' AS slice FROM events
WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00'
UNION ALL
SELECT event_id, 'next48' AS slice FROM events
WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-17 00:00:00'""")
def horizon_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open and left-open forecast horizons."""
    t0 = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    rows = read_table(spark, sf_dir, "events").select("event_id", "ts")
    next24 = horizon(rows, "ts", t0, 24).select("event_id", F.lit("next24").alias("slice"))
    next48 = horizon(rows, "ts", t0, 48, closed="right").select("event_id", F.lit("next48").alias("slice"))
    return next24.unionByName(next48)


_PLAN_SQL = "WITH" + REGION_SQL + """,
loaded AS (
  SELECT n_name AS station_id, date_trunc('month', o_orderdate) AS period, MAX(o_orderdate) AS fetched_at
  FROM ro GROUP BY 1, 2 HAVING COUNT(*) >= 5),
st AS (SELECT DISTINCT n_name AS station_id FROM ro),
due AS (
  SELECT station_id, p AS period FROM st, (
    SELECT UNNEST(generate_series(TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '2001-08-01 00:00:00', INTERVAL 1 MONTH)) AS p))
SELECT station_id, strftime(period, '%Y-%m') AS period,
       CASE WHEN fetched_at IS NULL THEN 'missing' ELSE 'open' END AS reason
FROM due LEFT JOIN loaded USING (station_id, period)
WHERE fetched_at IS NULL
   OR (period = TIMESTAMP '2001-08-01 00:00:00' AND fetched_at < TIMESTAMP '2001-08-15 00:00:00' - INTERVAL 24 HOUR)"""


@query(_PLAN_SQL)
def missing_period_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station months still to be loaded: absent, or open and stale."""
    rows = region_orders(spark, sf_dir).select(F.col("n_name").alias("station_id"), "o_orderdate")
    loaded = (
        rows.groupBy("station_id", month_floor(F.col("o_orderdate")).alias("period"))
        .agg(F.max("o_orderdate").alias("fetched_at"), F.count(F.lit(1)).alias("n"))
        .where("n >= 5")
    )
    plan = missing_periods(
        rows.select("station_id").distinct(), ["station_id"], loaded,
        first="1995-01-01", as_of=F.lit("2001-08-15 00:00:00").cast("timestamp_ntz"), stale_hours=24,
    )
    return plan.select("station_id", F.date_format("period", "yyyy-MM").alias("period"), "reason")


@query("""
SELECT lang, source, COUNT(*) AS n, MIN(doc_id) AS first_doc, MAX(doc_id) AS last_doc FROM documents GROUP BY 1, 2""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent and size of each source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query("""
SELECT event_id, ts - INTERVAL 3 HOUR AS local_time, CAST(hour(ts - INTERVAL 3 HOUR) AS INTEGER) AS local_hour FROM events""")
def zone_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC times as local times (three hours behind, no summer time in that month)."""
    local = utc_to_zone(F.col("ts"), "America/Sao_Paulo")
    return read_table(spark, sf_dir, "events").select("event_id", local.alias("local_time"), F.hour(local).alias("local_hour"))


@query("""
SELECT event_type AS station_id, event_id, value FROM events ORDER BY ts, event_id LIMIT 100""")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows in time, for a model signature."""
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("station_id"), "event_id", "value", "ts")
    return top(rows, 100, F.asc("ts"), F.asc("event_id")).drop("ts")


@query("""
SELECT MIN(ts) AS first_time, MAX(ts) AS last_time, COUNT(*) AS n, ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total,
       ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(value), 6) AS mean FROM events""")
def global_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent, size, total and mean of the whole table in one pass."""
    return read_table(spark, sf_dir, "events").agg(
        F.min("ts").alias("first_time"), F.max("ts").alias("last_time"), F.count(F.lit(1)).alias("n"),
        F.round(exact_sum(F.col("value")), 2).alias("total"), F.round(exact_mean(F.col("value")), 6).alias("mean"),
    )


@query("WITH" + CELLS_SQL + """,
kept AS (SELECT station_id, CAST(observation_time AS DATE) AS day, temperature_2m FROM cells
         WHERE station_id <> 'error' OR observation_time < TIMESTAMP '2024-01-11 00:00:00'),
days AS (SELECT station_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT station_id FROM cells)),
stored AS (SELECT station_id, day, COUNT(*) AS hours, CAST(SUM(CAST(temperature_2m AS DECIMAL(28,6))) AS DOUBLE) AS total FROM kept GROUP BY 1, 2)
SELECT d.station_id, CAST(d.day AS TIMESTAMP) AS period, CASE WHEN s.day IS NULL THEN 'missing' WHEN d.day = DATE '2024-01-31' THEN 'open' ELSE 'kept' END AS state,
       coalesce(s.hours, 0) AS hours, s.total FROM days d LEFT JOIN stored s ON d.station_id = s.station_id AND d.day = s.day""")
def series_folder_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series files in a folder as the source: written per station and day, planned from the listing, read and renamed."""
    cells = observations(spark, sf_dir).select("station_id", "observation_time", "temperature_2m", F.col("relative_humidity").alias("relative_humidity_2m"))
    landed = cells.where("station_id <> 'error' OR observation_time < TIMESTAMP_NTZ '2024-01-11 00:00:00'")
    folder = scratch_path(spark, "series")
    variables = ["temperature_2m", "relative_humidity_2m"]
    write_series(pack_series(landed, ["station_id"], "observation_time", variables), folder)
    stations, as_of = cells.select("station_id").distinct(), F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    plan = missing_periods(stations, ["station_id"], stored_periods(spark, folder), "2024-01-01", as_of, period="day")
    rows = normalise_names(read_stored(spark, folder, variables))
    read = rows.groupBy("station_id", "period").agg(F.count("relative_humidity").alias("hours"), F.sum(F.col("temperature_2m").cast("decimal(28,6)")).cast("double").alias("total"))
    due = stations.select("station_id", F.explode(F.expr("sequence(DATE '2024-01-01', DATE '2024-01-31')")).alias("period"))
    return due.join(plan, ["station_id", "period"], "left").join(read, ["station_id", "period"], "left").select(
        "station_id", F.col("period").cast("timestamp_ntz").alias("period"), F.coalesce("reason", F.lit("kept")).alias("state"), F.coalesce("hours", F.lit(0)).alias("hours"), "total"
    )
