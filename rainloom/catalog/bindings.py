"""The supplied tables seen as observation, forecast and truth series.

The SQL fragments describe the same bindings for the checks; they know nothing
of blocks, overlaps or slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.constants import ENSEMBLE_MODELS
from rainloom.functions.numeric import exact_mean, exact_sum, ratio
from rainloom.operators.grid import dense_hourly, hourly_cells
from rainloom.sources.tables import read_table

WET_CUT = 55.0
TRUTH_CUT = 255000.0


# --- hourly observations: station = event type ------------------------------------------

def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station_id"), "ts", "value", "user_id", k.alias("k")
    )


def observation_cells() -> dict[str, Column]:
    value, k, user = F.col("value"), F.col("k"), F.col("user_id")
    mean = exact_mean(value)
    mean_k = ratio(F.sum(k), F.count(k))
    return {
        "temperature_2m": mean,
        "apparent_temperature": F.max(value),
        "precipitation": F.when(mean.isNotNull(), F.greatest(mean - F.lit(WET_CUT), F.lit(0.0))),
        "relative_humidity": F.min(value),
        "windspeed": F.when(F.count(value) > 0, F.count(value).cast("double")),
        "dew_point_2m": F.max(value) - F.min(value),
        "pressure_msl": ratio(F.sum(user), F.count(user)),
        "cloud_cover": mean_k,
        "cloud_cover_low": F.min(k).cast("double"),
        "cloud_cover_mid": F.max(k).cast("double"),
        "cloud_cover_high": F.sum(k).cast("double"),
        "wind_direction_10m": mean_k * F.lit(3.6),
        "tcwv": F.max(user).cast("double"),
        "boundary_layer_height": F.min(user).cast("double"),
    }


def narrow_cells() -> dict[str, Column]:
    cells = observation_cells()
    return {c: cells[c] for c in ("temperature_2m", "precipitation", "relative_humidity")}


def observations(spark: SparkSession, sf_dir: str, narrow: bool = False) -> DataFrame:
    """Hours with data only."""
    cells = narrow_cells() if narrow else observation_cells()
    return hourly_cells(event_rows(spark, sf_dir), ["station_id"], "ts", cells)


def dense_observations(spark: SparkSession, sf_dir: str, narrow: bool = False) -> DataFrame:
    """Every hour of every station; gaps are rows of nulls."""
    cells = narrow_cells() if narrow else observation_cells()
    return dense_hourly(event_rows(spark, sf_dir), ["station_id"], "ts", cells)


CELLS_SQL = f"""
ev AS (
  SELECT event_type AS station_id, date_trunc('hour', ts) AS observation_time, value, user_id,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events),
cells0 AS (
  SELECT station_id, observation_time,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(value) AS temperature_2m,
         MAX(value) AS apparent_temperature, MIN(value) AS relative_humidity,
         CAST(COUNT(value) AS DOUBLE) AS windspeed, MAX(value) - MIN(value) AS dew_point_2m,
         CAST(SUM(user_id) AS DOUBLE) / COUNT(user_id) AS pressure_msl,
         CAST(SUM(k) AS DOUBLE) / COUNT(k) AS cloud_cover, CAST(MIN(k) AS DOUBLE) AS cloud_cover_low,
         CAST(MAX(k) AS DOUBLE) AS cloud_cover_mid, CAST(SUM(k) AS DOUBLE) AS cloud_cover_high,
         CAST(SUM(k) AS DOUBLE) / COUNT(k) * CAST(3.6 AS DOUBLE) AS wind_direction_10m,
         CAST(MAX(user_id) AS DOUBLE) AS tcwv, CAST(MIN(user_id) AS DOUBLE) AS boundary_layer_height
  FROM ev GROUP BY 1, 2),
cells AS (SELECT *, GREATEST(temperature_2m - CAST({WET_CUT} AS DOUBLE), CAST(0 AS DOUBLE)) AS precipitation FROM cells0)"""

GRID_SQL = CELLS_SQL + """,
spans AS (SELECT station_id, MIN(observation_time) AS lo, MAX(observation_time) AS hi FROM cells GROUP BY 1),
frame AS (
  SELECT station_id, UNNEST(generate_series(lo, hi, INTERVAL 1 HOUR)) AS observation_time FROM spans),
grid AS (SELECT * FROM frame LEFT JOIN cells USING (station_id, observation_time))"""


def r6(expr: str) -> str:
    return f"ROUND({expr}, 6)"


def sround(expr: str, digits: int) -> str:
    """SQL twin of ``stable_round``."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


# --- several forecast models: one column group per event type, plus their mean ----------

MODEL_OF_EVENT = {
    "click": "ecmwf_ifs025", "error": "gfs_seamless", "purchase": "icon_seamless",
    "signup": "jma_seamless", "view": "gem_seamless",
}
MEAN_MODEL = "best_match"
MODEL_SOURCES = {
    "precipitation": ("precipitation",), "cloud_cover": ("cloud_cover",),
    "relative_humidity_2m": ("relative_humidity",), "cape": ("windspeed",),
}


def model_forecasts(spark: SparkSession, sf_dir: str, name, stations: int | None = None) -> DataFrame:
    """Wide hourly forecasts of six models on a continuous grid: one series, or one for each
    of ``stations`` groups of users."""
    rows = event_rows(spark, sf_dir).withColumnRenamed("station_id", "model")
    keys = ["station_id"] if stations else []
    if stations:
        rows = rows.withColumn("station_id", F.concat(F.lit("s"), F.col("user_id") % stations))
    member = lambda e, c: F.when(F.col("model") == e, c)
    mean = lambda c: exact_mean(c)
    amount = lambda m: F.when(m.isNotNull(), F.greatest(m - F.lit(WET_CUT), F.lit(0.0)))
    value, k = F.col("value"), F.col("k")
    cells = {}
    for e, m in MODEL_OF_EVENT.items():
        v, kk = member(e, value), member(e, k)
        cells[name("precipitation", m)] = amount(mean(v))
        cells[name("cloud_cover", m)] = ratio(F.sum(kk), F.count(kk))
        cells[name("relative_humidity_2m", m)] = F.min(v)
        cells[name("cape", m)] = F.when(F.count(v) > 0, F.count(v).cast("double"))
    cells[name("precipitation", MEAN_MODEL)] = amount(mean(value))
    cells[name("cloud_cover", MEAN_MODEL)] = ratio(F.sum(k), F.count(k))
    cells[name("relative_humidity_2m", MEAN_MODEL)] = F.min(value)
    cells[name("cape", MEAN_MODEL)] = F.when(F.count(value) > 0, F.count(value).cast("double"))
    return dense_hourly(rows, keys, "ts", cells)


def _models_sql() -> str:
    parts = []
    for m in ENSEMBLE_MODELS:
        event = {v: k for k, v in MODEL_OF_EVENT.items()}.get(m)
        cond = "" if event is None else f" FILTER (WHERE station_id = '{event}')"
        mean = f"CAST(SUM(CAST(value AS DECIMAL(18,2))){cond} AS DOUBLE) / NULLIF(COUNT(value){cond}, 0)"
        parts += [
            f"CASE WHEN COUNT(value){cond} > 0 THEN GREATEST({mean} - CAST({WET_CUT} AS DOUBLE), CAST(0 AS DOUBLE)) END AS p_{m}",
            f"CAST(SUM(k){cond} AS DOUBLE) / NULLIF(COUNT(k){cond}, 0) AS nuv_{m}",
            f"MIN(value){cond} AS ur_{m}",
            f"CASE WHEN COUNT(value){cond} > 0 THEN CAST(COUNT(value){cond} AS DOUBLE) END AS cape_{m}",
        ]
    return ",\n         ".join(parts)


MODELS_SQL = CELLS_SQL + f""",
mcells AS (
  SELECT observation_time,
         {_models_sql()}
  FROM ev GROUP BY 1),
mframe AS (
  SELECT UNNEST(generate_series((SELECT MIN(observation_time) FROM ev), (SELECT MAX(observation_time) FROM ev),
                                INTERVAL 1 HOUR)) AS observation_time),
models AS (SELECT * FROM mframe LEFT JOIN mcells USING (observation_time))"""


# --- forecasts with a lead time: line items; truth: daily order totals ------------------

def forecast_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per forecast. The order date is the time of issue, the ship date the target."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_discount", "l_tax"
    )
    issued = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    prob = F.round(F.abs("l_discount") * 10, 4)
    return lines.join(issued, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("station_id"),
        F.col("l_shipdate").alias("target_time"),
        F.col("o_orderdate").alias("inferencia_local"),
        prob.alias("prob_chuva"),
        (prob >= 0.5).cast("int").alias("pred_vai_chover"),
        F.greatest(F.round(F.abs("l_tax") * 100, 0) - 4, F.lit(0.0)).alias("api_precip_alvo"),
        F.lit(0.5).alias("threshold_usado"), F.concat(F.lit("rain v"), F.col("l_linenumber") % 3).alias("modelo"),
        "l_orderkey", "l_linenumber",
    )


def daily_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = exact_mean(F.col("o_totalprice"))
    amount = F.greatest(mean - F.lit(TRUTH_CUT), F.lit(0.0)) / F.lit(1000.0)
    return read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("observation_time")).agg(
        amount.alias("precipitation")
    )


FORECASTS_SQL = f"""
fc AS (
  SELECT l_suppkey AS station_id, l_shipdate AS target_time, o_orderdate AS inferencia_local,
         ROUND(ABS(l_discount) * 10, 4) AS prob_chuva,
         CASE WHEN ROUND(ABS(l_discount) * 10, 4) >= 0.5 THEN 1 ELSE 0 END AS pred_vai_chover,
         GREATEST(ROUND(ABS(l_tax) * 100, 0) - 4, 0) AS api_precip_alvo,
         CAST(0.5 AS DOUBLE) AS threshold_usado, 'rain v' || CAST(l_linenumber % 3 AS VARCHAR) AS modelo, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
truth AS (
  SELECT o_orderdate AS observation_time,
         GREATEST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice)
                  - CAST({TRUTH_CUT} AS DOUBLE), CAST(0 AS DOUBLE)) / 1000.0 AS precipitation
  FROM orders GROUP BY 1)"""


# --- daily totals per region over several years ----------------------------------------

def region_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", F.col("r_name").alias("station_id"), "n_name", "o_orderdate", "o_totalprice")
    )


REGION_SQL = """
ro AS (
  SELECT o_orderkey, r_name AS station_id, n_name, o_orderdate, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey)"""


def region_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = exact_mean(F.col("o_totalprice"))
    return region_orders(spark, sf_dir).groupBy("station_id", F.col("o_orderdate").alias("observation_time")).agg(
        exact_sum(F.col("o_totalprice")).alias("total"),
        F.count(F.lit(1)).alias("n_orders"),
        (F.greatest(mean - F.lit(TRUTH_CUT), F.lit(0.0)) / F.lit(1000.0)).alias("precipitation"),
    )


REGION_DAYS_SQL = REGION_SQL + f""",
rd AS (
  SELECT station_id, o_orderdate AS observation_time, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
         COUNT(*) AS n_orders,
         GREATEST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) - CAST({TRUTH_CUT} AS DOUBLE),
                  CAST(0 AS DOUBLE)) / 1000.0 AS precipitation
  FROM ro GROUP BY 1, 2)"""


# --- labelled scores --------------------------------------------------------------------

def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = read_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", "quality", "toxic",
        F.round(F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)), 4).alias("score"),
    )


SCORED_SQL = """
sl AS (
  SELECT doc_id, lang, quality, toxic, ROUND(LEAST(n_chars / 5000.0, 1.0), 4) AS score
  FROM documents JOIN labels USING (doc_id))"""
