"""Feature and target queries over the dense hourly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import GRID_SQL, dense_observations, observations, sround
from rainloom.catalog.registry import query
from rainloom.constants import ALL_FEATURES, BASE_FEATURES
from rainloom.functions.labels import event
from rainloom.functions.numeric import round_half_even
from rainloom.operators.blocks import forward_fill, over_blocks
from rainloom.operators.features import (
    calendar_columns, centred, cycle_columns, delta_columns, feature_store, framed, lag_columns, rolling_columns,
    shifted_features, target_columns, wind_columns,
)
from rainloom.functions.timeparts import calendar_flags
from rainloom.plans.feature_table import update_feature_table
from rainloom.session import materialize, scratch_path
from rainloom.sinks.tables import read_evolved

KEY = ["station_id"]
T = "observation_time"

W = "WINDOW w AS (PARTITION BY station_id ORDER BY observation_time)"
frame = lambda lo, hi: f"(PARTITION BY station_id ORDER BY observation_time ROWS BETWEEN {lo} AND {hi})"
back = lambda k: frame(f"{k - 1} PRECEDING", "CURRENT ROW")

LAG_SQL = """
 LAG(temperature_2m, 1) OVER w AS temp_lag_1h, LAG(temperature_2m, 3) OVER w AS temp_lag_3h,
 LAG(temperature_2m, 24) OVER w AS temp_lag_24h, LAG(precipitation, 1) OVER w AS precip_lag_1h,
 LAG(precipitation, 3) OVER w AS precip_lag_3h, LAG(precipitation, 24) OVER w AS precip_lag_24h,
 LAG(relative_humidity, 1) OVER w AS humidity_lag_1h, LAG(relative_humidity, 3) OVER w AS humidity_lag_3h"""
DELTA_SQL = """
 temperature_2m - LAG(temperature_2m, 1) OVER w AS temp_delta_1h,
 relative_humidity - LAG(relative_humidity, 1) OVER w AS humidity_delta_1h,
 precipitation - LAG(precipitation, 1) OVER w AS precip_delta_1h"""


def rolling_sql(full: bool = False) -> str:
    parts = []
    for name, agg, col, k in [
        ("temp_rolling_6h", "AVG", "temperature_2m", 6), ("humidity_rolling_6h", "AVG", "relative_humidity", 6),
        ("precip_rolling_3h", "SUM", "precipitation", 3), ("precip_rolling_6h", "SUM", "precipitation", 6),
        ("precip_rolling_24h", "SUM", "precipitation", 24),
    ]:
        value = sround(f"{agg}({col}) OVER {back(k)}", 3)
        if full:
            value = f"CASE WHEN COUNT({col}) OVER {back(k)} = {k} THEN {value} END"
        parts.append(f" {value} AS {name}")
    return ",\n".join(parts)


CALENDAR_SQL = """
 CAST(hour(observation_time) AS INTEGER) AS hour, CAST(month(observation_time) AS INTEGER) AS month,
 CAST(dayofweek(observation_time) + 1 AS INTEGER) AS weekday"""
CYCLE_SQL = """
 ROUND(SIN(hour(observation_time) * (2 * PI() / 24)), 6) AS hour_sin,
 ROUND(COS(hour(observation_time) * (2 * PI() / 24)), 6) AS hour_cos,
 ROUND(SIN(month(observation_time) * (2 * PI() / 12)), 6) AS month_sin,
 ROUND(COS(month(observation_time) * (2 * PI() / 12)), 6) AS month_cos"""
FLAG_SQL = """
 CASE WHEN month(observation_time) IN (10,11,12,1,2,3) THEN 1 ELSE 0 END AS is_rainy_season,
 CASE WHEN month(observation_time) IN (1,2,12) THEN 1 ELSE 0 END AS is_peak_rain_month,
 CASE WHEN hour(observation_time) BETWEEN 12 AND 18 THEN 1 ELSE 0 END AS is_afternoon"""
EXTRA_SQL = """
 temperature_2m - dew_point_2m AS dewpoint_depression,
 pressure_msl - LAG(pressure_msl, 3) OVER w AS pressure_tend_3h,
 pressure_msl - LAG(pressure_msl, 24) OVER w AS pressure_tend_24h,
 cloud_cover_low - LAG(cloud_cover_low, 1) OVER w AS cloud_low_delta_1h,
 tcwv - LAG(tcwv, 3) OVER w AS tcwv_delta_3h"""
WIND_SQL = """
 SIN(RADIANS(wind_direction_10m)) AS wind_dir_sin, COS(RADIANS(wind_direction_10m)) AS wind_dir_cos"""
TARGET_SQL = """
 LEAD(precipitation, 1) OVER w AS target_rain_next_1h,
 CASE WHEN LEAD(precipitation, 1) OVER w > 0 THEN 1 ELSE 0 END AS target_will_rain"""

FEATURED_SQL = "WITH" + GRID_SQL + f""",
featured AS (
  SELECT *, {LAG_SQL}, {DELTA_SQL}, {rolling_sql()}, {CALENDAR_SQL}, {CYCLE_SQL}, {FLAG_SQL}, {EXTRA_SQL}, {WIND_SQL}, {TARGET_SQL}
  FROM grid {W}),
store AS (
  SELECT station_id, observation_time, {", ".join(ALL_FEATURES)}, target_will_rain, target_rain_next_1h FROM featured
  WHERE temp_lag_24h IS NOT NULL AND precip_lag_24h IS NOT NULL AND target_rain_next_1h IS NOT NULL)"""
ROUNDED = [c for c in ALL_FEATURES if c.startswith("wind_dir")]
STORE_OUT_SQL = "SELECT * REPLACE (" + ", ".join(f"ROUND({c}, 6) AS {c}" for c in ROUNDED) + ") FROM store"


def rounded(df: DataFrame) -> DataFrame:
    """Unrounded trigonometric columns differ in the last bit between math libraries."""
    return df.withColumns({c: F.round(c, 6) for c in ROUNDED if c in df.columns})


@query("WITH" + GRID_SQL + f" SELECT station_id, observation_time, {LAG_SQL} FROM grid {W}")
def features_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = dense_observations(spark, sf_dir, narrow=True)
    return over_blocks(dense, KEY, T, 24, 0, lag_columns).select(*KEY, T, *[c for c in ALL_FEATURES if "_lag_" in c])


@query("WITH" + GRID_SQL + f" SELECT station_id, observation_time, {DELTA_SQL} FROM grid {W}")
def features_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = dense_observations(spark, sf_dir, narrow=True)
    return over_blocks(dense, KEY, T, 1, 0, delta_columns).drop("temperature_2m", "precipitation", "relative_humidity")


@query("WITH" + GRID_SQL + f" SELECT station_id, observation_time, {rolling_sql()} FROM grid")
def features_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing windows that accept gaps."""
    dense = dense_observations(spark, sf_dir, narrow=True)
    return over_blocks(dense, KEY, T, 23, 0, rolling_columns).drop("temperature_2m", "precipitation", "relative_humidity")


@query("WITH" + GRID_SQL + f" SELECT station_id, observation_time, {rolling_sql(full=True)} FROM grid")
def features_rolling_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing windows that need every hour."""
    dense = dense_observations(spark, sf_dir, narrow=True)
    out = over_blocks(dense, KEY, T, 23, 0, lambda w: rolling_columns(w, full_window=True))
    return out.drop("temperature_2m", "precipitation", "relative_humidity")


@query("WITH" + GRID_SQL + f"""
SELECT station_id, observation_time,
  {sround(f"SUM(precipitation) OVER {frame('1 PRECEDING', '1 FOLLOWING')}", 6)} AS precip_centred_3h,
  CASE WHEN COUNT(precipitation) OVER {frame('3 PRECEDING', '3 FOLLOWING')} = 7
       THEN {sround(f"SUM(precipitation) OVER {frame('3 PRECEDING', '3 FOLLOWING')}", 6)} END AS precip_centred_7h
FROM grid""")
def features_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred sums: three hours with gaps allowed, seven hours complete."""
    from rainloom.functions.numeric import stable_round

    dense = dense_observations(spark, sf_dir, narrow=True).select(*KEY, T, "precipitation")
    return over_blocks(dense, KEY, T, 3, 3, lambda w: {
        "precip_centred_3h": stable_round(framed(F.sum, "precipitation", centred(w, 1)), 6),
        "precip_centred_7h": stable_round(framed(F.sum, "precipitation", centred(w, 3), at_least=7), 6),
    }).drop("precipitation")


@query("WITH" + GRID_SQL + f" SELECT station_id, observation_time, {CALENDAR_SQL}, {CYCLE_SQL}, {FLAG_SQL} FROM grid")
def features_cyclic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar parts, circle encodings and flags; no shuffle beyond the grid."""
    calendar = calendar_columns()
    made = calendar | cycle_columns(calendar["hour"], calendar["month"]) | calendar_flags(calendar["month"], calendar["hour"])
    dense = dense_observations(spark, sf_dir, narrow=True)
    return dense.select(*KEY, T, *[c.alias(n) for n, c in made.items()])


@query("WITH" + GRID_SQL + """
SELECT station_id, observation_time, ROUND(SIN(RADIANS(wind_direction_10m)), 6) AS wind_dir_sin,
       ROUND(COS(RADIANS(wind_direction_10m)), 6) AS wind_dir_cos,
       temperature_2m - dew_point_2m AS dewpoint_depression FROM grid""")
def features_wind_dewpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = dense_observations(spark, sf_dir)
    made = wind_columns() | {"dewpoint_depression": F.col("temperature_2m") - F.col("dew_point_2m")}
    return rounded(dense.select(*KEY, T, *[c.alias(n) for n, c in made.items()]))


@query("WITH" + GRID_SQL + f"""
SELECT station_id, observation_time, {TARGET_SQL},
  CASE WHEN LEAD(precipitation, 1) OVER w IS NOT NULL THEN CAST(LEAD(precipitation, 1) OVER w > 0 AS INTEGER) END AS target_known,
  CASE WHEN precipitation IS NOT NULL THEN CAST(precipitation > 0 AS INTEGER) END AS persist
FROM grid {W}""")
def targets_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-hour targets (0 or null where unknown) and the persistence indicator."""
    dense = dense_observations(spark, sf_dir, narrow=True).select(*KEY, T, "precipitation")
    return over_blocks(dense, KEY, T, 0, 1, lambda w: {
        **target_columns(w),
        "target_known": target_columns(w, keep_unknown=True)["target_will_rain"],
        "persist": event(F.col("precipitation")),
    }).drop("precipitation")


@query(FEATURED_SQL + STORE_OUT_SQL)
def feature_store_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features and targets of every station: one windowed pass over time blocks."""
    return rounded(feature_store(dense_observations(spark, sf_dir), KEY))


@query(FEATURED_SQL + STORE_OUT_SQL)
def feature_store_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table built up to a date and then brought up to date from its high-water mark;
    equals the full build."""
    hours = materialize(observations(spark, sf_dir), "hours")
    path = scratch_path(spark, "store")
    update_feature_table(spark, hours.where(F.col(T) <= F.lit("2024-01-18 09:00:00").cast("timestamp_ntz")), path, KEY)
    update_feature_table(spark, hours, path, KEY)
    return rounded(read_evolved(spark, path))


_SHIFT = ", ".join(f"LAG({c}, 1) OVER w AS {c}" for c in BASE_FEATURES)


@query("WITH" + GRID_SQL + f""",
strict AS (SELECT station_id, observation_time, temperature_2m, apparent_temperature, precipitation, relative_humidity, windspeed,
  {LAG_SQL}, {DELTA_SQL}, {rolling_sql(full=True)}, {CALENDAR_SQL}, {CYCLE_SQL}, {FLAG_SQL} FROM grid {W})
SELECT station_id, observation_time, {_SHIFT} FROM strict {W}""")
def forecast_series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vector of hour t-1 offered at hour t, over a forecast series."""
    from rainloom.functions.numeric import stable_round

    out = shifted_features(dense_observations(spark, sf_dir), KEY)
    return out.withColumns({c: stable_round(F.col(c), 3) for c in out.columns if "_rolling_" in c})


@query("WITH" + GRID_SQL + f"""
SELECT station_id, observation_time,
       LAST_VALUE(temperature_2m IGNORE NULLS) OVER {frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS temperature_2m FROM grid""")
def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last known reading carried over gaps of any length, block by block."""
    dense = dense_observations(spark, sf_dir, narrow=True).select(*KEY, T, "temperature_2m")
    return forward_fill(dense, KEY, T, "temperature_2m", block_steps=96)


@query("""
SELECT event_type AS station_id, CAST(COUNT(*) AS BIGINT) AS n,
       ROUND(CAST(COUNT(*) AS DOUBLE) / 8, 0) AS half_up, ROUND_EVEN(CAST(COUNT(*) AS DOUBLE) / 8, 0) AS half_even
FROM events GROUP BY 1""")
def rounding_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-up and half-even rounding of the same values."""
    from rainloom.sources.tables import read_table

    counts = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("station_id")).agg(F.count(F.lit(1)).alias("n"))
    eighth = F.col("n").cast("double") / 8
    return counts.withColumns({"half_up": F.round(eighth, 0), "half_even": round_half_even(eighth, 0)})
