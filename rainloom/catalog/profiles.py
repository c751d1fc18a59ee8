"""Descriptive queries over the feature table and the observation series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import (
    CELLS_SQL, FORECASTS_SQL, GRID_SQL, REGION_DAYS_SQL, SCORED_SQL, dense_observations, forecast_history,
    observations, region_days, scored_labels,
)
from rainloom.catalog.feature_sets import FEATURED_SQL
from rainloom.catalog.registry import query
from rainloom.constants import BASE_FEATURES, MIN_HOURS_PER_MONTH
from rainloom.functions.labels import alert_level
from rainloom.functions.numeric import exact_mean, exact_sum, guarded_corr, share
from rainloom.functions.timeparts import month_floor
from rainloom.operators.features import feature_store
from rainloom.operators.prefix import exact_quantiles, quantile_splits, quantiles_of_counts
from rainloom.operators.profile import (
    agreement, best_per_group, class_balance, column_profile, correlations, event_rate, group_facts, histogram,
    mean_of_group_rates, null_report, rate_table, sum_if_enough, top, volume_ratio, weighted_mean,
)
from rainloom.operators.sketches import quantiles, rolled_up, sketched, within_rank_error
from rainloom.operators.verification import forecast_report, summary_by_alert
from rainloom.session import materialize
from rainloom.sources.tables import read_table

KEY = ["station_id"]
T = "observation_time"


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_store(dense_observations(spark, sf_dir), KEY)


@query(FEATURED_SQL + """
SELECT target_will_rain, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1) AS pct FROM store GROUP BY 1""")
def target_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_balance(store(spark, sf_dir), "target_will_rain")


@query(FEATURED_SQL + "SELECT hour, ROUND(AVG(target_will_rain) * 100, 6) AS rate_pct, COUNT(*) AS n FROM store GROUP BY 1")
def rate_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rate(store(spark, sf_dir), ["hour"], "target_will_rain").withColumn("rate_pct", F.round("rate_pct", 6))


@query("WITH" + REGION_DAYS_SQL + """,
m AS (SELECT month(observation_time) AS month, AVG(CAST(precipitation > 0 AS INTEGER)) * 100 AS rate_pct FROM rd GROUP BY 1)
SELECT ROUND(AVG(rate_pct), 6) AS mean_rate_pct FROM m""")
def mean_monthly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the calendar months of their event rates."""
    days = region_days(spark, sf_dir).withColumn("wet", (F.col("precipitation") > 0).cast("int"))
    rates = event_rate(days, [F.month(T).alias("month")], "wet")
    return mean_of_group_rates(rates).withColumn("mean_rate_pct", F.round("mean_rate_pct", 6))


_PIVOT = ", ".join(f"ROUND(AVG(target_will_rain) FILTER (WHERE weekday = {d}) * 100, 6) AS wd_{d}" for d in range(1, 8))


@query(FEATURED_SQL + f"SELECT hour, {_PIVOT} FROM store GROUP BY 1")
def rate_pivot_hour_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rate_table(store(spark, sf_dir), "hour", "weekday", list(range(1, 8)), "target_will_rain", "wd_")
    return wide.withColumns({f"wd_{d}": F.round(f"wd_{d}", 6) for d in range(1, 8)})


_MONTHS = ", ".join(f"ROUND(AVG(CAST(precipitation > 0 AS INTEGER)) FILTER (WHERE month(observation_time) = {m}) * 100, 6) AS m_{m}" for m in range(1, 13))


@query("WITH" + REGION_DAYS_SQL + f" SELECT station_id, {_MONTHS} FROM rd GROUP BY 1")
def rate_pivot_station_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = region_days(spark, sf_dir).select(
        "station_id", F.month(T).alias("month"), (F.col("precipitation") > 0).cast("int").alias("wet")
    )
    wide = rate_table(days, "station_id", "month", list(range(1, 13)), "wet", "m_")
    return wide.withColumns({f"m_{m}": F.round(f"m_{m}", 6) for m in range(1, 13)})


@query("WITH" + CELLS_SQL + """
SELECT station_id, strftime(observation_time, '%Y-%m-%d') AS ds, CAST(SUM(CAST(precipitation AS DECIMAL(18,9))) AS DOUBLE) AS y,
       MAX(CASE WHEN precipitation > 0 THEN 1 ELSE 0 END) AS teve_chuva FROM cells GROUP BY 1, 2""")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily amount and any-rain flag."""
    hours = observations(spark, sf_dir, narrow=True)
    return hours.groupBy("station_id", F.date_format(T, "yyyy-MM-dd").alias("ds")).agg(
        exact_sum(F.col("precipitation"), 9).alias("y"),
        F.max(F.when(F.col("precipitation") > 0, 1).otherwise(0)).alias("teve_chuva"),
    )


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_history(spark, sf_dir).select(
        F.col("target_time").alias(T), "prob_chuva", "pred_vai_chover"
    ).withColumn("alerta_chuva", alert_level(F.col("prob_chuva")))


_ALERT_SQL = """CASE WHEN prob_chuva >= 0.85 THEN '🔴 CHUVA FORTE' WHEN prob_chuva >= 0.65 THEN '🟠 CHUVA PROVÁVEL'
       WHEN prob_chuva >= 0.40 THEN '🟡 POSSÍVEL CHUVA' ELSE '🟢 SEM CHUVA' END"""


@query("WITH" + FORECASTS_SQL + f"""
SELECT {_ALERT_SQL} AS alerta_chuva, COUNT(*) AS horas,
       ROUND(CAST(SUM(CAST(prob_chuva AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) * 100, 1) AS prob_media_pct,
       strftime(MIN(target_time), '%d/%m %H:%M') AS primeira_hora, strftime(MAX(target_time), '%d/%m %H:%M') AS ultima_hora
FROM fc GROUP BY 1""")
def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast hours per alert level; first and last by time, then formatted."""
    return summary_by_alert(_predictions(spark, sf_dir))


@query("WITH" + FORECASTS_SQL + """
SELECT SUM(pred_vai_chover) AS horas_com_chuva_prevista, COUNT(*) AS total_horas,
       ROUND(CAST(SUM(CAST(prob_chuva AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) * 100, 1) AS prob_media_pct,
       ROUND(MAX(prob_chuva) * 100, 1) AS prob_maxima_pct,
       strftime(MIN(CASE WHEN pred_vai_chover = 1 THEN target_time END), '%H:%M') AS primeira_chuva_prevista FROM fc""")
def forecast_overall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_report(_predictions(spark, sf_dir))


@query("""
SELECT event_type AS station_id, arg_max(user_id, (ts, user_id)) AS user_id, arg_max(value, (ts, value)) AS value,
       MAX(ts) AS last_time FROM events GROUP BY 1""")
def station_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as of the newest row of each station."""
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("station_id"), "ts", "user_id", "value")
    return group_facts(rows, "station_id", "ts", ["user_id", "value"])


@query("WITH" + GRID_SQL + f"""
SELECT station_id, strftime(observation_time, '%Y-%m') AS month, COUNT(temperature_2m) AS known,
       CASE WHEN COUNT(temperature_2m) >= {MIN_HOURS_PER_MONTH}
            THEN CAST(SUM(CAST(precipitation AS DECIMAL(18,9))) AS DOUBLE) END AS total FROM grid GROUP BY 1, 2""")
def monthly_min_count_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals, null for months with too few hours."""
    dense = dense_observations(spark, sf_dir, narrow=True).withColumn("p", F.col("precipitation").cast("decimal(18,9)"))
    total = sum_if_enough("p", MIN_HOURS_PER_MONTH).cast("double")
    return dense.groupBy("station_id", F.date_format(T, "yyyy-MM").alias("month")).agg(
        F.count("temperature_2m").alias("known"), total.alias("total")
    )


@query("""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS date,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice) AS chuva,
       COUNT(o_totalprice) AS postos
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-06-01 00:00:00'
  AND o_totalprice IS NOT NULL GROUP BY 1""")
def gauge_mean_with_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the listed gauges and how many took part."""
    rows = read_table(spark, sf_dir, "orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & (F.col("o_orderdate") >= F.lit("1996-06-01").cast("timestamp_ntz")) & F.col("o_totalprice").isNotNull()
    )
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(
        exact_mean(F.col("o_totalprice")).alias("chuva"),
        F.count("o_totalprice").alias("postos"),
    )


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(*) - COUNT({c}) AS nulls, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std, "
    f"ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS min, ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS max FROM featured" for c in BASE_FEATURES
)


@query(FEATURED_SQL + _PROFILE)
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, mean, deviation, minimum and maximum of every feature in one job."""
    from rainloom.operators.features import add_features

    out = column_profile(add_features(dense_observations(spark, sf_dir), KEY), BASE_FEATURES)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "min", "max")})


_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(*) - COUNT({c}) AS nulls, ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 1) AS pct FROM featured"
    for c in BASE_FEATURES
)


@query(FEATURED_SQL + f"SELECT * FROM ({_NULLS}) WHERE nulls > 0 ORDER BY nulls DESC, feature LIMIT 10")
def feature_null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rainloom.operators.features import add_features

    return null_report(add_features(dense_observations(spark, sf_dir), KEY), BASE_FEATURES)


_CORR_FEATURES = [
    "temperature_2m", "relative_humidity", "windspeed", "precip_lag_1h", "precip_lag_3h", "precip_rolling_6h",
    "humidity_lag_1h", "temp_delta_1h", "humidity_delta_1h", "is_rainy_season", "is_afternoon",
]
_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN STDDEV_POP({c}) > 1e-12 THEN ROUND(CORR({c}, target_will_rain), 6) END AS corr FROM store"
    for c in _CORR_FEATURES
)


@query(FEATURED_SQL + _CORR)
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of features with the target; null for constants."""
    out = correlations(store(spark, sf_dir), _CORR_FEATURES, "target_will_rain").withColumn("corr", F.round("corr", 6))
    return out.orderBy("corr")


@query("WITH" + CELLS_SQL + """,
v AS (SELECT temperature_2m AS x FROM cells WHERE temperature_2m > 55),
e AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM v)
SELECT CAST(LEAST(FLOOR((x - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, COUNT(*) AS n FROM v, e GROUP BY 1""")
def histogram_wet(spark: SparkSession, sf_dir: str) -> DataFrame:
    wet = observations(spark, sf_dir, narrow=True).where("temperature_2m > 55")
    return histogram(wet, "temperature_2m", 50).select("bin", "n")


@query("WITH" + CELLS_SQL + """,
v AS (SELECT station_id, precipitation AS x FROM cells WHERE precipitation > 0)
SELECT station_id, p, ROUND(CASE p WHEN 0.25 THEN quantile_cont(x, 0.25) WHEN 0.5 THEN quantile_cont(x, 0.5) ELSE quantile_cont(x, 0.75) END, 6) AS quantile
FROM v, (SELECT UNNEST([0.25, 0.5, 0.75]::DOUBLE[]) AS p) GROUP BY station_id, p""")
def quantiles_wet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of wet hours without sorting a station in one task."""
    wet = observations(spark, sf_dir, narrow=True).where("precipitation > 0").select("station_id", "precipitation")
    return exact_quantiles(wet, KEY, "precipitation", [0.25, 0.5, 0.75]).withColumn("quantile", F.round("quantile", 6))


@query("""
SELECT l_returnflag, ROUND(CAST(median(CAST(l_extendedprice AS DOUBLE)) AS DOUBLE), 4) AS median,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mean FROM lineitem GROUP BY 1""")
def mean_and_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    counts = materialize(rows.groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("n")), "counts")
    medians = quantiles_of_counts(counts, ["l_returnflag"], "l_extendedprice", [0.5], quantile_splits(counts, "l_extendedprice"))
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("n")).cast("double")
    means = counts.groupBy("l_returnflag").agg((total / F.sum("n")).alias("mean"))
    return means.join(medians, "l_returnflag").select("l_returnflag", F.round("quantile", 4).alias("median"), "mean")


@query("""
SELECT g, p, ROUND(CASE p WHEN 0.1 THEN quantile_cont(x, 0.1) ELSE quantile_cont(x, 0.9) END, 6) AS quantile
FROM (SELECT NULLIF(l_returnflag, 'N') AS g, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem),
     (SELECT UNNEST([0.1, 0.9]::DOUBLE[]) AS p) GROUP BY g, p""")
def quantiles_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of more distinct values than a slice holds, one group being null."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("g"), F.col("l_extendedprice").cast("double").alias("x"))
    return exact_quantiles(rows, ["g"], "x", [0.1, 0.9]).withColumn("quantile", F.round("quantile", 6))


@query("WITH" + SCORED_SQL + """
SELECT lang, ROUND(AVG(CAST(quality = toxic AS INTEGER)), 6) AS agreement, COUNT(*) AS n FROM sl GROUP BY 1""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of equal labels from two sources."""
    return scored_labels(spark, sf_dir).groupBy("lang").agg(
        F.round(agreement("quality", "toxic"), 6).alias("agreement"), F.count(F.lit(1)).alias("n")
    )


@query("WITH" + SCORED_SQL + """,
g AS (SELECT lang, ROUND(AVG(quality), 6) AS f, COUNT(*) AS n FROM sl GROUP BY 1)
SELECT ROUND(SUM(f * n) / SUM(n), 6) AS f_weighted, SUM(n) AS n FROM g""")
def weighted_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of group metrics weighted by group size."""
    groups = scored_labels(spark, sf_dir).groupBy("lang").agg(
        F.round(F.avg("quality"), 6).alias("f"), F.count(F.lit(1)).alias("n")
    )
    return groups.agg(F.round(weighted_mean("f", "n"), 6).alias("f_weighted"), F.sum("n").alias("n"))


@query("WITH" + REGION_DAYS_SQL + """
SELECT station_id, ROUND(CAST(SUM(CAST(precipitation AS DECIMAL(18,6))) AS DOUBLE) / CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE), 9) AS ratio,
       ROUND(AVG(CAST(precipitation >= 1.0 AS INTEGER)), 6) AS freq_1mm,
       ROUND(AVG(CAST(precipitation > 0 AS INTEGER)), 6) AS freq_above_0, COUNT(*) AS n FROM rd GROUP BY 1""")
def volume_and_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume ratio of two series and wet-day shares at two limits."""
    days = region_days(spark, sf_dir).withColumns({
        "p": F.col("precipitation").cast("decimal(18,6)"), "q": F.col("total").cast("decimal(18,2)")
    })
    return days.groupBy("station_id").agg(
        F.round(volume_ratio("p", "q"), 9).alias("ratio"),
        F.round(share(F.col("precipitation") >= 1.0), 6).alias("freq_1mm"),
        F.round(share(F.col("precipitation") > 0), 6).alias("freq_above_0"), F.count(F.lit(1)).alias("n"),
    )


@query("WITH" + REGION_DAYS_SQL + """
SELECT station_id, COUNT(*) AS size, ROUND(AVG(CAST(precipitation > 0 AS INTEGER)), 3) AS mean, MIN(n_orders) AS first_n FROM rd GROUP BY 1""")
def group_size_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = region_days(spark, sf_dir)
    return days.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("size"), F.round(share(F.col("precipitation") > 0), 3).alias("mean"),
        F.min("n_orders").alias("first_n"),
    )


@query("""
SELECT event_type AS station_id, MIN(ts) AS first_time, MAX(ts) AS last_time, COUNT(*) AS n,
       array_to_string(list_sort(list(DISTINCT user_id % 5)), ',') AS points FROM events GROUP BY 1""")
def date_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time, rows and the sorted set of points per source."""
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("station_id"), "ts", (F.col("user_id") % 5).alias("point"))
    points = F.array_join(F.transform(F.sort_array(F.collect_set("point")), lambda p: p.cast("string")), ",")
    return rows.groupBy("station_id").agg(
        F.min("ts").alias("first_time"), F.max("ts").alias("last_time"), F.count(F.lit(1)).alias("n"), points.alias("points")
    )


@query("WITH" + REGION_DAYS_SQL + """,
m AS (SELECT station_id, date_trunc('month', observation_time) AS mon, CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS a,
             CAST(SUM(n_orders) AS DOUBLE) AS b FROM rd GROUP BY 1, 2 HAVING COUNT(*) >= 20)
SELECT station_id, CASE WHEN COUNT(*) > 6 THEN ROUND(CORR(a, b), 6) END AS corr_mensal,
       ROUND(SUM(b) / SUM(a) * 1000000 - 1, 6) AS vies_volume, COUNT(*) AS months FROM m GROUP BY 1""")
def monthly_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and volume bias of monthly totals over months with enough days."""
    days = region_days(spark, sf_dir).withColumns({
        "total": F.col("total").cast("decimal(18,2)"), "n_orders": F.col("n_orders").cast("double")
    })
    monthly = days.groupBy("station_id", month_floor(F.col(T)).alias("mon")).agg(
        sum_if_enough("total", 20).cast("double").alias("a"), sum_if_enough("n_orders", 20).alias("b")
    ).dropna()
    return monthly.groupBy("station_id").agg(
        F.round(F.when(F.count(F.lit(1)) > 6, guarded_corr(F.col("a"), F.col("b"))), 6).alias("corr_mensal"),
        F.round(F.try_divide(F.sum("b"), F.sum("a")) * 1000000 - 1, 6).alias("vies_volume"),
        F.count(F.lit(1)).alias("months"),
    )


@query("WITH" + REGION_DAYS_SQL + """,
m AS (SELECT station_id, CAST(month(observation_time) AS INTEGER) AS month, ROUND(AVG(CAST(precipitation > 0 AS INTEGER)), 2) AS rate FROM rd GROUP BY 1, 2)
SELECT station_id, month, rate FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY rate DESC, month) AS rn FROM m) WHERE rn = 1""")
def argmax_first_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month with the highest rate per station; the first of equals wins."""
    rates = region_days(spark, sf_dir).groupBy("station_id", F.month(T).alias("month")).agg(
        F.round(share(F.col("precipitation") > 0), 2).alias("rate")
    )
    return best_per_group(rates, ["station_id"], "rate", [F.col("month")])


@query("""
SELECT l_suppkey, ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 15""")
def top_k_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.round(exact_sum(F.col("l_extendedprice")), 2).alias("total")
    )
    return top(totals, 15, F.desc("total"), F.asc("l_suppkey"))


@query("""
SELECT event_type AS station_id, share, n, days, TRUE AS within FROM (
  SELECT event_type, COUNT(value) AS n, COUNT(DISTINCT CAST(ts AS DATE)) FILTER (WHERE value IS NOT NULL) AS days FROM events GROUP BY 1),
  (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) AS s(share)""")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile sketches stored per station and day, merged per station; their ranks against all rows."""
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("station_id"), "ts", "value")
    stored = materialize(sketched(rows, ["station_id"], "ts", "value"), "sketches")
    estimates = quantiles(rolled_up(stored, ["station_id"]), ["station_id"], [0.1, 0.5, 0.9, 0.99])
    # the sketches' choices are random, so only what holds for all of them is shown
    return within_rank_error(materialize(estimates, "estimates"), rows, ["station_id"], "value").select("station_id", "share", "n", "days", "within")
