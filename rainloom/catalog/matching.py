"""Joins: alignment, as-of matching, lags, calendars and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import (
    CELLS_SQL, FORECASTS_SQL, GRID_SQL, REGION_DAYS_SQL, daily_truth, dense_observations, forecast_history,
    observations, region_days,
)
from rainloom.catalog.registry import query
from rainloom.constants import LEAD_RANGES, LEAD_REST, OUTCOME_LABELS
from rainloom.functions.labels import event
from rainloom.functions.numeric import exact_sum, guarded_corr, ratio, share
from rainloom.functions.timeparts import month_floor
from rainloom.operators.joins import (
    align, all_but_own, attach, common_keys, gauge_days, monthly_index_filled, only_common, with_monthly_index,
)
from rainloom.operators.profile import best_per_group
from rainloom.operators.verification import (
    accuracy_by_lead, accuracy_hourly, contingency, lag_scores, latest_before_target, shifted_join,
)
from rainloom.plans.views import HOURLY, create_views, external_table
from rainloom.session import scratch_path
from rainloom.sinks.tables import register_view
from rainloom.sources.tables import from_sql, read_table

KEY = ["station_id"]
T = "observation_time"
COUNT = lambda: F.count(F.lit(1))


def _cells(spark, sf_dir, station, value, name):
    return observations(spark, sf_dir).where(F.col("station_id") == station).select(T, F.col(value).alias(name))


@query("WITH" + CELLS_SQL + """
SELECT a.observation_time, a.temperature_2m AS temp_a, b.temperature_2m AS temp_b
FROM cells a JOIN cells b ON a.observation_time = b.observation_time AND a.station_id = 'click' AND b.station_id = 'view'""")
def join_on_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series on their common hours."""
    left = _cells(spark, sf_dir, "click", "temperature_2m", "temp_a")
    return left.join(_cells(spark, sf_dir, "view", "temperature_2m", "temp_b"), T)


@query("WITH" + CELLS_SQL + """,
obs AS (SELECT o_orderdate AS d, COUNT(*) AS n_orders FROM orders GROUP BY 1)
SELECT station_id, observation_time, n_orders FROM (
  SELECT event_type AS station_id, date_trunc('hour', ts) AS observation_time, CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 8766 HOUR * 4 AS d
  FROM events GROUP BY ALL) LEFT JOIN obs USING (d)""")
def join_left_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with a daily value attached where there is one (four years earlier)."""
    daily = (
        read_table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").alias("d")).agg(COUNT().alias("n_orders"))
    )
    hours = observations(spark, sf_dir, narrow=True).select("station_id", T).withColumn(
        "d", F.to_date(T).cast("timestamp_ntz") - F.expr("INTERVAL 35064 HOURS")
    )
    return attach(hours, daily, ["d"]).drop("d")


@query("WITH" + CELLS_SQL + """,
u AS (SELECT event_type AS station_id, date_trunc('hour', ts) AS observation_time, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1, 2)
SELECT station_id, observation_time, temperature_2m, users FROM cells JOIN u USING (station_id, observation_time)""")
def join_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rainloom.functions.timeparts import hour_floor

    users = (
        read_table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("station_id"), hour_floor(F.col("ts")).alias(T))
        .agg(F.count_distinct("user_id").alias("users"))
    )
    cells = observations(spark, sf_dir).select("station_id", T, "temperature_2m")
    return cells.join(users, ["station_id", T])


@query("WITH" + GRID_SQL + """,
lab AS (SELECT event_type AS station_id, date_trunc('hour', ts) AS observation_time, COUNT(*) FILTER (WHERE value > 150) AS big FROM events GROUP BY 1, 2)
SELECT station_id, observation_time, big FROM frame LEFT JOIN lab USING (station_id, observation_time)""")
def label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station labels on the feature grid, null where there is none."""
    from rainloom.functions.timeparts import hour_floor

    labels = (
        read_table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("station_id"), hour_floor(F.col("ts")).alias(T)).agg(F.count_if(F.col("value") > 150).alias("big"))
    )
    return attach(dense_observations(spark, sf_dir, narrow=True).select("station_id", T), labels, ["station_id", T])


@query("WITH" + CELLS_SQL + """
SELECT a.observation_time, a.temperature_2m AS a, b.temperature_2m AS b, c.temperature_2m AS c
FROM (SELECT * FROM cells WHERE station_id = 'click') a JOIN (SELECT * FROM cells WHERE station_id = 'view') b USING (observation_time)
JOIN (SELECT * FROM cells WHERE station_id = 'error') c USING (observation_time)
WHERE a.temperature_2m IS NOT NULL AND b.temperature_2m IS NOT NULL AND c.temperature_2m IS NOT NULL""")
def align_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three series on the hours all of them have."""
    series = {n: _cells(spark, sf_dir, s, "temperature_2m", "v") for n, s in (("a", "click"), ("b", "view"), ("c", "error"))}
    return align(series, [T])


@query("""
SELECT DISTINCT date_trunc('day', ts) AS day, user_id FROM events WHERE event_type = 'purchase'
INTERSECT SELECT date_trunc('day', ts), user_id FROM events WHERE event_type = 'signup'""")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.to_date("ts").cast("timestamp_ntz").alias("day"), "user_id", "event_type")
    return common_keys(rows.where("event_type = 'purchase'"), rows.where("event_type = 'signup'"), ["day", "user_id"])


@query("""
SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def semi_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read_table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return only_common(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), big, ["c_custkey"])


@query("WITH" + FORECASTS_SQL + """
SELECT station_id, target_time, inferencia_local, prob_chuva, l_orderkey, l_linenumber FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id, target_time ORDER BY inferencia_local DESC, l_orderkey DESC, l_linenumber DESC, prob_chuva DESC) AS rn
  FROM fc WHERE inferencia_local < target_time) WHERE rn = 1""")
def latest_before_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of match: the last forecast issued before its target. Line numbers repeat within an
    order, so the probability completes the order."""
    history = forecast_history(spark, sf_dir).drop("pred_vai_chover", "api_precip_alvo", "threshold_usado", "modelo")
    return latest_before_target(history, ["station_id"], ["l_orderkey", "l_linenumber", "prob_chuva"])


_OUTCOME_SQL = " ".join(f"WHEN choveu = {t} AND pred_vai_chover = {p} THEN '{name}'" for (t, p), name in OUTCOME_LABELS.items())
_HOURLY_SQL = "WITH" + FORECASTS_SQL + f""",
u AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id, target_time ORDER BY inferencia_local DESC, l_orderkey DESC, l_linenumber DESC, prob_chuva DESC, api_precip_alvo DESC) AS rn
      FROM fc WHERE inferencia_local < target_time),
v AS (SELECT station_id, target_time, inferencia_local, ROUND(prob_chuva, 3) AS prob_chuva, pred_vai_chover, threshold_usado, modelo, api_precip_alvo,
       CAST(api_precip_alvo > 0 AS INTEGER) AS api_vai_chover, precipitation AS chuva_real_mm, CAST(precipitation > 0 AS INTEGER) AS choveu
FROM u JOIN truth ON observation_time = target_time AND observation_time <= TIMESTAMP '2001-06-30 00:00:00' WHERE rn = 1)
SELECT *, CASE {_OUTCOME_SQL} END AS resultado_classificacao FROM v"""
_AS_OF = "2001-06-30 00:00:00"
_TIES = ["l_orderkey", "l_linenumber", "prob_chuva", "api_precip_alvo"]


@query(_HOURLY_SQL)
def accuracy_hourly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last forecast before each target against the observation, with outcome labels."""
    as_of = F.lit(_AS_OF).cast("timestamp_ntz")
    return accuracy_hourly(
        forecast_history(spark, sf_dir), daily_truth(spark, sf_dir), ["station_id"], _TIES, as_of=as_of
    ).drop("l_orderkey", "l_linenumber")


@query(_HOURLY_SQL)
def persistent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verification views by name, replaced in place and read by another session of the catalog."""
    names = {}
    for kind, rows in (("history", forecast_history(spark, sf_dir)), ("truth", daily_truth(spark, sf_dir))):
        path = scratch_path(spark, kind)
        names[kind] = path.rsplit("/", 1)[-1].replace("-", "_")
        external_table(rows, names[kind], path)
    for as_of in ("1990-01-01 00:00:00", _AS_OF):  # the second call replaces the views of the first
        create_views(spark, names["history"], names["truth"], ["station_id"], _TIES, f"TIMESTAMP_NTZ '{as_of}'")
    return spark.newSession().table(HOURLY)


_RANGE_SQL = lambda seconds: "CASE " + " ".join(f"WHEN {seconds} <= {h * 3600} THEN '{n}'" for h, n in LEAD_RANGES) + f" ELSE '{LEAD_REST}' END"
_lead_sql = lambda known: "WITH" + FORECASTS_SQL + f""",
lead AS (
  SELECT l_orderkey, l_linenumber, station_id, target_time, inferencia_local, modelo, ROUND(prob_chuva, 3) AS prob_chuva, pred_vai_chover, api_precip_alvo,
    CAST(CEIL((epoch(target_time) - epoch(inferencia_local)) / 3600) AS INTEGER) AS antecedencia_h,
    {_RANGE_SQL("epoch(target_time) - epoch(inferencia_local)")} AS faixa_antecedencia,
    CAST(api_precip_alvo > 0 AS INTEGER) AS api_vai_chover, precipitation AS chuva_real_mm, CAST(precipitation > 0 AS INTEGER) AS choveu
  FROM fc JOIN truth ON observation_time = target_time{known} WHERE inferencia_local < target_time)"""
_LEAD_SQL = _lead_sql(f" AND observation_time <= TIMESTAMP '{_AS_OF}'")
_ALL_LEAD_SQL = _lead_sql("")


def forecasts_by_lead(spark: SparkSession, sf_dir: str, as_of: Column | None = None) -> DataFrame:
    history = forecast_history(spark, sf_dir).drop("threshold_usado")
    return accuracy_by_lead(history, daily_truth(spark, sf_dir), as_of=as_of)


@query(_LEAD_SQL + " SELECT * FROM lead")
def accuracy_by_lead_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every forecast against the observation, with its lead time."""
    return forecasts_by_lead(spark, sf_dir, F.lit(_AS_OF).cast("timestamp_ntz"))


@query("""
WITH f AS (SELECT event_id, ts AS target, date_trunc('day', ts) AS issued FROM events)
SELECT event_id, CAST(CEIL((epoch(date_trunc('second', target)) - epoch(issued)) / 3600) AS INTEGER) AS antecedencia_h,
  """ + _RANGE_SQL("epoch(date_trunc('second', target)) - epoch(issued)") + """ AS faixa_antecedencia
FROM f""")
def lead_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead hours and ranges within a day."""
    from rainloom.functions.timeparts import day_start, lead_hours, lead_range

    rows = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("t"))
    issued = day_start(F.col("t"))
    return rows.select(
        "event_id", lead_hours(F.col("t"), issued).alias("antecedencia_h"),
        lead_range(F.col("t"), issued).alias("faixa_antecedencia"),
    )


_NAIVE_SQL = "WITH" + GRID_SQL + """,
n AS (SELECT station_id, CAST(precipitation > 0 AS INTEGER) AS persist,
             CAST(LEAD(precipitation) OVER (PARTITION BY station_id ORDER BY observation_time) > 0 AS INTEGER) AS y FROM grid),
k AS (SELECT * FROM n WHERE persist IS NOT NULL AND y IS NOT NULL)"""


@query(_NAIVE_SQL + """
SELECT a.station_id, COUNT(*) AS n, SUM(y) AS positives, ROUND(AVG(y), 6) AS rate,
       SUM(CASE WHEN persist = 1 AND y = 1 THEN 1 ELSE 0 END) AS vp
FROM (SELECT DISTINCT station_id FROM k) a JOIN k ON a.station_id <> k.station_id GROUP BY 1""")
def leave_one_out_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each station the event rate and hits of all the others, by subtraction."""
    from rainloom.operators.blocks import over_blocks

    dense = dense_observations(spark, sf_dir, narrow=True).select(*KEY, T, "precipitation")
    rows = over_blocks(dense, KEY, T, 0, 1, lambda w: {
        "y": event(F.lead("precipitation", 1).over(w)), "persist": event(F.col("precipitation")),
    }).dropna(subset=["y", "persist"])
    totals = rows.groupBy("station_id").agg(
        COUNT().alias("n"), F.sum("y").alias("positives"), F.count_if((F.col("persist") == 1) & (F.col("y") == 1)).alias("vp")
    )
    others = all_but_own(totals, "station_id", ["n", "positives", "vp"])
    return others.withColumn("rate", F.round(ratio(F.col("positives"), F.col("n")), 6))


@query("WITH" + REGION_DAYS_SQL + """,
idx AS (SELECT date_trunc('month', observation_time) AS mes, CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS oni FROM rd
        WHERE month(observation_time) % 2 = 1 GROUP BY 1),
cal AS (SELECT UNNEST(generate_series((SELECT MIN(mes) FROM idx), TIMESTAMP '2001-12-01 00:00:00', INTERVAL 1 MONTH)) AS mes),
f AS (SELECT mes, LAST_VALUE(oni IGNORE NULLS) OVER (ORDER BY mes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS oni FROM cal LEFT JOIN idx USING (mes))
SELECT station_id, observation_time, ROUND(oni, 2) AS oni FROM rd LEFT JOIN f ON date_trunc('month', observation_time) = mes""")
def calendar_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly index with gaps, carried forward and attached to daily rows."""
    days = region_days(spark, sf_dir)
    index = (
        days.where(F.month(T) % 2 == 1).groupBy(month_floor(F.col(T)).alias("mes"))
        .agg(F.sum(F.col("total").cast("decimal(18,2)")).cast("double").alias("oni"))
    )
    filled = monthly_index_filled(index, "mes", "oni", F.lit("2001-12-01").cast("date"))
    return with_monthly_index(days.select("station_id", T), filled, "mes").select("station_id", T, F.round("oni", 2).alias("oni"))


_LAG_SQL = "WITH" + CELLS_SQL + """,
a AS (SELECT station_id, observation_time, precipitation AS obs FROM cells WHERE precipitation IS NOT NULL),
b AS (SELECT station_id, observation_time, temperature_2m - 40 AS est FROM cells),
j AS (SELECT l AS defasagem_h, obs, est FROM (SELECT UNNEST([-2, -1, 0, 1, 2]) AS l), a JOIN b USING (station_id)
      WHERE a.observation_time = b.observation_time + l * INTERVAL 1 HOUR),
s AS (SELECT defasagem_h, COUNT(*) AS horas, ROUND(CORR(obs, est), 6) AS corr,
             ROUND(COALESCE(2 * SUM(CAST(obs >= 0.2 AND est >= 0.2 AS INTEGER))
                   / NULLIF(CAST(SUM(CAST(obs >= 0.2 AS INTEGER)) + SUM(CAST(est >= 0.2 AS INTEGER)) AS DOUBLE), 0), 0), 6) AS f1
      FROM j GROUP BY 1)"""


def _lags(spark, sf_dir):
    cells = observations(spark, sf_dir, narrow=True)
    series = cells.select("station_id", T, F.col("precipitation").alias("obs"))
    other = cells.select("station_id", T, (F.col("temperature_2m") - 40).alias("est"))
    scores = lag_scores(shifted_join(series, other, KEY, [-2, -1, 0, 1, 2]), "obs", "est", 0.2)
    return scores.withColumns({"corr": F.round("corr", 6), "f1": F.round("f1", 6)})


@query(_LAG_SQL + " SELECT * FROM s")
def shifted_join_lag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and F1 at lags of -2 to +2 hours."""
    return _lags(spark, sf_dir)


@query(_LAG_SQL + " SELECT defasagem_h, horas, corr, f1 FROM s ORDER BY corr DESC, defasagem_h LIMIT 1")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_per_group(_lags(spark, sf_dir), [], "corr", [F.col("defasagem_h")])


_DAY_SQL = "WITH" + CELLS_SQL + """,
h AS (SELECT observation_time, CAST(SUM(CAST(precipitation AS DECIMAL(18,6))) AS DOUBLE) AS rain FROM cells GROUP BY 1),
d AS (SELECT s AS desloc, CAST(observation_time - INTERVAL 7 HOUR AS DATE) + CAST(1 - s AS INTEGER) AS date,
             CASE WHEN COUNT(rain) >= 20 THEN CAST(SUM(CAST(rain AS DECIMAL(18,6))) AS DOUBLE) END AS total
      FROM h, (SELECT UNNEST([0, 1]) AS s) GROUP BY 1, 2)"""


def _hourly_rain(spark, sf_dir):
    return observations(spark, sf_dir, narrow=True).groupBy(T).agg(
        exact_sum(F.col("precipitation"), 6).cast("decimal(18,6)").alias("rain")
    )


@query(_DAY_SQL + " SELECT desloc, strftime(date, '%Y-%m-%d') AS date, ROUND(total, 4) AS total FROM d")
def day_boundary_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums from 07 h to 06 h under both day conventions."""
    days = gauge_days(_hourly_rain(spark, sf_dir), [], "rain", 7, [0, 1], 20)
    return days.select("desloc", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round(F.col("rain").cast("double"), 4).alias("total"))


_CONV_SQL = _DAY_SQL + """,
g AS (SELECT CAST(ts AS DATE) AS date, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS ana FROM events GROUP BY 1),
j AS (SELECT desloc, ana, total FROM d JOIN g USING (date) WHERE total IS NOT NULL)"""


@query(_CONV_SQL + """
SELECT desloc, ROUND(CORR(ana, total), 6) AS corr, COUNT(*) AS dias, ROUND(SUM(total) / SUM(ana), 6) AS razao,
       ROUND(AVG(CAST(total >= 1.0 AS INTEGER)), 6) AS freq FROM j GROUP BY 1 QUALIFY ROW_NUMBER() OVER (ORDER BY ROUND(CORR(ana, total), 6) DESC, desloc) = 1""")
def best_day_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day convention that fits the gauges best, with its daily scores."""
    gauges = read_table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(
        (exact_sum(F.col("value")) / F.count("value")).alias("ana")
    )
    days = gauge_days(_hourly_rain(spark, sf_dir), [], "rain", 7, [0, 1], 20).withColumn("rain", F.col("rain").cast("double"))
    pairs = days.join(gauges, "date").dropna(subset=["rain"])
    scores = pairs.groupBy("desloc").agg(
        F.round(guarded_corr(F.col("ana"), F.col("rain")), 6).alias("corr"), COUNT().alias("dias"),
        F.round(ratio(F.sum("rain"), F.sum("ana")), 6).alias("razao"), F.round(share(F.col("rain") >= 1.0), 6).alias("freq"),
    )
    return best_per_group(scores, [], "corr", [F.col("desloc")])


_CONT_SQL = "WITH" + CELLS_SQL + """,
a AS (SELECT observation_time, station_id, precipitation AS om, relative_humidity / 20 AS inmet FROM cells),
t AS (SELECT station_id, lim AS limiar_mm, CASE WHEN lim > 0 THEN om >= lim ELSE om > 0 END AS x, CASE WHEN lim > 0 THEN inmet >= lim ELSE inmet > 0 END AS y
      FROM a, (SELECT UNNEST([0.0, 0.5, 1.0]::DOUBLE[]) AS lim) WHERE om IS NOT NULL AND inmet IS NOT NULL),
c AS (SELECT station_id, limiar_mm, COUNT(*) AS horas, SUM(CAST(x AND y AS INTEGER)) AS vp, SUM(CAST(x AND NOT y AS INTEGER)) AS fp,
             SUM(CAST(NOT x AND y AS INTEGER)) AS fn, SUM(CAST(NOT x AND NOT y AS INTEGER)) AS vn FROM t GROUP BY 1, 2)
SELECT *, ROUND((vp + fp) / CAST(horas AS DOUBLE), 6) AS freq_om, ROUND((vp + fn) / CAST(horas AS DOUBLE), 6) AS freq_inmet,
       ROUND(vp / CAST(GREATEST(vp + fn, 1) AS DOUBLE), 6) AS pod, ROUND(fp / CAST(GREATEST(vp + fp, 1) AS DOUBLE), 6) AS far,
       ROUND(vp / CAST(GREATEST(vp + fp + fn, 1) AS DOUBLE), 6) AS csi, ROUND((vp + fp) / CAST(GREATEST(vp + fn, 1) AS DOUBLE), 6) AS vies_freq FROM c"""


@query(_CONT_SQL)
def contingency_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, false alarms, success index and bias at 0, 0.5 and 1 mm."""
    pairs = observations(spark, sf_dir, narrow=True).select(
        "station_id", F.col("precipitation").alias("om"), (F.col("relative_humidity") / 20).alias("inmet")
    )
    out = contingency(pairs, KEY, "om", "inmet", [0.0, 0.5, 1.0])
    return out.withColumns({c: F.round(c, 6) for c in ("freq_om", "freq_inmet", "pod", "far", "csi", "vies_freq")})


@query("WITH" + CELLS_SQL + """,
a AS (SELECT observation_time, precipitation AS x FROM cells WHERE station_id = 'click'),
b AS (SELECT observation_time, precipitation AS y FROM cells WHERE station_id = 'view'),
j AS (SELECT * FROM a JOIN b USING (observation_time)),
w AS (SELECT * FROM j WHERE observation_time >= (SELECT MAX(observation_time) FROM j) - INTERVAL 12 MONTH)
SELECT 'horas_chuva_frac_12m' AS metrica, 'click' AS fonte, ROUND(AVG(CAST(x >= 0.2 AS INTEGER)), 6) AS valor, COUNT(*) AS n FROM w
UNION ALL SELECT 'horas_chuva_frac_12m', 'view', ROUND(AVG(CAST(y >= 0.2 AS INTEGER)), 6), COUNT(*) FROM w
UNION ALL SELECT 'horas_chuva_frac_12m_maior_que_0', 'view', ROUND(AVG(CAST(y > 0 AS INTEGER)), 6), COUNT(*) FROM w""")
def wet_hour_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of wet hours by source on common hours of the last 12 months, as long metrics."""
    both = align({
        "click": _cells(spark, sf_dir, "click", "precipitation", "v"), "view": _cells(spark, sf_dir, "view", "precipitation", "v"),
    }, [T])
    recent = both.where(F.col(T) >= both.agg(F.max(T)).scalar() - F.expr("INTERVAL 12 MONTHS"))
    entry = lambda m, s, c: F.struct(F.lit(m).alias("metrica"), F.lit(s).alias("fonte"), F.round(share(c), 6).alias("valor"), COUNT().alias("n"))
    return recent.agg(F.array(
        entry("horas_chuva_frac_12m", "click", F.col("click") >= 0.2), entry("horas_chuva_frac_12m", "view", F.col("view") >= 0.2),
        entry("horas_chuva_frac_12m_maior_que_0", "view", F.col("view") > 0),
    ).alias("_all")).select(F.inline("_all"))


@query("""
SELECT 'observed' AS origin, event_id, value, NULL AS weekday FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
UNION ALL SELECT 'forecast', event_id, NULL, CAST(dayofweek(ts) + 1 AS INTEGER) FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'""")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and forecast with different columns stacked by name."""
    rows = read_table(spark, sf_dir, "events")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    observed = rows.where(F.col("ts") < cut).select(F.lit("observed").alias("origin"), "event_id", "value")
    forecast = rows.where(F.col("ts") >= cut).select(F.lit("forecast").alias("origin"), "event_id", F.dayofweek("ts").alias("weekday"))
    return observed.unionByName(forecast, allowMissingColumns=True)


@query("""
SELECT event_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'
UNION ALL SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context and new rows with the same columns in another order."""
    rows = read_table(spark, sf_dir, "events")
    cut = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    context = rows.where(F.col("ts") < cut).select("event_id", "event_type", "value")
    return context.unionByName(rows.where(F.col("ts") >= cut).select("value", "event_id", "event_type"))


@query("""
SELECT event_id, ts, user_id, value FROM events""")
def projection_minus_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT * EXCEPT (event_type, props) FROM {events}", events=read_table(spark, sf_dir, "events"))


@query(_ALL_LEAD_SQL + """
SELECT faixa_antecedencia, COUNT(*) AS n, SUM(CAST(choveu = pred_vai_chover AS INTEGER)) AS acertos FROM lead GROUP BY 1""")
def sql_over_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verification result of all observed hours as a view, queried in SQL."""
    register_view(forecasts_by_lead(spark, sf_dir), "rain_model_accuracy_by_lead")
    return from_sql(spark, """
        SELECT faixa_antecedencia, count(*) AS n, sum(CAST(choveu = pred_vai_chover AS INT)) AS acertos
        FROM rain_model_accuracy_by_lead GROUP BY faixa_antecedencia""")
