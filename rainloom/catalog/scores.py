"""Metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import REGION_DAYS_SQL, SCORED_SQL, region_days, scored_labels
from rainloom.catalog.feature_sets import FEATURED_SQL
from rainloom.catalog.matching import _ALL_LEAD_SQL, forecasts_by_lead
from rainloom.catalog.profiles import store
from rainloom.catalog.registry import query
from rainloom.constants import SWEEP_ENSEMBLE, SWEEP_EVALUATION, SWEEP_RETRAIN
from rainloom.sources.tables import read_table
from rainloom.operators.metrics import (
    apply_group_threshold, auc, balanced_weights, best_threshold, brier, classification_metrics, grid,
    median_threshold, regression_metrics, roc_points, rolled_up_auc, rolled_up_metrics, threshold_sweep,
)

KEY = ["station_id"]
SCORE_COLUMNS = ("precision", "recall", "f1", "accuracy", "positivos_previstos")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or SCORE_COLUMNS if c in df.columns})


METRICS_SQL = """
 vp + fp + fn + vn AS n,
 ROUND(COALESCE(vp / NULLIF(CAST(vp + fp AS DOUBLE), 0), 0), 6) AS "precision",
 ROUND(COALESCE(vp / NULLIF(CAST(vp + fn AS DOUBLE), 0), 0), 6) AS recall,
 ROUND(COALESCE(2 * vp / NULLIF(CAST(2 * vp + fp + fn AS DOUBLE), 0), 0), 6) AS f1,
 ROUND(COALESCE((vp + vn) / NULLIF(CAST(vp + fp + fn + vn AS DOUBLE), 0), 0), 6) AS accuracy,
 ROUND(COALESCE((vp + fp) / NULLIF(CAST(vp + fp + fn + vn AS DOUBLE), 0), 0), 6) AS positivos_previstos"""


def counts_sql(y: str, p: str) -> str:
    return ", ".join(
        f"CAST(COUNT(*) FILTER (WHERE {y} = {a} AND {p} = {b}) AS BIGINT) AS {n}"
        for n, a, b in (("vp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("vn", 0, 0))
    )


PERSIST_SQL = FEATURED_SQL + """,
pr AS (SELECT station_id, observation_time, target_will_rain AS y, CAST(precipitation > 0 AS INTEGER) AS p, hour,
              LEAST(precip_rolling_6h / 200, CAST(1 AS DOUBLE)) AS score FROM store WHERE precipitation IS NOT NULL)"""


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-hour label, persistence forecast and a score from the last six hours."""
    return store(spark, sf_dir).where("precipitation IS NOT NULL").select(
        "station_id", "observation_time", F.col("target_will_rain").alias("y"), (F.col("precipitation") > 0).cast("int").alias("p"),
        "hour", F.least(F.col("precip_rolling_6h") / 200, F.lit(1.0)).alias("score"),
    )


@query(PERSIST_SQL + f", c AS (SELECT station_id, {counts_sql('y', 'p')} FROM pr GROUP BY 1) SELECT *, {METRICS_SQL} FROM c")
def persistence_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence ("rain now, rain next hour") per station."""
    return rounded(classification_metrics(persistence(spark, sf_dir), KEY, "y", "p"))


@query(PERSIST_SQL + f""",
c AS (SELECT COALESCE(station_id, 'todas') AS station_id, {counts_sql('y', 'p')} FROM pr GROUP BY ROLLUP (station_id)) SELECT *, {METRICS_SQL} FROM c""")
def confusion_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics per station and for all together."""
    return rounded(rolled_up_metrics(persistence(spark, sf_dir), [], "station_id", "y", "p"))


@query("WITH" + SCORED_SQL + """,
c AS (SELECT score, COUNT(*) FILTER (WHERE quality = 1) AS pos, COUNT(*) FILTER (WHERE quality = 0) AS neg FROM sl GROUP BY 1)
SELECT score AS threshold, ROUND(SUM(neg) OVER (ORDER BY score DESC) / CAST(SUM(neg) OVER () AS DOUBLE), 6) AS fpr,
       ROUND(SUM(pos) OVER (ORDER BY score DESC) / CAST(SUM(pos) OVER () AS DOUBLE), 6) AS tpr FROM c""")
def roc_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roc_points(scored_labels(spark, sf_dir), [], "score", "quality"), "fpr", "tpr")


def _auc_sql(source: str, group: str, y: str) -> str:
    return f"""
ac AS (SELECT {group}, score, COUNT(*) FILTER (WHERE {y} = 1) AS pos, COUNT(*) FILTER (WHERE {y} = 0) AS neg FROM {source}
       WHERE score IS NOT NULL GROUP BY ALL),
ab AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY {group} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ac),
auc AS (SELECT {group}, ROUND(CAST(SUM(pos * (below + neg / 2.0)) AS DOUBLE) / NULLIF(CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE), 0), 6) AS auc_roc
        FROM ab GROUP BY ALL)"""


@query("WITH src AS (SELECT NULLIF(l_linestatus, 'O') AS g, CAST(l_extendedprice AS DOUBLE) AS score, CAST(l_quantity > 25 AS INTEGER) AS y FROM lineitem),"
       + _auc_sql("src", "g", "y") + " SELECT * FROM auc")
def auc_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More distinct scores than a slice holds, one group being null."""
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.nullif("l_linestatus", F.lit("O")).alias("g"), F.col("l_extendedprice").cast("double").alias("score"), (F.col("l_quantity") > 25).cast("int").alias("y")
    )
    return rounded(auc(rows, ["g"], "score", "y"), "auc_roc")


@query("WITH" + SCORED_SQL + "," + _auc_sql("sl", "lang", "quality") + " SELECT * FROM auc")
def auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tie-aware AUC per group; null for one class."""
    return rounded(auc(scored_labels(spark, sf_dir), ["lang"], "score", "quality"), "auc_roc")


@query(PERSIST_SQL + ", pp AS (SELECT * FROM pr UNION ALL SELECT * REPLACE ('todas' AS station_id) FROM pr)," + _auc_sql("pp", "station_id", "y")
       + " SELECT * FROM auc")
def auc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC per station and pooled over all stations."""
    return rounded(rolled_up_auc(persistence(spark, sf_dir), [], "station_id", "score", "y"), "auc_roc")


@query(_ALL_LEAD_SQL + f""",
c AS (SELECT faixa_antecedencia, {counts_sql('choveu', 'pred_vai_chover')} FROM lead GROUP BY 1),
b AS (SELECT faixa_antecedencia, ROUND(AVG((prob_chuva - choveu) * (prob_chuva - choveu)), 6) AS brier FROM lead GROUP BY 1)
SELECT *, {METRICS_SQL} FROM c JOIN b USING (faixa_antecedencia)""")
def lead_range_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion metrics and Brier score per lead range, over all observed hours."""
    rows = forecasts_by_lead(spark, sf_dir)
    scores = classification_metrics(rows, ["faixa_antecedencia"], "choveu", "pred_vai_chover")
    briers = rows.groupBy("faixa_antecedencia").agg(F.round(brier("prob_chuva", "choveu"), 6).alias("brier"))
    return rounded(scores.join(briers, "faixa_antecedencia"))


@query("WITH" + SCORED_SQL + "SELECT lang, ROUND(AVG((score - quality) * (score - quality)), 6) AS brier, COUNT(*) AS n FROM sl GROUP BY 1")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_labels(spark, sf_dir).groupBy("lang").agg(
        F.round(brier("score", "quality"), 6).alias("brier"), F.count(F.lit(1)).alias("n")
    )


@query("WITH" + REGION_DAYS_SQL + """,
e AS (SELECT station_id, precipitation AS y, GREATEST(n_orders * 10.0 - 5, 0) AS yhat FROM rd),
u AS (SELECT 'all' AS rows, * FROM e UNION ALL SELECT 'wet', * FROM e WHERE y > 0)
SELECT station_id, rows, COUNT(*) AS n, ROUND(SQRT(AVG((yhat - y) * (yhat - y))), 4) AS rmse, ROUND(AVG(ABS(yhat - y)), 4) AS mae,
       ROUND(1 - SUM((yhat - y) * (yhat - y)) / (VAR_POP(y) * COUNT(*)), 4) AS r2 FROM u GROUP BY 1, 2""")
def amount_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE, MAE and R2 on all rows and on wet rows."""
    days = region_days(spark, sf_dir).select(
        "station_id", F.col("precipitation").alias("y"), F.greatest(F.col("n_orders") * 10.0 - 5, F.lit(0.0)).alias("yhat")
    )
    out = regression_metrics(days, KEY, "y", "yhat")
    return out.withColumns({c: F.round(c, 4) for c in ("rmse", "mae", "r2")})


def _sweep_sql(thresholds: list[float], source: str, y: str, group: str = "") -> str:
    values = ", ".join(f"{t}" for t in thresholds)
    g = f"{group}, " if group else ""
    return f"""
sc AS (SELECT {g}t AS threshold, {counts_sql(y, 'CAST(score >= t AS INTEGER)')}
       FROM {source}, (SELECT UNNEST([{values}]::DOUBLE[]) AS t) WHERE score IS NOT NULL GROUP BY ALL),
sw AS (SELECT *, {METRICS_SQL} FROM sc)"""


@query("WITH" + SCORED_SQL + "," + _sweep_sql(grid(*SWEEP_EVALUATION), "sl", "quality") + " SELECT * FROM sw")
def threshold_sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(threshold_sweep(scored_labels(spark, sf_dir), [], "score", "quality", grid(*SWEEP_EVALUATION)))


@query(PERSIST_SQL + "," + _sweep_sql(grid(*SWEEP_RETRAIN), "pr", "y", "station_id") + """
SELECT station_id, threshold, f1 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY 2 * vp / NULLIF(CAST(2 * vp + fp + fn AS DOUBLE), 0) DESC, threshold) AS rn FROM sw) WHERE rn = 1""")
def best_threshold_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold with the best F1; the lowest of equals."""
    sweep = threshold_sweep(persistence(spark, sf_dir), KEY, "score", "y", grid(*SWEEP_RETRAIN))
    return rounded(best_threshold(sweep, KEY).select("station_id", "threshold", "f1"))


@query(PERSIST_SQL + "," + _sweep_sql(grid(*SWEEP_ENSEMBLE), "pr", "y", "station_id") + """,
b AS (SELECT station_id, threshold FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY 2 * vp / NULLIF(CAST(2 * vp + fp + fn AS DOUBLE), 0) DESC, threshold) AS rn FROM sw) WHERE rn = 1)
SELECT CAST(median(threshold) AS DOUBLE) AS threshold FROM b""")
def fold_threshold_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the stations' best thresholds."""
    sweep = threshold_sweep(persistence(spark, sf_dir), KEY, "score", "y", grid(*SWEEP_ENSEMBLE))
    return median_threshold(best_threshold(sweep, KEY))


@query(PERSIST_SQL + "," + _sweep_sql(grid(*SWEEP_RETRAIN), "pr", "y", "station_id") + f""",
b AS (SELECT station_id, threshold FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY 2 * vp / NULLIF(CAST(2 * vp + fp + fn AS DOUBLE), 0) DESC, threshold) AS rn FROM sw) WHERE rn = 1),
d AS (SELECT station_id, y, CAST(score >= threshold AS INTEGER) AS p FROM pr JOIN b USING (station_id)),
c AS (SELECT station_id, {counts_sql('y', 'p')} FROM d GROUP BY 1),""" + _auc_sql("pr", "station_id", "y") + f"""
SELECT c.*, auc_roc, {METRICS_SQL} FROM c JOIN auc USING (station_id)""")
def final_metrics_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics at each station's own threshold, with the AUC of its scores."""
    rows = persistence(spark, sf_dir)
    best = best_threshold(threshold_sweep(rows, KEY, "score", "y", grid(*SWEEP_RETRAIN)), KEY)
    decided = apply_group_threshold(rows, best, KEY, "score", "p")
    scores = classification_metrics(decided, KEY, "y", "p")
    return rounded(scores.join(auc(rows, KEY, "score", "y"), "station_id"), *SCORE_COLUMNS, "auc_roc")


@query(FEATURED_SQL + """
SELECT target_will_rain, ROUND((SELECT COUNT(*) FROM store) / (2.0 * COUNT(*)), 6) AS weight, COUNT(*) AS n FROM store GROUP BY 1""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced weight of each class."""
    weighted = balanced_weights(store(spark, sf_dir), "target_will_rain")
    return weighted.groupBy("target_will_rain").agg(F.round(F.max("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))
