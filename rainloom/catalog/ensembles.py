"""Several forecast models at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import GRID_SQL, MODELS_SQL, dense_observations, model_forecasts, sround
from rainloom.catalog.registry import query
from rainloom.catalog.scores import METRICS_SQL, _auc_sql, counts_sql, rounded
from rainloom.constants import CAPE_MODELS, ENSEMBLE_MODELS
from rainloom.functions.ensemble import archived_name, archived_single_name, live_name
from rainloom.functions.numeric import stable_round
from rainloom.operators.baselines import best_vote_count, long_decisions, single_model_f1, vote_count
from rainloom.operators.blocks import over_blocks
from rainloom.operators.ensemble_features import ensemble_features, phase_features
from rainloom.operators.metrics import auc, classification_metrics
from rainloom.operators.profile import best_per_group

T = "observation_time"
P = [f"p_{m}" for m in ENSEMBLE_MODELS]
P_LIST = ", ".join(P)
VOTES_SQL = " + ".join(f"COALESCE(CAST({p} >= 0.1 AS INTEGER), 0)" for p in P)
ANY_SQL = " OR ".join(f"{p} IS NOT NULL" for p in P)
MEAN_SQL = "(" + " + ".join(f"COALESCE({p}, 0)" for p in P) + ") / NULLIF(" + " + ".join(f"CAST({p} IS NOT NULL AS INTEGER)" for p in P) + ", 0)"
CENTRE = "OVER (ORDER BY observation_time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"

STATS = ["ens_media", "ens_max", "ens_frac", "ens_frac3"]


@query("WITH" + MODELS_SQL + ",\nv AS (SELECT observation_time, " + P_LIST + ", "
       + ", ".join(f"SUM({p}) {CENTRE} AS s_{p}" for p in P) + " FROM models)\n"
       + f"SELECT observation_time, {sround(MEAN_SQL, 6)} AS ens_media, ROUND(GREATEST({P_LIST}), 6) AS ens_max, "
       + f"CASE WHEN {ANY_SQL} THEN ROUND(({VOTES_SQL}) / 6.0, 6) END AS ens_frac, "
       + "ROUND((" + " + ".join(f"COALESCE(CAST(s_{p} >= 0.1 AS INTEGER), 0)" for p in P) + ") / 6.0, 6) AS ens_frac3 FROM v")
def ensemble_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, maximum and vote shares over six models."""
    out = ensemble_features(model_forecasts(spark, sf_dir, live_name), [], live_name)
    return out.select(T, stable_round(F.col("ens_media"), 6).alias("ens_media"), *[F.round(c, 6).alias(c) for c in STATS[1:]])


_FEATURES_SQL = ", ".join(
    [f"{p}, {sround(f'SUM({p}) {CENTRE}', 6)} AS {p.replace('p_', 'p3_', 1)}" for p in P]
    + [f"nuv_{m}, ur_{m}" for m in ENSEMBLE_MODELS] + [f"cape_{m}" for m in CAPE_MODELS]
)


@query("WITH" + MODELS_SQL + f"""
SELECT observation_time, {_FEATURES_SQL}, ROUND(SIN(2 * PI() * hour(observation_time) / 24), 6) AS hora_sin,
  ROUND(COS(2 * PI() * hour(observation_time) / 24), 6) AS hora_cos, ROUND(SIN(2 * PI() * month(observation_time) / 12), 6) AS mes_sin,
  ROUND(COS(2 * PI() * month(observation_time) / 12), 6) AS mes_cos FROM models""")
def ensemble_feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All per-model features, read from archived-run column names."""
    name = archived_name(1)
    out = ensemble_features(model_forecasts(spark, sf_dir, name), [], name).drop(*STATS)
    cycles = {c: F.round(c, 6) for c in ("hora_sin", "hora_cos", "mes_sin", "mes_cos")}
    return out.withColumns({f"p3_{m}": stable_round(F.col(f"p3_{m}"), 6) for m in ENSEMBLE_MODELS} | cycles)


@query("WITH" + MODELS_SQL + f"""
SELECT observation_time, CAST({VOTES_SQL} AS INTEGER) AS modelos_com_chuva, {sround(MEAN_SQL, 2)} AS chuva_media_modelos_mm,
       {sround("p_best_match", 2)} AS chuva_api_mm FROM models WHERE p_best_match IS NOT NULL""")
def ensemble_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole votes, mean and the API amount of each hour."""
    wide = ensemble_features(model_forecasts(spark, sf_dir, live_name), [], live_name).where("p_best_match IS NOT NULL")
    return wide.select(
        T, vote_count().alias("modelos_com_chuva"), stable_round(F.col("ens_media"), 2).alias("chuva_media_modelos_mm"),
        stable_round(F.col("p_best_match"), 2).alias("chuva_api_mm"),
    )


# The label of an hour: did the models' mean show rain two hours later?
LABELLED_SQL = "WITH" + MODELS_SQL + """,
lab0 AS (SELECT *, CAST(LEAD(p_best_match, 2) OVER (ORDER BY observation_time) > 0 AS INTEGER) AS y FROM models),
lab AS (SELECT * FROM lab0 WHERE y IS NOT NULL AND p_best_match IS NOT NULL)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ensemble_features(model_forecasts(spark, sf_dir, live_name), [], live_name)
    truth = over_blocks(wide, [], T, 0, 2, lambda w: {"y": (F.lead("p_best_match", 2).over(w) > 0).cast("int")})
    return truth.dropna(subset=["y", "p_best_match"])


_SINGLE = " UNION ALL ".join(
    f"SELECT '{m}' AS modelo, {i} AS rank_no, ROUND(COALESCE(2 * SUM(CAST(y = 1 AND COALESCE(p_{m} > 0, FALSE) AS INTEGER)) / "
    f"NULLIF(CAST(SUM(y) + SUM(CAST(COALESCE(p_{m} > 0, FALSE) AS INTEGER)) AS DOUBLE), 0), 0), 6) AS f1 FROM lab" for i, m in enumerate(ENSEMBLE_MODELS)
)


@query(LABELLED_SQL + f", s AS ({_SINGLE}) SELECT modelo, rank_no, f1 FROM s ORDER BY f1 DESC, rank_no LIMIT 1")
def best_single_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    f1s = single_model_f1(labelled(spark, sf_dir), [], "y").withColumn("f1", F.round("f1", 6))
    return best_per_group(f1s, [], "f1", [F.col("rank_no")])


@query(LABELLED_SQL + f""",
v AS (SELECT y, {VOTES_SQL} AS votes FROM lab),
s AS (SELECT k AS threshold, {counts_sql('y', 'CAST(votes >= k AS INTEGER)')} FROM v, (SELECT UNNEST([1,2,3,4,5,6]) AS k) GROUP BY 1)
SELECT CAST(threshold AS DOUBLE) AS threshold, {METRICS_SQL}, vp, fp, fn, vn FROM s
ORDER BY 2 * vp / NULLIF(CAST(2 * vp + fp + fn AS DOUBLE), 0) DESC NULLS LAST, threshold LIMIT 1""")
def best_vote_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of votes with the best F1."""
    return rounded(best_vote_count(labelled(spark, sf_dir), [], "y"))


@query(LABELLED_SQL + f""",
v AS (SELECT *, {VOTES_SQL} AS votes, COALESCE({MEAN_SQL}, 0) AS media FROM lab),
a AS (SELECT y, 'api' AS abordagem, CAST(COALESCE(p_best_match > 0, FALSE) AS INTEGER) AS pred, COALESCE(p_best_match, 0) AS score FROM v
      UNION ALL SELECT y, 'gfs', CAST(COALESCE(p_gfs_seamless > 0, FALSE) AS INTEGER), COALESCE(p_gfs_seamless, 0) FROM v
      UNION ALL SELECT y, 'votos', CAST(votes >= 3 AS INTEGER), votes / 6.0 FROM v),
c AS (SELECT abordagem, {counts_sql('y', 'pred')} FROM a GROUP BY 1),""" + _auc_sql("a", "abordagem", "y") + f"""
SELECT abordagem, auc_roc, vp, fp, fn, vn, {METRICS_SQL} FROM c JOIN auc USING (abordagem)""")
def approach_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API, one model and votes on the same rows: long format, one grouped job."""
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = long_decisions(labelled(spark, sf_dir), ["y"], {
        "api": (score("p_best_match") > 0, score("p_best_match")),
        "gfs": (score("p_gfs_seamless") > 0, score("p_gfs_seamless")),
        "votos": (vote_count() >= 3, vote_count() / 6.0),
    })
    scores = classification_metrics(rows, ["abordagem"], "y", "pred").join(auc(rows, ["abordagem"], "score", "y"), "abordagem")
    return rounded(scores, "precision", "recall", "f1", "accuracy", "positivos_previstos", "auc_roc")


_ARCHIVE_MAP = {
    "precipitation": "precipitation", "temperature_2m": "temperature_2m", "apparent_temperature": "apparent_temperature",
    "relative_humidity_2m": "relative_humidity", "dew_point_2m": "dew_point_2m", "pressure_msl": "pressure_msl",
    "cloud_cover": "cloud_cover", "wind_speed_10m": "windspeed", "wind_direction_10m": "wind_direction_10m",
}
_WIN7 = "OVER (PARTITION BY station_id ORDER BY observation_time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query("WITH" + GRID_SQL + f"""
SELECT station_id, observation_time, {", ".join(f"{c} AS {v}" for v, c in _ARCHIVE_MAP.items())},
  {", ".join(f"LAG(precipitation, {k}) OVER w AS precip_lag_{k}, LEAD(precipitation, {k}) OVER w AS precip_lead_{k}" for k in (1, 2, 3))},
  CASE WHEN COUNT(precipitation) {_WIN7} = 7 THEN {sround(f"SUM(precipitation) {_WIN7}", 6)} END AS precip_win_7h,
  pressure_msl - LAG(pressure_msl, 3) OVER w AS pressure_tend_3h, temperature_2m - dew_point_2m AS dewpoint_depression,
  ROUND(SIN(RADIANS(wind_direction_10m)), 6) AS wind_dir_sin, ROUND(COS(RADIANS(wind_direction_10m)), 6) AS wind_dir_cos,
  ROUND(SIN(hour(observation_time) * 2 * PI() / 24), 6) AS hour_sin, ROUND(COS(hour(observation_time) * 2 * PI() / 24), 6) AS hour_cos,
  ROUND(SIN(month(observation_time) * 2 * PI() / 12), 6) AS month_sin, ROUND(COS(month(observation_time) * 2 * PI() / 12), 6) AS month_cos
FROM grid WINDOW w AS (PARTITION BY station_id ORDER BY observation_time)""")
def single_model_phase_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-model forecast features with shifts to both sides."""
    name = archived_single_name(1)
    dense = dense_observations(spark, sf_dir).select(
        "station_id", T, *[F.col(c).alias(name(v)) for v, c in _ARCHIVE_MAP.items()]
    )
    out = phase_features(dense, ["station_id"], name)
    rounds = {c: F.round(c, 6) for c in ("wind_dir_sin", "wind_dir_cos", "hour_sin", "hour_cos", "month_sin", "month_cos")}
    return out.withColumns(rounds | {"precip_win_7h": stable_round(F.col("precip_win_7h"), 6)})


_LEADS = (0, 1, 2)
_LEAD_ROWS = " UNION ALL ".join(
    f"SELECT y, {l} AS lead, CAST(s{l} > 0 AS INTEGER) AS pred, s{l} AS score FROM ok" for l in _LEADS
)


@query("WITH" + GRID_SQL + f""",
sh AS (SELECT station_id, CAST(LEAD(precipitation) OVER w > 0 AS INTEGER) AS y, precipitation AS s0, LAG(precipitation, 1) OVER w AS s1,
              LAG(precipitation, 2) OVER w AS s2 FROM grid WINDOW w AS (PARTITION BY station_id ORDER BY observation_time)),
ok AS (SELECT * FROM sh WHERE y IS NOT NULL AND s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL),
a AS ({_LEAD_ROWS}), c AS (SELECT lead, {counts_sql('y', 'pred')} FROM a GROUP BY 1),""" + _auc_sql("a", "lead", "y") + f"""
SELECT lead, auc_roc, vp, fp, fn, vn, {METRICS_SQL} FROM c JOIN auc USING (lead)""")
def lead_time_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same forecast at three leads on identical hours, one row of metrics per lead."""
    dense = dense_observations(spark, sf_dir, narrow=True).select("station_id", T, "precipitation")
    wide = over_blocks(dense, ["station_id"], T, 2, 1, lambda w: {
        "y": (F.lead("precipitation", 1).over(w) > 0).cast("int"), "s0": F.col("precipitation"),
        "s1": F.lag("precipitation", 1).over(w), "s2": F.lag("precipitation", 2).over(w),
    }).dropna(subset=["y", "s0", "s1", "s2"])
    by_lead = F.array(*[F.struct(F.lit(l).alias("lead"), F.col(f"s{l}").alias("score")) for l in _LEADS])
    rows = wide.select("y", F.inline(by_lead)).withColumn("pred", (F.col("score") > 0).cast("int"))
    scores = classification_metrics(rows, ["lead"], "y", "pred").join(auc(rows, ["lead"], "score", "y"), "lead")
    return rounded(scores, "precision", "recall", "f1", "accuracy", "positivos_previstos", "auc_roc")
