"""Scoring the coming hours and keeping the predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.constants import RAW_COLUMNS
from rainloom.functions.labels import alert_level
from rainloom.functions.numeric import stable_round
from rainloom.functions.timeparts import hour_floor, hours
from rainloom.operators.baselines import vote_count
from rainloom.operators.features import add_features
from rainloom.operators.grid import densify, keep_one
from rainloom.operators.models import Fitted, predict
from rainloom.sinks import tables as sink
from rainloom.sources.tables import horizon

T = "observation_time"
CONTEXT_DAYS = 3
HISTORY_KEYS = ["inferencia_local", "target_time"]


def serving_frame(
    observed: DataFrame, forecast: DataFrame, keys: list[str], as_of: Column, features: list[str], length_hours: int = 24
) -> DataFrame:
    """Features of the coming hours from recent observations followed by the forecast.

    An hour present in both is taken from the observations. ``api_precip_alvo``
    is the amount the forecast itself has for the hour after.
    """
    start = hour_floor(as_of)
    context = F.expr(f"INTERVAL {CONTEXT_DAYS * 24} HOURS")
    ahead = F.expr(f"INTERVAL {length_hours + 1} HOURS")
    t = F.col(T)
    recent = observed.where((t <= as_of) & (t >= start - context)).withColumn("_source", F.lit(0))
    coming = forecast.where((t >= start - context) & (t <= start + ahead)).withColumn("_source", F.lit(1))
    both = recent.unionByName(coming, allowMissingColumns=True)
    both = both.select(*keys, T, "_source", *[c for c in RAW_COLUMNS if c in both.columns])
    series = keep_one(both, [*keys, T], [F.col("_source")]).drop("_source")
    featured = add_features(
        densify(series, keys, T), keys, also=lambda w: {"api_precip_alvo": F.lead("precipitation", 1).over(w)}
    )
    return horizon(featured, T, start, length_hours).dropna(subset=features)


def score_hours(frame: DataFrame, champion: Fitted, as_of: Column, second: Fitted | None = None) -> DataFrame:
    """Predictions for the hour after each row: probability, decision, alert level and the
    facts of the models. Columns of an absent second model are typed nulls."""
    scored = predict(champion, frame, "_p")
    keys = [c for c in ("station_id",) if c in frame.columns]
    if second is not None:
        scored = predict(second, scored, "_p2")
    else:
        scored = scored.withColumn("_p2", F.lit(None).cast("double"))
    p, p2 = F.col("_p"), F.col("_p2")
    return scored.select(
        *keys, T, "temperature_2m", "apparent_temperature", "relative_humidity", "hour", "month",
        F.col("api_precip_alvo").cast("double").alias("api_precip_alvo"),
        F.round(p, 4).alias("prob_chuva"), (p >= champion.threshold).cast("int").alias("pred_vai_chover"),
        alert_level(F.round(p, 4)).alias("alerta_chuva"),
        (F.col(T) + hours(1)).alias("target_time"), as_of.alias("inferencia_local"),
        F.lit(champion.threshold).alias("threshold_usado"), F.lit(champion.label).alias("modelo"),
        F.round(p2, 4).alias("prob_chuva_medida"),
        (p2 >= (second.threshold if second else 0.0)).cast("double").alias("pred_chuva_medida"),
        F.lit(second.threshold if second else None).cast("double").alias("threshold_regional"),
        F.lit(second.label if second else "").alias("modelo_regional"), F.current_timestamp().alias("inferencia_at"),
    )


def score_ensemble(features: DataFrame, model: Fitted, as_of: Column, length_hours: int = 48) -> DataFrame:
    """Predictions for the hours ``(now, now + n]`` from several models' forecasts."""
    start = hour_floor(as_of)
    coming = horizon(features, T, start, length_hours, closed="right").where("p_best_match IS NOT NULL")
    scored = predict(model, coming, "_p")
    from rainloom.functions.timeparts import lead_hours

    keys = [c for c in ("station_id",) if c in scored.columns]
    return scored.select(
        *keys, F.col(T).alias("target_time"), lead_hours(F.col(T), start).alias("antecedencia_h"),
        F.round("_p", 4).alias("prob_chuva_medida"), (F.col("_p") >= model.threshold).cast("int").alias("pred_chuva_medida"),
        F.lit(model.threshold).alias("threshold"), vote_count().cast("double").alias("modelos_com_chuva"),
        stable_round(F.col("ens_media"), 2).alias("chuva_media_modelos_mm"),
        stable_round(F.col("p_best_match"), 2).alias("chuva_api_mm"),
        F.lit(model.label).alias("modelo"), as_of.alias("inferencia_local"),
    )


def publish(predictions: DataFrame, latest_path: str, history_path: str, keys: list[str] | None = None) -> None:
    """Replace the latest predictions and add new ones to the history, once each (per station, where there is one)."""
    sink.overwrite(predictions, latest_path)
    stored = predictions.sparkSession.read.parquet(latest_path)
    sink.create_if_absent(stored, history_path)
    station = [c for c in ("station_id",) if c in stored.columns]
    sink.merge_insert_only(stored, history_path, keys or [*station, *HISTORY_KEYS], pruned_by="target_time")
