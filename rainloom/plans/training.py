"""Training flows: monthly retraining, station-out models, ensembles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.constants import (
    ENSEMBLE_VERSIONS_DDL, MODEL_VERSIONS_DDL, REGIONAL_VERSIONS_DDL, SWEEP_ENSEMBLE, SWEEP_REGIONAL, SWEEP_RETRAIN,
)
from rainloom.operators.ledger import conform, should_promote
from rainloom.operators.metrics import brier, grid, median_threshold
from rainloom.operators.models import Fitted, calibrated
from rainloom.operators.splits import large_enough, rolling_split
from rainloom.plans.evaluation import (
    Fit, decided, evaluate, fit_each, folded_thresholds, groups_of, leave_one_out, predict_each, stack, station_folds,
)
from rainloom.session import materialize
from rainloom.sinks.tables import append, merge_update_partitions

T = "observation_time"


def retrain(
    store: DataFrame, features: list[str], label: str, as_of: Column, fit: Fit, version: int, created_at: Column,
    champion: Fitted | None = None, calibrate_months: int = 12, test_months: int = 12,
) -> tuple[Fitted, DataFrame]:
    """Fit, calibrate and test a new version, and judge it against the champion on the same
    test rows, each at its own threshold. Returns the model and its ledger row(s): one for
    the new version and, where the champion stays, one with the champion's renewed metrics
    (its training rows aren't known here)."""
    wanted = sorted(set(features) | set(champion.features if champion else []))
    rows = rolling_split(store.where(F.col(T) < as_of).dropna(subset=[*wanted, label]), as_of, calibrate_months, test_months)
    rows = materialize(rows, "retrain")
    part = lambda name: rows.where(F.col("split") == name)
    model = replace(
        calibrated(fit(part("train"), features, label), part("calibrate"), label, grid(*SWEEP_RETRAIN)), version=version
    )
    contenders = {"new": model} | ({"champion": champion} if champion else {})
    tested = stack([decided(m, part("test"), n).select(label, "score", "pred", "abordagem") for n, m in contenders.items()])
    tested = materialize(tested, "tested")
    metrics = {r["abordagem"]: r for r in evaluate(tested, ["abordagem"], label).collect()}
    f1_champion = metrics["champion"]["f1"] if champion else None
    promoted = should_promote(metrics["new"]["f1"], f1_champion, tolerance=0.0)
    sizes = rows.groupBy().agg(
        F.count_if(F.col("split") == "train").alias("train_size"), F.count_if(F.col("split") == "test").alias("test_size"),
        F.avg(F.when(F.col("split") == "test", F.col(label).cast("double"))).alias("test_rain_rate"),
    ).first()
    shown = [("new", model, promoted)] + ([] if promoted or not champion else [("champion", champion, True)])
    entries = [
        (m.version, m.label, keep, *[float(metrics[n][c]) if metrics[n][c] is not None else None for c in ("f1", "accuracy", "precision", "recall", "auc_roc")],
         sizes["train_size"] if n == "new" else None, sizes["test_size"], sizes["test_rain_rate"], float(m.threshold))
        for n, m, keep in shown
    ]
    ledger = store.sparkSession.createDataFrame(entries, (
        "version int, run_id string, promoted boolean, f1 double, accuracy double, `precision` double, recall double, "
        "auc_roc double, train_size long, test_size long, test_rain_rate double, threshold double"
    ))
    return model, conform(ledger.withColumn("created_at", created_at), MODEL_VERSIONS_DDL)


RENEWED = ["f1", "accuracy", "precision", "recall", "auc_roc", "test_size", "test_rain_rate", "threshold"]


def retrain_into(
    ledger: str, store: DataFrame, features: list[str], label: str, as_of: Column, fit: Fit, version: int, created_at: Column,
    champion: Fitted | None = None, calibrate_months: int = 12, test_months: int = 12,
) -> Fitted:
    """``retrain`` with its rows in a stored ledger, partitioned by version; returns the champion from now on.

    The new version is appended. Where the champion stays, its row gets the metrics of today's
    test in place of the old ones; rows of other versions aren't rewritten.
    """
    model, entries = retrain(store, features, label, as_of, fit, version, created_at, champion, calibrate_months, test_months)
    entries = materialize(entries, "ledger-rows")
    append(entries.where(F.col("version") == version), ledger, ["version"])
    renewed = entries.where(F.col("version") != version)
    if renewed.isEmpty():
        return model
    merge_update_partitions(renewed, ledger, ["version"], RENEWED, ["version"])
    return champion


def train_regional(
    split: DataFrame, station: str, features: list[str], label: str, fit: Fit, version: int, created_at: Column,
    f1_champion: float | None = None, at_least: int = 500,
) -> tuple[Fitted, DataFrame]:
    """Final model on all stations, judged by leave-one-station-out; its threshold is the
    median of the stations' thresholds."""
    spark = split.sparkSession
    pooled = materialize(
        leave_one_out(split, station, label, {"regional": features}, fit, grid(*SWEEP_REGIONAL), at_least, calibrate_at_least=at_least), "regional"
    )
    threshold = median_threshold(pooled.select(station, "threshold").distinct()).first()["threshold"]
    final = replace(fit(split, features, label), threshold=threshold, version=version)
    facts = evaluate(pooled, [], label).withColumns(_facts(final, split, pooled, station, label, created_at))
    f1 = facts.select("f1").first()["f1"]
    return final, conform(facts.withColumn("promoted", F.lit(should_promote(f1, f1_champion))), REGIONAL_VERSIONS_DDL)


def _facts(model: Fitted, rows: DataFrame, pooled: DataFrame, station: str, label: str, created_at: Column) -> dict[str, Column]:
    stations = groups_of(pooled, station)
    return {
        "version": F.lit(model.version), "run_id": F.lit(model.label), "created_at": created_at, "threshold": F.lit(model.threshold),
        "train_size": rows.agg(F.count(F.lit(1))).scalar(), "test_size": F.col("n"),
        "test_rain_rate": pooled.agg(F.avg(F.col(label).cast("double"))).scalar(), "estacoes": F.lit(",".join(map(str, stations))),
    }


def train_ensemble(
    rows: DataFrame, station: str, features: list[str], label: str, api: str, cut: Column, fit: Fit, version: int,
    created_at: Column, folds: int = 3, f1_champion: float | None = None, at_least: int = 500,
) -> tuple[Fitted, DataFrame]:
    """Model on the forecasts of several models for measured rain, judged with each station
    left out and against the raw forecast on the same hours. Thresholds come from
    out-of-fold scores of the training rows, whole stations per fold. All models, the final
    one too, are fitted together."""
    tested, _ = large_enough(rows.where(F.col(T) >= cut), [station], at_least)
    held = {str(k): value for k, value in enumerate(groups_of(tested, station))}
    learns, scores = station_folds(rows, station, held, cut, folds)
    models = fit_each(fit, rows, features, label, learns | {"final": F.lit(True)})
    final = models.pop("final")
    scored = materialize(predict_each(models, rows, scores), "ensemble-scores")
    test = scored.where(F.col("model").endswith(":all")).withColumn("held", F.split_part("model", F.lit(":"), F.lit(1)))
    test = test.join(folded_thresholds(scored, label, grid(*SWEEP_ENSEMBLE)), "held")
    pooled = materialize(
        test.select(station, label, api, "score", (F.col("score") >= F.col("threshold")).cast("int").alias("pred"), "threshold"), "ensemble"
    )
    threshold = median_threshold(pooled.select(station, "threshold").distinct()).first()["threshold"]
    final = replace(final, threshold=threshold, version=version)
    scores = evaluate(pooled, [], label).withColumns(_facts(final, rows, pooled, station, label, created_at))
    baseline = evaluate(
        pooled.withColumn("pred", F.coalesce((F.col(api) > 0).cast("int"), F.lit(0))).withColumn("score", F.coalesce(api, F.lit(0.0))), [], label
    )
    facts = scores.withColumns({
        "f1_api": baseline.select("f1").scalar(), "brier": pooled.agg(brier("score", label)).scalar(),
    })
    got = facts.select("f1", "f1_api").first()
    promoted = should_promote(got["f1"], f1_champion, got["f1_api"])
    return final, conform(facts.withColumn("promoted", F.lit(promoted)), ENSEMBLE_VERSIONS_DDL)
