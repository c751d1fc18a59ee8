"""Protocols that fit and compare models: leave-one-station-out, folds, ablation, transfer."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from rainloom.constants import ENSEMBLE_MODELS, MIN_TEST_ROWS, VENDOR_RENAMES
from rainloom.operators.baselines import best_vote_count, long_decisions, single_model_f1, vote_count
from rainloom.operators.ensemble_features import phase_features
from rainloom.operators.features import shifted_features
from rainloom.operators.metrics import (
    auc, best_threshold, classification_metrics, rolled_up_auc, rolled_up_metrics, threshold_sweep,
)
from rainloom.operators.boosting import chances
from rainloom.operators.models import Fitted, Grown, calibrated, predict
from rainloom.operators.profile import best_per_group, weighted_mean
from rainloom.operators.splits import assign_folds, fold_numbers, large_enough, split_at
from rainloom.session import materialize

Fit = Callable[[DataFrame, list[str], str], Fitted | Grown]
#: Fits of models that can't share jobs run side by side, so many at a time.
SIDE_BY_SIDE = 4


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def groups_of(df: DataFrame, column: str) -> list:
    """The values of a grouping column, null last. One model is fitted per value; where there are
    many stations, pass the column that ``assign_folds`` adds instead."""
    values = [r[0] for r in df.select(column).distinct().collect()]
    return sorted(v for v in values if v is not None) + [None] * (None in values)


def decided(model: Fitted, rows: DataFrame, approach: str) -> DataFrame:
    """Rows with score, decision, approach and threshold."""
    return predict(model, rows, "score").withColumns({
        "pred": (F.col("score") >= model.threshold).cast("int"), "abordagem": F.lit(approach),
        "threshold": F.lit(float(model.threshold)),
    })


def fit_each(fit: Fit, rows: DataFrame, features: list[str], label: str, masks: dict[str, Column]) -> dict[str, Fitted | Grown]:
    """One model per mask: all in the same jobs where ``fit`` can, else in jobs side by side."""
    if hasattr(fit, "many"):
        return fit.many(rows, features, label, masks)
    one = lambda mask: fit(rows.where(mask), features, label)
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        started = {name: pool.submit(inheritable_thread_target(rows.sparkSession)(one), mask) for name, mask in masks.items()}
        return {name: job.result() for name, job in started.items()}


def predict_each(models: dict[str, Fitted | Grown], rows: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """Rows with ``model`` and ``score``, once for every model that is wanted for the row."""
    if models and all(isinstance(m, Grown) for m in models.values()):
        some = next(iter(models.values()))
        each = chances({k: m.trees for k, m in models.items()}, rows, some.features, {k: wanted[k] for k in models})
        return rows.select("*", each.alias("_each")).select(*rows.columns, F.inline("_each"))
    return stack([predict(m, rows.where(wanted[k]), "score").withColumn("model", F.lit(k)) for k, m in models.items()])


def _is(station: str, value) -> Column:
    return F.col(station).eqNullSafe(F.lit(value))


def leave_one_out(
    split: DataFrame, station: str, label: str, variants: dict[str, list[str]], fit: Fit, thresholds: list[float],
    at_least: int = MIN_TEST_ROWS, references: dict[str, tuple[Column, Column]] | None = None, calibrate_at_least: int = 0,
) -> DataFrame:
    """Predictions for each station's test rows by models that never saw the station.

    ``split`` has a ``split`` column (train / calibrate / test). The models of all stations
    are fitted together (``fit_each``) and scored in one pass; their thresholds come from the
    calibration rows of the other stations. Stations with too few test rows, or whose others
    have too few calibration rows, are left out, as decided once for all variants.
    ``references`` are decisions and scores that need no fit, on the same test rows.
    """
    tested, _ = large_enough(split.where("split = 'test'"), [station], at_least)
    held = groups_of(tested, station)
    if calibrate_at_least:
        counted = split.where("split = 'calibrate'").groupBy(station).agg(F.count(F.lit(1)).alias("n")).collect()
        others = lambda value: sum(r["n"] for r in counted if r[station] != value)
        held = [value for value in held if others(value) >= calibrate_at_least]
    values = {str(k): value for k, value in enumerate(held)}
    own = {k: _is(station, value) for k, value in values.items()}
    others = {k: ~c for k, c in own.items()}
    phase = lambda name: F.col("split") == name
    target = tested.where(reduce(Column.__or__, own.values(), F.lit(False)))
    parts = []
    for name, features in variants.items():
        models = fit_each(fit, split, features, label, {k: c & phase("train") for k, c in others.items()})
        seen = predict_each(models, split.where(phase("calibrate")), others)
        best = best_threshold(threshold_sweep(seen, ["model"], "score", label, thresholds), ["model"]).select("model", "threshold")
        scored = predict_each(models, target, own).join(best, "model", "left")
        cut = F.coalesce("threshold", F.lit(0.5))
        parts.append(scored.select(station, label, "score", (F.col("score") >= cut).cast("int").alias("pred"), F.lit(name).alias("abordagem"), cut.alias("threshold")))
    if references:
        plain = long_decisions(target, [station, label], references)
        parts.append(plain.select(station, label, "score", "pred", "abordagem", F.lit(None).cast("double").alias("threshold")))
    return stack(parts)


def out_of_fold(df: DataFrame, group: list[str], folds: int, features: list[str], label: str, fit: Fit) -> DataFrame:
    """Score of every row by a model fitted on the other folds; whole groups per fold."""
    folded = materialize(assign_folds(df, group, folds), "folds")
    mine = {str(n): F.col("fold") == n for n in groups_of(folded, "fold")}
    models = fit_each(fit, folded, features, label, {k: ~c for k, c in mine.items()})
    return predict_each(models, folded, mine).drop("model")


def cross_fitted(
    split: DataFrame, station: str, features: list[str], label: str, fit: Fit, out: str, folds: int = 2, held_out: list | None = None
) -> DataFrame:
    """A first model's probability as an input for a second one, as a column for each held-out station.

    Adds ``out`` as a map from the station's number (its place in ``held_out``, all stations in order
    by default) to the probability by a model that saw neither that station nor the fold of stations
    the row belongs to. Rows of the held-out station itself are scored by a model of all the others.
    """
    held = groups_of(split, station) if held_out is None else held_out
    sizes = {r[station]: r["n"] for r in split.groupBy(station).agg(F.count(F.lit(1)).alias("n")).collect()}
    learns, scores = {}, {}
    train = F.col("split") == "train"
    for k, value in enumerate(held):
        fold = fold_numbers({s: n for s, n in sizes.items() if s != value}, folds)
        away = ~_is(station, value)
        learns[f"{k}:all"], scores[f"{k}:all"] = away & train, ~away
        for f in sorted(set(fold.values())):
            mine = reduce(Column.__or__, [_is(station, s) for s, number in fold.items() if number == f])
            learns[f"{k}:{f}"], scores[f"{k}:{f}"] = away & ~mine & train, mine
    models = fit_each(fit, split, features, label, learns)
    some = next(iter(models.values()))
    if isinstance(some, Grown):
        each = chances({k: m.trees for k, m in models.items()}, split, some.features, scores)
        return split.withColumn(out, F.map_from_entries(F.transform(each, lambda e: F.struct(F.split_part(e["model"], F.lit(":"), F.lit(1)), e["score"]))))
    raise TypeError("the first model must be one that many can be fitted of at once")


def stacked_leave_one_out(
    split: DataFrame, station: str, label: str, features: list[str], first: str, fit: Fit, thresholds: list[float], name: str,
    at_least: int = MIN_TEST_ROWS,
) -> DataFrame:
    """``leave_one_out`` with the map column ``first`` of ``cross_fitted`` as a further input."""
    tested, _ = large_enough(split.where("split = 'test'"), [station], at_least)
    order = [str(k) for k, _ in enumerate(groups_of(split, station))]
    values = dict(zip(order, groups_of(split, station)))
    kept = [k for k, value in values.items() if value in groups_of(tested, station)]
    # one row per (row, held-out station): the first probability differs between them
    entries = F.map_entries(F.map_filter(first, lambda k, _: k.isin(kept)))
    long = split.select(*[c for c in split.columns if c != first], F.explode(entries).alias("_first"))
    long = materialize(long.select(*[c for c in split.columns if c != first], F.col("_first.key").alias("_held"), F.col("_first.value").alias(first)), "stacked")
    masks, own = {}, {}
    for k in kept:
        mine = F.col("_held") == k
        own[k] = mine & _is(station, values[k])
        masks[k] = mine & ~_is(station, values[k])
    models = fit_each(fit, long, [*features, first], label, {k: m & (F.col("split") == "train") for k, m in masks.items()})
    seen = predict_each(models, long.where("split = 'calibrate'"), masks)
    best = best_threshold(threshold_sweep(seen, ["model"], "score", label, thresholds), ["model"]).select("model", "threshold")
    scored = predict_each(models, long.where("split = 'test'"), own).join(best, "model", "left")
    cut = F.coalesce("threshold", F.lit(0.5))
    return scored.select(station, label, "score", (F.col("score") >= cut).cast("int").alias("pred"), F.lit(name).alias("abordagem"), cut.alias("threshold"))


def evaluate(predictions: DataFrame, group: list[str], label: str, score: str = "score", pred: str = "pred") -> DataFrame:
    """Confusion metrics and AUC per group; the AUC is null for groups without scores.
    Reads the predictions more than once: materialize them if they come from a model."""
    metrics = classification_metrics(predictions, group, label, pred)
    areas = auc(predictions, group, score, label)
    return metrics.join(areas, group, "left") if group else metrics.withColumn("auc_roc", areas.scalar())


def evaluate_by_station(predictions: DataFrame, group: list[str], station: str, label: str) -> DataFrame:
    """Per station and for all stations together."""
    metrics = rolled_up_metrics(predictions, group, station, label, "pred")
    areas = rolled_up_auc(predictions, group, station, "score", label)
    return metrics.join(areas, [*group, station], "left")


def ablation(split: DataFrame, label: str, variants: dict[str, list[str]], fit: Fit, thresholds: list[float]) -> DataFrame:
    """The same rows and split for every feature set; predictions of the test rows."""
    rows = split.dropna(subset=sorted({c for v in variants.values() for c in v} | {label}))
    parts = []
    for name, features in variants.items():
        model = calibrated(fit(rows.where("split = 'train'"), features, label), rows.where("split = 'calibrate'"), label, thresholds)
        test = decided(model, rows.where("split = 'test'"), name)
        parts.append(test.select(label, "score", "pred", "abordagem", "threshold").withColumn("n_features", F.lit(len(features))))
    return stack(parts)


def source_matrix(
    sources: dict[str, DataFrame], keys: list[str], label: str, features: list[str], fit: Fit, thresholds: list[float]
) -> DataFrame:
    """Every training source tested on every source, on the hours all sources have."""
    names = list(sources)
    common = reduce(lambda a, b: a.join(b, keys, "left_semi"), [sources[n] for n in names]).select(*keys)
    aligned = {n: df.join(common, keys, "left_semi") for n, df in sources.items()}
    parts = []
    for trained in names:
        own = aligned[trained]
        model = calibrated(fit(own.where("split = 'train'"), features, label), own.where("split = 'calibrate'"), label, thresholds)
        for tested in names:
            test = decided(model, aligned[tested].where("split = 'test'"), f"treino_{trained}__teste_{tested}")
            parts.append(test.select(label, "score", "pred", "abordagem", "threshold"))
    return stack(parts)


def transfer(model: Fitted, rows: DataFrame, labels: dict[str, str], persistence: str | None = None) -> DataFrame:
    """One model at every station against several labels, with persistence as reference."""
    scored = predict(model, rows, "score").withColumn("pred", (F.col("score") >= model.threshold).cast("int"))
    entry = lambda name, label, pred, score: F.struct(
        F.lit(name).alias("alvo"), F.col(label).cast("int").alias("y"), pred.cast("int").alias("pred"), score.cast("double").alias("score")
    )
    entries = [entry(name, label, F.col("pred"), F.col("score")) for name, label in labels.items()]
    if persistence:
        last = list(labels.items())[-1]
        entries.append(entry(f"persistencia__{last[0]}", last[1], F.col(persistence), F.lit(None)))
    keep = [c for c in ("station_id",) if c in rows.columns]
    return scored.select(*keep, F.inline(F.array(*entries)))


TABLE_NAMES = VENDOR_RENAMES | {"wind_speed_10m": "windspeed"}


def lead_comparison(
    runs: dict[int, DataFrame], truth: DataFrame, keys: list[str], champion: Fitted, fit: Fit, cuts: tuple[str, str],
    thresholds: list[float],
) -> DataFrame:
    """Approaches by lead on the same hours, as long ``(y, abordagem, pred, score)`` rows.

    ``runs`` maps a lead to the dense forecast series of that lead. For each lead: the raw
    forecast and the champion on the features of the forecast series; for leads above 0
    also a model of the forecast of the hour and its neighbours. Only hours on which every
    approach has its inputs are kept, for fitting and for testing.
    """
    time_col = "observation_time"
    hour = [*keys, time_col]
    name = lambda variable: TABLE_NAMES.get(variable, variable)
    prefixed = lambda df, p: df.select(*hour, *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in hour])
    wide = materialize(truth.dropna(), "truth")
    phase_names: list[str] = []
    for lead, series in runs.items():
        # Written one by one: a single plan over all leads would be too large to optimize.
        phase = phase_features(series, keys, name)
        phase_names = [c for c in phase.columns if c not in hour]
        for frame, prefix in ((phase, f"m{lead}_"), (shifted_features(series, keys), f"c{lead}_")):
            wide = wide.join(materialize(prefixed(frame, prefix), f"run-{prefix}"), hour)
    wide = wide.where(F.forall(F.array(*[F.col(c).isNotNull() for c in wide.columns]), lambda known: known))
    split = materialize(split_at(wide, *cuts, ("train", "calibrate", "test")), "lead-rows")
    named = lambda df, p, columns: df.withColumns({c: F.col(f"{p}{c}") for c in columns})
    tested = split.where("split = 'test'")
    for lead in runs:
        tested = predict(champion, named(tested, f"c{lead}_", champion.features), f"_c{lead}").drop(*champion.features)
    approaches = {}
    for lead in runs:
        amount = F.col(f"m{lead}_precipitation")
        approaches[f"api_d{lead}"] = (amount > 0, amount)
        approaches[f"champion_d{lead}"] = (F.col(f"_c{lead}") >= champion.threshold, F.col(f"_c{lead}"))
        if lead > 0:
            part = lambda s: named(split.where(F.col("split") == s), f"m{lead}_", phase_names)
            model = calibrated(fit(part("train"), phase_names, "y"), part("calibrate"), "y", thresholds)
            tested = predict(model, named(tested, f"m{lead}_", phase_names), f"_m{lead}").drop(*phase_names)
            approaches[f"mos_d{lead}"] = (F.col(f"_m{lead}") >= model.threshold, F.col(f"_m{lead}"))
    return materialize(long_decisions(tested, ["y"], approaches), "leads")


def station_folds(rows: DataFrame, station: str, held: dict[str, object], cut: Column, folds: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """Masks of the rows that the models ``held:fold`` and ``held:all`` learn from, and of those they score.

    The folds of a held-out station are whole other stations, and only rows before ``cut`` are
    learned from or scored out of fold; ``held:all`` scores the station's own later rows.
    """
    early = F.col("observation_time") < cut
    sizes = {r[station]: r["n"] for r in rows.where(early).groupBy(station).agg(F.count(F.lit(1)).alias("n")).collect()}
    learns, scores = {}, {}
    for k, value in held.items():
        away = ~_is(station, value)
        learns[f"{k}:all"], scores[f"{k}:all"] = away & early, ~away & ~early
        fold = fold_numbers({s: n for s, n in sizes.items() if s != value}, folds)
        for f in sorted(set(fold.values())):
            mine = reduce(Column.__or__, [_is(station, s) for s, number in fold.items() if number == f])
            learns[f"{k}:{f}"], scores[f"{k}:{f}"] = away & ~mine & early, mine & early
    return learns, scores


def folded_thresholds(scored: DataFrame, label: str, thresholds: list[float]) -> DataFrame:
    """(held, threshold) of best F1 on the out-of-fold scores of each held-out station's models."""
    seen = scored.where(~F.col("model").endswith(":all")).withColumn("held", F.split_part("model", F.lit(":"), F.lit(1)))
    return best_threshold(threshold_sweep(seen, ["held"], "score", label, thresholds), ["held"]).select("held", "threshold")


def approaches_station_out(
    rows: DataFrame, station: str, label: str, features: list[str], cut: Column, fit: Fit, thresholds: list[float],
    folds: int = 4, at_least: int = MIN_TEST_ROWS,
) -> DataFrame:
    """Raw forecast, best single model, votes and a fitted model for every held-out station.

    All choices (model, votes, threshold) come from the other stations before ``cut``;
    the model's threshold from scores out of fold. The models of all stations and folds are
    fitted together. Long rows with station, label, approach, decision and score.
    """
    time_col = "observation_time"
    tested, _ = large_enough(rows.where(F.col(time_col) >= cut), [station], at_least)
    held = {str(k): value for k, value in enumerate(groups_of(tested, station))}
    learns, scores = station_folds(rows, station, held, cut, folds)
    models = fit_each(fit, rows, features, label, learns)
    scored = materialize(predict_each(models, rows, scores), "station-scores")
    others = F.array_compact(F.array(*[F.when(~_is(station, value), F.lit(k)) for k, value in held.items()]))
    train = rows.where(F.col(time_col) < cut).withColumn("held", F.explode(others))
    single = best_per_group(single_model_f1(train, ["held"], label), ["held"], "f1", [F.col("rank_no")]).select("held", "modelo")
    needed = best_vote_count(train, ["held"], label).select("held", F.col("threshold").alias("_votes"))
    chosen = single.join(needed, "held").join(folded_thresholds(scored, label, thresholds), "held")
    test = scored.where(F.col("model").endswith(":all")).withColumn("held", F.split_part("model", F.lit(":"), F.lit(1))).join(chosen, "held")
    known = lambda c: F.coalesce(c, F.lit(0.0))
    alone = known(F.coalesce(*[F.when(F.col("modelo") == m, F.col(f"p_{m}")) for m in ENSEMBLE_MODELS]))
    api = known(F.col("p_best_match"))
    test = test.withColumnRenamed("score", "_prob")
    return long_decisions(test, [station, label], {
        "api": (api > 0, api), "melhor_1": (alone > 0, alone),
        "votos": (vote_count() >= F.col("_votes"), vote_count() / float(len(ENSEMBLE_MODELS))),
        "mos": (F.col("_prob") >= F.col("threshold"), F.col("_prob")),
    })


def weighted_by_hours(metrics: DataFrame, group: list[str], metric: str = "f1") -> DataFrame:
    """Mean of a metric over stations, weighted by their test hours."""
    return metrics.groupBy(*group).agg(weighted_mean(metric, "n").alias(metric), F.sum("n").alias("n"))
