"""Boosting and forests of histogram trees, and the protocols that fit many of them at once."""

import glob
import os
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.operators import bagging, boosting
from rainloom.operators.bagging import ForestSettings, forests
from rainloom.operators.boosting import Settings, ensembles
from rainloom.operators.metrics import auc, grid
from rainloom.operators.models import Grower, fit_bagged, fit_boosted, fit_forest, load_model, predict, save_model
from rainloom.operators.splits import assign_folds, fold_numbers
from rainloom.plans.evaluation import (
    approaches_station_out, cross_fitted, fit_each, leave_one_out, out_of_fold, predict_each, stacked_leave_one_out,
)
from rainloom.plans.training import retrain_into, train_ensemble
from tests.series import T, at

NAMES = ["a", "b", "c", "d"]


def table(n=200, missing=0.2, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, len(NAMES))), 2)
    x[rng.random(x.shape) < missing] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=1.5) + np.nan_to_num(x[:, 2]) * np.nan_to_num(x[:, 3]) > 0.3).astype(float)
    return x, y


def frame(spark, x, y, parts=5):
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t), f"s{i % 4}") for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, g string").repartition(parts)


def brute_tree(x, gradient, curve, s):
    """Best-first growth by trying every value of every input and both sides for missing values."""
    def best(rows):
        found = None
        g, h = gradient[rows].sum(), curve[rows].sum()
        for f in range(x.shape[1]):
            known = ~np.isnan(x[rows, f])
            for v in np.unique(x[rows, f][known]):
                for side in (False, True):
                    left = np.where(known, x[rows, f] <= v, side)
                    if min(left.sum(), (~left).sum()) < s.least_rows:
                        continue
                    gl, hl = gradient[rows[left]].sum(), curve[rows[left]].sum()
                    gain = gl**2 / (hl + s.l2) + (g - gl) ** 2 / (h - hl + s.l2) - g**2 / (h + s.l2)
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = gain, f, v, left
        return found

    leaves = {1: np.arange(len(x))}
    splits = {1: best(leaves[1])}
    while len(leaves) < s.leaves and any(splits[p] for p in leaves):
        path = min((p for p in leaves if splits[p]), key=lambda p: (-splits[p][0], p))
        left, rows = splits[path][3], leaves.pop(path)
        for child, part in ((2 * path, rows[left]), (2 * path + 1, rows[~left])):
            leaves[child], splits[child] = part, best(part)
    scores = np.zeros(len(x))
    for rows in leaves.values():
        scores[rows] = -s.step * gradient[rows].sum() / (curve[rows].sum() + s.l2)
    return scores


def test_rounds_equal_trying_every_split(spark):
    x, y = table()
    s = Settings(rounds=3, least_rows=10, leaves=5)
    model = ensembles(frame(spark, x, y), NAMES, "y", {"all": F.lit(True)}, s)["all"]
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(3):
        p = 1 / (1 + np.exp(-raw))
        raw += brute_tree(x, p - y, p * (1 - p), s)
    assert model.raw(x) == pytest.approx(raw, abs=1e-6)
    assert max(len([f for f in t.feature if f < 0]) for t in model.trees) == 5


def test_both_ways_grow_the_same_models(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REPLAY", 2)
    monkeypatch.setattr(bagging, "NODES", 16)
    x, y = table(400)
    rows = frame(spark, x, y)
    masks = {f"without {k}": F.col("g") != k for k in ("s0", "s1")} | {"all": F.lit(True), "none": F.lit(False)}
    for fit, s in ((ensembles, Settings(rounds=3)), (forests, ForestSettings(trees=2, depth=4, least_rows=5))):
        one, other = (fit(rows.repartition(n), NAMES, "y", masks, s, local_cells=cells) for n, cells in ((3, None), (6, 0)))
        assert {m: one[m].dumps() for m in masks} == {m: other[m].dumps() for m in masks}
        assert one["none"].trees == [] and one["all"].trees


def test_missing_values_are_data(spark):
    rows = spark.createDataFrame([(None if i % 3 else float(i), float("nan") if i % 2 else 1.0, int(i % 3 > 0)) for i in range(300)], "a double, b double, y int")
    model = fit_boosted(rows, ["a", "b"], "y")
    out = predict(model, rows)
    assert out.columns == ["a", "b", "y", "prob"]
    assert out.where("(prob > 0.5) != (y = 1)").count() == 0 and out.where("prob is null").count() == 0
    flat = fit_boosted(rows.withColumn("y", F.lit(1)), ["a", "b"], "y")
    assert flat.trees.trees == [] and predict(flat, rows).agg(F.min("prob")).first()[0] > 0.99


def test_models_round_trip(spark, tmp_path):
    x, y = table()
    rows = frame(spark, x, y)
    for k, fit in enumerate((Grower(Settings(rounds=4), "boosted"), Grower(ForestSettings(3, 4, 5), "bagged"))):
        model = fit(rows, NAMES, "y")
        save_model(spark, model, str(tmp_path / f"m{k}"))
        again = load_model(spark, str(tmp_path / f"m{k}"))
        assert again == model and again.label == f"{fit.name} v1"


def test_bags_and_their_class_totals(spark):
    seeds = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, size=200_000)
    counts = bagging.bag_counts(seeds, 7)
    assert [np.mean(counts == k) for k in range(4)] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.005)
    assert abs(np.corrcoef(counts, bagging.bag_counts(seeds, 8))[0, 1]) < 0.01
    label = (np.arange(len(seeds)) % 50 == 0).astype(float)
    ones, zeros = int(counts[label > 0].sum()), int(counts[label == 0].sum())
    positive, weight = bagging.weighted(counts, label, bagging.class_weights(zeros, ones))
    assert positive.sum() / weight.sum() == pytest.approx(0.5, abs=1e-6)
    assert weight.sum() / boosting.UNIT == pytest.approx(counts.sum(), rel=1e-6)
    x, y = table(300, missing=0)
    binned, _, _ = boosting.binned_table(frame(spark, x, y), NAMES, "y", {"all": F.lit(True)})
    got = bagging.bag_totals(binned, ForestSettings(trees=3))
    facts = binned.toPandas()
    for t in range(3):
        n = bagging.bag_counts(facts["seed"].to_numpy(), t)
        assert got[0, t] == (n[facts["y"] == 0].sum(), n[facts["y"] == 1].sum())


def test_forest_learns(spark):
    x, y = table(1500, missing=0)
    model = Grower(ForestSettings(40, 8, 5), "bagged", complete=True)(frame(spark, x[:1000], y[:1000]), NAMES, "y")
    p = model.trees.probability(x[1000:])
    assert np.mean((p > 0.5) == y[1000:]) > 0.88


def stations(spark, n, hours=60, signal=True):
    rng = np.random.default_rng(n)
    rows = []
    for s in range(n):
        for h in range(hours):
            x = float(rng.normal())
            y = int((x if signal else rng.normal()) + 0.3 * rng.normal() > 0.4)
            split = "train" if h < hours * 0.6 else "calibrate" if h < hours * 0.8 else "test"
            rows.append((f"s{s:02d}", h, x, float(s), y, split, max(x, 0.0)))
    df = spark.createDataFrame(rows, "station_id string, h int, x double, own double, y int, split string, p_best_match double")
    return df.withColumn(T, at("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.col("h")))


def test_thirty_stations_take_the_jobs_of_five(spark):
    small = Grower(Settings(rounds=5, least_rows=5), "boosted")

    def jobs(n):
        group = f"stations-{n}"
        spark.sparkContext.setJobGroup(group, group)
        rows = leave_one_out(stations(spark, n), "station_id", "y", {"m": ["x"]}, small, grid(10, 90, 10), at_least=5).collect()
        spark.sparkContext.setJobGroup("other", "other")
        assert len(rows) == n * 12 and np.mean([r["pred"] == r["y"] for r in rows]) > 0.75
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(30) <= jobs(5) + 5


def test_stations_out_and_ensemble_training(spark):
    rows = stations(spark, 6).withColumns({f"p_{m}": F.col("x") * k for k, m in enumerate(["ecmwf_ifs025", "gfs_seamless", "icon_seamless", "jma_seamless", "gem_seamless"], 1)})
    small, cut = Grower(Settings(rounds=5, least_rows=5), "boosted"), at("2024-01-02 12:00:00")
    long = approaches_station_out(rows, "station_id", "y", ["x"], cut, small, grid(10, 90, 10), folds=3, at_least=5)
    counts = {(r["abordagem"], r["station_id"]): r["count"] for r in long.groupBy("abordagem", "station_id").count().collect()}
    assert set(counts.values()) == {24} and len(counts) == 4 * 6
    final, ledger = train_ensemble(rows, "station_id", ["x"], "y", "p_best_match", cut, small, 3, at("2024-02-01 00:00:00"), at_least=5)
    row = ledger.first()
    assert (final.version, row["version"], row["train_size"], row["test_size"]) == (3, 3, 360, 144) and 0.05 <= final.threshold <= 0.95


def test_a_stack_never_sees_the_held_out_station(spark):
    # the label is noise that only a station's own rows can tell: a leak would show as a perfect score
    rows = stations(spark, 6, signal=False).withColumn("key", F.col("own") * 1000 + F.col("h"))
    remember = Grower(ForestSettings(20, 15, 1, balance="all"), "first", complete=True)
    stacked = cross_fitted(rows, "station_id", ["key", "x"], "y", remember, "first", folds=2)
    own = stacked.select("y", "station_id", F.explode("first").alias("held", "score"))
    assert own.count() == rows.count() * 6
    assert own.groupBy("held").count().distinct().count() > 0
    area = auc(own, [], "score", "y").first()[0]
    assert 0.4 < area < 0.6
    second = Grower(Settings(rounds=10, least_rows=5), "second")
    got = stacked_leave_one_out(stacked, "station_id", "y", ["x"], "first", second, grid(10, 90, 10), "both", at_least=5)
    assert got.count() == rows.where("split = 'test'").count()
    assert 0.3 < auc(got, [], "score", "y").first()[0] < 0.7


def test_out_of_fold_and_side_by_side_fits(spark):
    rows = stations(spark, 5)
    scored = out_of_fold(rows, ["station_id"], 3, ["x"], "y", Grower(Settings(rounds=5, least_rows=5), "b"))
    assert scored.count() == rows.count() and scored.where("score is null").count() == 0
    from rainloom.operators.models import fit_forest

    masks = {k: F.col("station_id") != k for k in ("s00", "s01")}
    models = fit_each(lambda df, names, label: fit_forest(df, names, label, trees=3, depth=3), rows, ["x"], "y", masks)
    each = predict_each(models, rows, {k: ~c for k, c in masks.items()})
    assert {(r["model"], r["station_id"]) for r in each.select("model", "station_id").distinct().collect()} == {("s00", "s00"), ("s01", "s01")}


@pytest.mark.parametrize("folds", [1, 3, 4])
def test_folds_by_the_lightest(spark, folds):
    rng = np.random.default_rng(folds)
    sizes = {None: 7} | {f"g{k:02d}": int(rng.choice([1, 2, 2, 3, 9, 40])) for k in range(50)}
    rows = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    got = {r["g"]: r["fold"] for r in assign_folds(rows, ["g"], folds).select("g", "fold").distinct().collect()}
    load = [0] * folds
    for g in sorted(sizes, key=lambda g: (-sizes[g], g is not None, g or "")):
        assert got[g] == load.index(min(load))
        load[got[g]] += sizes[g]
    assert got == fold_numbers(sizes, folds)


def test_full_settings_are_the_defaults():
    assert fit_boosted.settings == Settings(rounds=300, step=0.05, leaves=31, l2=1.0, least_rows=20)
    assert fit_bagged.settings == ForestSettings(trees=300, depth=12, least_rows=20, balance="bag")


def test_a_kept_champion_gets_new_metrics_in_the_stored_ledger(spark, tmp_path):
    """The champion sees a column that tells the label, later versions only noise."""
    days = spark.range(4 * 365).select(
        (F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("observation_time"),
        (F.abs(F.hash("id")) % 2).alias("y"), (F.abs(F.hash("id")) % 2 + F.rand(1) / 4).alias("told"), F.rand(2).alias("noise"),
    )
    path, small = str(tmp_path / "ledger"), partial(fit_forest, trees=3, depth=3)
    month = lambda name: at(f"{name}-01 00:00:00")
    first = retrain_into(path, days, ["told"], "y", month("2023-06"), small, 1, month("2023-06"))
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/version=1/*.parquet")}
    kept = retrain_into(path, days, ["noise"], "y", month("2023-08"), small, 2, month("2023-08"), first)
    assert kept is first and kept.version == 1
    rows = {r["version"]: r for r in spark.read.parquet(path).collect()}
    assert rows[1]["promoted"] and not rows[2]["promoted"] and rows[1]["f1"] > rows[2]["f1"]
    assert rows[1]["train_size"] < rows[2]["train_size"] and rows[1]["test_size"] == rows[2]["test_size"]
    assert rows[1]["test_rain_rate"] == rows[2]["test_rain_rate"]
    assert not set(before) & set(glob.glob(f"{path}/version=1/*.parquet"))
    third = retrain_into(path, days, ["told", "noise"], "y", month("2023-09"), small, 3, month("2023-09"), kept)
    assert third.version in (1, 3) and spark.read.parquet(path).count() == 3
