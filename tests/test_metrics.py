"""Scores against brute force and edge cases."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from rainloom.functions.numeric import guarded_corr
from rainloom.operators.baselines import best_vote_count
from rainloom.operators.metrics import (
    ALL, auc, best_threshold, classification_metrics, grid, median_threshold, regression_metrics, roc_points,
    rolled_up_auc, rolled_up_metrics, threshold_sweep,
)
from rainloom.operators.prefix import exact_quantiles
from rainloom.operators.profile import class_balance, column_profile, correlations, histogram, null_report
from rainloom.operators.verification import contingency


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randint(0, 1), round(rng.random(), 2)) for _ in range(600)]
    rows += [("one", 1, 0.4), ("one", 1, 0.6), ("hot", 0, 0.5)] + [("hot", i % 2, 0.5) for i in range(99)]
    return spark.createDataFrame(rows, "g string, y int, p double")


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("splits", [None, [], [0.1, 0.5, 0.77]])
def test_auc_is_exact_whatever_the_splits(scored, splits):
    rows = scored.collect()
    for r in auc(scored, ["g"], "p", "y", splits).collect():
        expected = brute_auc([(x["y"], x["p"]) for x in rows if x["g"] == r["g"]])
        assert r["auc_roc"] == (None if expected is None else pytest.approx(expected))


@pytest.mark.parametrize("splits", [None, [0.2, 0.6]])
def test_rolled_up_auc_equals_brute_force(scored, splits):
    odd = scored.withColumn("g", F.when(F.col("g") != "b", F.col("g")))
    rows = odd.collect()
    got = {r["g"]: r["auc_roc"] for r in rolled_up_auc(odd, [], "g", "p", "y", splits).collect()}
    assert set(got) == {r["g"] for r in rows} | {ALL}
    for g, area in got.items():
        expected = brute_auc([(x["y"], x["p"]) for x in rows if g == ALL or x["g"] == g])
        assert area == (None if expected is None else pytest.approx(expected))


def test_auc_agrees_with_evaluator(scored):
    ours = auc(scored, [], "p", "y", [0.3, 0.6]).first()["auc_roc"]
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    assert ours == pytest.approx(evaluator.evaluate(scored.withColumn("y", F.col("y").cast("double"))))


def test_roc_ends_at_one(scored):
    last = roc_points(scored.where("g = 'a'"), ["g"], "p", "y", [0.5]).orderBy("threshold").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_sweep_equals_direct_counts_and_lowest_tie_wins(scored):
    thresholds = grid(5, 95, 5)
    assert thresholds[2] == 0.15 and len(thresholds) == 19
    sweep = threshold_sweep(scored, ["g"], "p", "y", thresholds)
    rows = scored.collect()
    for r in sweep.collect():
        hit = sum(1 for x in rows if x["g"] == r["g"] and x["y"] == 1 and x["p"] >= r["threshold"])
        assert r["vp"] == hit and r["n"] == sum(1 for x in rows if x["g"] == r["g"])
    best = {r["g"]: r["threshold"] for r in best_threshold(sweep, ["g"]).collect()}
    assert best["one"] == 0.05 and best["hot"] == 0.05


def test_threshold_above_every_score(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, p double")
    r = {x["threshold"]: x for x in threshold_sweep(df, [], "p", "y", [0.05, 0.9]).collect()}
    assert (r[0.9]["vp"], r[0.9]["fn"], r[0.9]["vn"], r[0.9]["f1"]) == (0, 1, 1, 0.0)


def test_median_of_fold_thresholds(spark):
    df = spark.createDataFrame([(0.05,), (0.10,), (0.15,), (0.20,)], "threshold double")
    assert median_threshold(df).first()["threshold"] == pytest.approx(0.125)


def test_confusion_sums_and_rollup(scored):
    pred = scored.withColumn("d", (F.col("p") >= 0.5).cast("int"))
    rows = rolled_up_metrics(pred, [], "g", "y", "d").collect()
    total = next(r for r in rows if r["g"] == "todas")
    assert total["n"] == scored.count() == sum(r["n"] for r in rows if r["g"] != "todas")
    assert total["vp"] + total["fp"] + total["fn"] + total["vn"] == total["n"]
    none = classification_metrics(pred.where("d = 0 AND y = 0"), [], "y", "d").first()
    assert (none["precision"], none["recall"], none["f1"], none["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


@pytest.mark.parametrize("splits", [None, [], [0.2, 0.4, 0.6]])
def test_exact_quantiles(scored, splits):
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(scored.select("g", F.col("p").alias("v")), ["g"], "v", probs, splits).collect()}
    for g in ("a", "b", "hot", "one"):
        values = sorted(x["p"] for x in scored.where(F.col("g") == g).collect())
        for p in probs:
            rank = p * (len(values) - 1)
            lo, hi = int(rank), min(int(rank) + 1, len(values) - 1)
            assert got[(g, p)] == pytest.approx(values[lo] + (values[hi] - values[lo]) * (rank - lo))


def test_regression_metrics_of_constant_truth(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "y double, yhat double")
    rows = {r["rows"]: r for r in regression_metrics(df, [], "y", "yhat").collect()}
    assert rows["all"]["rmse"] == 1.0 and rows["all"]["r2"] is None and rows["wet"]["n"] == 0


def test_correlation_of_constant_and_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "x double, y double, c double")
    r = df.agg(guarded_corr(F.col("x"), F.col("y")).alias("xy"), guarded_corr(F.col("x"), F.col("c")).alias("xc")).first()
    assert r["xy"] == pytest.approx(1.0) and r["xc"] is None
    assert {x["feature"]: x["corr"] for x in correlations(df, ["y", "c"], "x").collect()}["c"] is None


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, 0), (3.0, 1), (None, 1)], "x double, y int")
    p = column_profile(df, ["x"]).first()
    assert (p["nulls"], p["mean"], p["min"], p["max"]) == (1, 2.0, 1.0, 3.0)
    assert null_report(df, ["x", "y"]).collect()[0].asDict() == {"feature": "x", "nulls": 1, "pct": 33.3}
    assert {r["y"]: r["pct"] for r in class_balance(df, "y").collect()} == {0: 33.3, 1: 66.7}


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    bins = {r["bin"]: r["n"] for r in histogram(df, "x", 5).collect()}
    assert bins == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [(r["bin"], r["n"]) for r in histogram(same, "x", 5).collect()] == [(0, 2)]


def test_contingency_limit_zero_is_strict(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.2, 0.6), (0.7, 0.0), (None, 1.0)], "om double, ob double")
    rows = {r["limiar_mm"]: r for r in contingency(df, [], "om", "ob", [0.0, 0.5]).collect()}
    assert (rows[0.0]["vp"], rows[0.0]["fp"], rows[0.0]["fn"], rows[0.0]["vn"]) == (1, 1, 0, 1)
    assert (rows[0.5]["vp"], rows[0.5]["fp"], rows[0.5]["fn"], rows[0.5]["csi"]) == (0, 1, 1, 0.0)


def test_every_vote_threshold_can_win(spark):
    models = ["m1", "m2", "m3"]
    rows = [(1, 1.0, None, 0.0), (1, 0.0, 2.0, 0.0), (0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "y int, p_m1 double, p_m2 double, p_m3 double")
    assert best_vote_count(df, [], "y", models).first()["threshold"] == 1.0
