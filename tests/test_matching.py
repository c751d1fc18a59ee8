"""As-of matching, lags, calendars, splits, ensembles, models."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rainloom.catalog import queries
from rainloom.constants import ENSEMBLE_MODELS
from rainloom.functions.ensemble import live_name, row_max, row_mean, vote_share, votes
from rainloom.functions.labels import alert_level, outcome
from rainloom.functions.timeparts import gauge_day, hour_floor, hour_from_index, hour_index, lead_hours, lead_range
from rainloom.operators.ensemble_features import ensemble_feature_names, ensemble_features
from rainloom.operators.joins import all_but_own, monthly_index_filled
from rainloom.operators.models import (
    calibrated, fit_amount, fit_forest, importances, load_model, predict, predict_amount, save_model,
)
from rainloom.operators.splits import assign_folds, large_enough, months_before, rolling_split, trailing_per_group
from rainloom.operators.verification import accuracy_hourly, lag_scores, latest_before_target, shifted_join
from tests.series import T, as_set, at


def test_latest_forecast_strictly_before_target(spark):
    t = datetime(2024, 1, 2)
    rows = [("a", t, datetime(2024, 1, 1, 6), 0.2, 0), ("a", t, datetime(2024, 1, 1, 12), 0.9, 1), ("a", t, t, 0.1, 0)]
    history = spark.createDataFrame(
        [(*r, 0.0) for r in rows],
        "station_id string, target_time timestamp_ntz, inferencia_local timestamp_ntz, prob_chuva double, pred_vai_chover int, api_precip_alvo double",
    )
    assert latest_before_target(history, ["station_id"], []).first()["prob_chuva"] == 0.9
    truth = spark.createDataFrame([(t, 1.2)], f"{T} timestamp_ntz, precipitation double")
    assert accuracy_hourly(history, truth, ["station_id"], []).first()["resultado_classificacao"] == "Verdadeiro Positivo"
    assert accuracy_hourly(history, truth, ["station_id"], [], as_of=at("2024-01-01 00:00:00")).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(0.85, 1, 0), (0.849, 0, 1), (0.4, None, 1), (0.39, 0, 0)], "p double, y int, d int")
    rows = df.select(alert_level(F.col("p")).alias("a"), outcome(F.col("y"), F.col("d")).alias("o")).collect()
    assert [r["a"][0] for r in rows] == ["🔴", "🟠", "🟡", "🟢"]
    assert [r["o"] for r in rows] == ["Falso Negativo", "Falso Positivo", None, "Verdadeiro Negativo"]


def test_time_parts(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 1, 6, 59, 59), datetime(2024, 3, 1))], "t timestamp_ntz, i timestamp_ntz")
    t, i = F.col("t"), F.col("i")
    r = df.select(
        hour_floor(t).alias("h"), hour_from_index(hour_index(t)).alias("back"), lead_hours(t, i).alias("lead"),
        lead_range(t, i).alias("range"), gauge_day(t, 7, 0).alias("d0"), gauge_day(t, 7, 1).alias("d1"),
        months_before(F.lit(datetime(2024, 3, 31, 5)).cast("timestamp_ntz"), 1).alias("m"),
    ).first()
    assert r["h"] == r["back"] == datetime(2024, 3, 1, 6)
    assert (r["lead"], r["range"]) == (7, "07–12 h")
    assert (r["d0"], r["d1"]) == (date(2024, 3, 1), date(2024, 2, 29))
    assert r["m"] == datetime(2024, 2, 29, 5)


def test_results_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(datetime(2018, 11, 4, 0, 30),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")  # 00:30 was skipped there that day
        assert df.select(hour_floor(F.col("t")).alias("h")).first()["h"] == datetime(2018, 11, 4, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_row_statistics_with_missing_models(spark):
    df = spark.createDataFrame([(0.1, None, 0.3), (None, None, None), (0.0, 0.0, 0.05)], "a double, b double, c double")
    v = [F.col(c) for c in "abc"]
    rows = df.select(row_mean(v), row_max(v), votes(v), vote_share(v), vote_share(v, null_if_all_missing=False)).collect()
    assert tuple(rows[0]) == (pytest.approx(0.2), 0.3, 2, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert tuple(rows[1]) == (None, None, 0, None, 0.0)
    assert rows[2][2] == 0


def test_ensemble_features_allow_absent_models(spark):
    rows = [(datetime(2024, 1, 1, h), float(h)) for h in range(4)]
    df = spark.createDataFrame(rows, f"{T} timestamp_ntz, precipitation_best_match double")
    out = ensemble_features(df, [], live_name).orderBy(T)
    assert out.columns == [T, *ensemble_feature_names()] and len(ensemble_feature_names()) == 35
    r = out.collect()
    assert [x["p3_best_match"] for x in r] == [1.0, 3.0, 6.0, 5.0]
    assert r[0]["ens_frac"] == 0.0 and r[1]["ens_frac"] == pytest.approx(1 / len(ENSEMBLE_MODELS))


def test_best_lag_is_found(spark):
    base = [(datetime(2024, 1, 1 + i // 24, i % 24), float((i * 7) % 11)) for i in range(100)]
    a = spark.createDataFrame([("s", t, v) for t, v in base], f"station_id string, {T} timestamp_ntz, obs double")
    b = a.select("station_id", (F.col(T) - F.expr("INTERVAL 2 HOURS")).alias(T), F.col("obs").alias("est"))
    scores = {r["defasagem_h"]: r["corr"] for r in lag_scores(shifted_join(a, b, ["station_id"], [-2, -1, 0, 1, 2]), "obs", "est", 0.2).collect()}
    assert scores[2] == pytest.approx(1.0) and max(scores, key=scores.get) == 2


def test_monthly_index_never_uses_the_future(spark):
    index = spark.createDataFrame([(date(2024, 1, 1), 0.5), (date(2024, 4, 1), 0.9)], "mes date, oni double")
    got = {r["mes"].month: r["oni"] for r in monthly_index_filled(index, "mes", "oni", F.lit("2024-06-01").cast("date")).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.5, 4: 0.9, 5: 0.9, 6: 0.9}


def test_complement_totals(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "s string, n int")
    assert {r["s"]: r["n"] for r in all_but_own(df, "s", ["n"]).collect()} == {"a": 6, "b": 5, "c": 3}


def test_splits_and_folds(spark):
    rows = [("a", datetime(2023, m, 1), m) for m in range(1, 13)] + [("b", datetime(2022, 6, 1), 0)]
    df = spark.createDataFrame(rows, f"station_id string, {T} timestamp_ntz, n int")
    split = rolling_split(df, at("2023-12-01 00:00:00"), 3, 3)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 6, "calibrate": 3, "test": 4}
    assert trailing_per_group(df, ["station_id"], 2).count() == 3
    kept, skipped = large_enough(df, ["station_id"], 5)
    assert kept.count() == 12 and [tuple(r) for r in skipped.collect()] == [("b", 1)]
    folds = assign_folds(df, ["station_id"], 5)
    assert folds.select("station_id", "fold").distinct().count() == 2
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {0, 1}


def test_folds_are_even_and_keep_null_groups(spark):
    rows = [(None if k == 0 else f"s{k}", i) for k in range(200) for i in range(1 + k % 17)]
    folds = assign_folds(spark.createDataFrame(rows, "s string, i int"), ["s"], 4)
    sizes = [r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(rows) and len(sizes) == 4 and max(sizes) - min(sizes) <= 17
    assert folds.groupBy("s").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0


def test_null_stations_are_kept(spark):
    rows = [(None, datetime(2023, m, 1), m) for m in range(1, 5)] + [("a", datetime(2023, m, 1), m) for m in range(1, 5)]
    df = spark.createDataFrame(rows, f"station_id string, {T} timestamp_ntz, n int")
    assert trailing_per_group(df, ["station_id"], 2).where("station_id is null").count() == 2
    assert large_enough(df, ["station_id"], 3)[0].count() == 8


@pytest.fixture(scope="module")
def learnable(spark):
    rows = [(float(i % 10), float((i * 7) % 13), int(i % 10 >= 6)) for i in range(300)]
    return spark.createDataFrame(rows, "x double, z double, y int")


def test_forest_learns_calibrates_and_round_trips(spark, learnable, tmp_path):
    model = calibrated(fit_forest(learnable, ["x", "z"], "y", trees=5, depth=3), learnable, "y", [0.1, 0.5, 0.9])
    assert importances(model)[0][0] == "x"
    save_model(spark, model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert (again.features, again.threshold, again.label) == (["x", "z"], model.threshold, "forest v1")
    assert as_set(predict(model, learnable)) == as_set(predict(again, learnable))


def test_forest_of_dry_rows_is_sure_of_no_event(spark, learnable):
    dry = learnable.withColumn("y", F.lit(0))
    model = calibrated(fit_forest(dry, ["x", "z"], "y", trees=3, depth=3), dry, "y", [0.1, 0.5])
    assert {r["prob"] for r in predict(model, learnable).collect()} == {0.0}


def test_amounts_without_a_wet_row(spark, learnable):
    rows = learnable.withColumn("rain", F.lit(0.0))
    amount = fit_amount(rows, ["x", "z"], "rain", trees=3, depth=3)
    dry = fit_forest(rows.withColumn("y", F.lit(0)), ["x", "z"], "y", trees=3, depth=3)
    assert {r["amount"] for r in predict_amount(dry, amount, rows).collect()} == {0.0}
    wet = predict_amount(fit_forest(rows, ["x", "z"], "y", trees=3, depth=3), amount, rows).collect()
    assert {r["amount"] for r in wet} == {0.0, None}


@pytest.fixture(scope="module")
def late_forecasts(spark, tmp_path_factory):
    """Three forecasts of June and one of December 2001, each for a day with orders."""
    days = [datetime(2001, 6, 1), datetime(2001, 6, 2), datetime(2001, 12, 1), datetime(2001, 12, 2)]
    orders = [(k, day, price) for k, (day, price) in enumerate(zip(days, (300000.0, 200000.0, 300000.0, 300000.0)))]
    lines = [(0, 1, 5, days[1], 0.02, 0.05), (0, 2, 5, days[1], 0.08, 0.05), (0, 3, 6, days[1], 0.01, 0.02), (2, 1, 5, days[3], 0.09, 0.08)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp_ntz, l_discount double, l_tax double"
    ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_view_in_sql_counts_all_observed_hours(spark, late_forecasts):
    assert [(r["n"], r["acertos"]) for r in queries()["sql_over_view"](spark, late_forecasts).collect()] == [(4, 3)]
    assert queries()["accuracy_by_lead_view"](spark, late_forecasts).count() == 3


def test_lead_ranges_are_scored_over_all_observed_hours(spark, late_forecasts):
    row = queries()["lead_range_scores"](spark, late_forecasts).first()
    assert (row["vp"], row["fp"], row["fn"], row["vn"], row["n"]) == (1, 1, 0, 2, 4)
