"""Files as a source, stored sketches and named views."""

from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from rainloom.operators.prefix import exact_quantiles
from rainloom.operators.sketches import RANK_ERROR, quantiles, rolled_up, sketched, within_rank_error
from rainloom.plans.views import create_views
from rainloom.sources.planner import missing_periods
from rainloom.sources.series_json import pack_series, read_stored, stored_periods, write_series
from tests.series import T, at


def test_periods_come_from_the_folder(spark, tmp_path):
    folder = str(tmp_path / "series")
    rows = [("A_1", datetime(2024, 1, d, h), float(d * h)) for d in (1, 3) for h in range(4)] + [("7", datetime(2024, 1, 1, 5), 2.5)]
    df = spark.createDataFrame(rows, f"station_id string, {T} timestamp_ntz, rain double")
    write_series(pack_series(df, ["station_id"], T, ["rain"]), folder)
    stored = stored_periods(spark, folder)
    assert {(r["station_id"], r["period"]) for r in stored.collect()} == {("A_1", date(2024, 1, 1)), ("A_1", date(2024, 1, 3)), ("7", date(2024, 1, 1))}
    assert stored.where("fetched_at is null").count() == 0
    back = read_stored(spark, folder, ["rain"]).select("station_id", T, "rain")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    stations = df.select("station_id").distinct()
    plan = lambda **kw: {(r["station_id"], r["period"].day, r["reason"]) for r in missing_periods(
        stations, ["station_id"], stored, "2024-01-01", at("2024-01-03 12:00:00"), period="day", **kw).collect()}
    assert plan() == {("A_1", 2, "missing"), ("A_1", 3, "open"), ("7", 2, "missing"), ("7", 3, "missing")}
    assert ("A_1", 3, "open") not in plan(stale_hours=1)  # just written
    # a later file of the same day adds to what is read
    write_series(pack_series(spark.createDataFrame([("7", datetime(2024, 1, 1, 6), 1.0)], df.schema), ["station_id"], T, ["rain"]), folder)
    assert read_stored(spark, folder, ["rain"]).where("station_id = '7'").count() == 2


def test_sketches_of_days_add_up(spark):
    rng = np.random.default_rng(1)
    values = np.exp(rng.normal(size=40_000))
    rows = [("s" if i % 3 else None, datetime(2024, 1, 1 + i % 9), float(v)) for i, v in enumerate(values)]
    rows += [("s", datetime(2024, 1, 1), None), ("s", datetime(2024, 1, 2), float("nan"))]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double").repartition(6)
    stored = sketched(df, ["k"], "t", "v")
    whole = rolled_up(stored, ["k"])
    assert {(r["k"], r["n"]) for r in whole.select("k", "n").collect()} == {("s", 26_666), (None, 13_334)}
    got = {(r["k"], r["share"]): r["quantile"] for r in quantiles(whole, ["k"], [0.05, 0.5, 0.95]).collect()}
    for k in ("s", None):
        own = np.sort([v for g, _, v in rows if g == k and v is not None and not np.isnan(v)])
        for share in (0.05, 0.5, 0.95):
            assert abs(np.searchsorted(own, got[k, share]) / len(own) - share) < RANK_ERROR
    # two halves merged are as good as the whole
    again = rolled_up(sketched(df.where("day(t) < 5"), ["k"], "t", "v").unionByName(sketched(df.where("day(t) >= 5"), ["k"], "t", "v")), ["k"])
    assert again.agg(F.sum("n")).first()[0] == 40_000
    known = df.where("k is not null and not isnan(v)")
    checked = within_rank_error(quantiles(whole.where("k = 's'"), ["k"], [0.1, 0.9]), known, ["k"], "v")
    assert [r["within"] for r in checked.collect()] == [True, True]
    wrong = quantiles(whole.where("k = 's'"), ["k"], [0.5]).withColumn("quantile", F.lit(50.0))
    assert [r["within"] for r in within_rank_error(wrong, known, ["k"], "v").collect()] == [False]
    assert abs(exact_quantiles(known, ["k"], "v", [0.5]).first()["quantile"] - got["s", 0.5]) < 0.05


def test_views_are_replaced_and_seen_by_other_sessions(spark, tmp_path):
    t, early = datetime(2024, 1, 2, 5), datetime(2024, 1, 1, 20)
    rows = [("a", t, early, 0.91239, 1, 0.0, 0.5, "rain v1", 1), ("a", t, datetime(2024, 1, 2, 1), 0.2, 0, 1.0, 0.5, "rain v2", 1), ("a", t, t, 0.3, 0, 1.0, 0.5, "rain v2", 1)]
    schema = "station_id string, target_time timestamp_ntz, inferencia_local timestamp_ntz, prob_chuva double, pred_vai_chover int, api_precip_alvo double, threshold_usado double, modelo string, id int"
    history, truth = (f"{n}_{tmp_path.name.replace('-', '_')}" for n in ("history", "truth"))
    spark.createDataFrame(rows, schema).write.option("path", str(tmp_path / "h")).saveAsTable(history)
    spark.createDataFrame([(t, 2.0)], f"{T} timestamp_ntz, precipitation double").write.option("path", str(tmp_path / "t")).saveAsTable(truth)
    view = lambda as_of: create_views(spark, history, truth, ["station_id"], ["id"], f"TIMESTAMP_NTZ '{as_of}'", f"hourly_{truth}", f"lead_{truth}")
    view("2024-01-01 00:00:00")
    other = spark.newSession()
    assert other.table(f"hourly_{truth}").count() == 0
    view("2024-01-03 00:00:00")
    row = other.table(f"hourly_{truth}").first()
    assert (row["prob_chuva"], row["modelo"], row["threshold_usado"], row["resultado_classificacao"], row["api_vai_chover"]) == (0.2, "rain v2", 0.5, "Falso Negativo", 1)
    lead = sorted((r["antecedencia_h"], r["faixa_antecedencia"], r["prob_chuva"]) for r in other.table(f"lead_{truth}").collect())
    assert lead == [(4, "01–06 h", 0.2), (9, "07–12 h", 0.912)]
    for name in (f"hourly_{truth}", f"lead_{truth}"):
        spark.sql(f"DROP VIEW {name}")


def test_only_touched_partitions_are_written(spark, tmp_path):
    from rainloom.sinks import tables as sink

    path = str(tmp_path / "t")
    sink.append(spark.createDataFrame([(i, i % 4, float(i)) for i in range(40)], "k int, p int, v double"), path, ["p"])
    files = lambda: {(r["p"], r["f"]) for r in spark.read.parquet(path).select("p", F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = files()
    updates = spark.createDataFrame([(1, None), (5, 7.0), (5, 9.0), (99, 1.0)], "k int, v double")
    for _ in range(2):
        sink.merge_update_partitions(updates, path, ["k"], ["v"], ["p"])
    assert {f for f in before if f[0] != 1} <= files() and not {f for f in before if f[0] == 1} & files()
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {i: float(i) for i in range(40)} | {1: None, 5: 7.0}
    kept = files()
    sink.merge_update_partitions(updates.where("k = 99"), path, ["k"], ["v"], ["p"])
    assert files() == kept


def test_equal_keys_of_one_input_are_added_once(spark, tmp_path):
    from rainloom.sinks import tables as sink

    path = str(tmp_path / "t")
    for rows in ([(1, 2.0), (1, 1.0), (2, None)], [(1, 5.0), (3, 4.0), (3, 3.0)]):
        sink.merge_insert_only(spark.createDataFrame(rows, "k int, v double"), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect() if r["v"]) == [(1, 1.0), (3, 3.0)]
