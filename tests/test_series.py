"""Grid, blocks, features and their invariants."""

from datetime import datetime

import pytest
from pyspark.sql import Window, functions as F

from rainloom.constants import ALL_FEATURES, BASE_FEATURES
from rainloom.operators.blocks import forward_fill, over_blocks
from rainloom.operators.features import add_features, feature_store, lag_columns, rolling_columns
from rainloom.operators.grid import densify, keep_one, merge_repeated_hours, normalise_missing
from rainloom.plans.feature_table import incremental_features, update_feature_table
from tests.series import T, as_set, at, hourly

KEY = ["station_id"]


def test_densify_fills_every_hour(spark):
    dense = densify(hourly(spark, 30, drop=(7, 8)), KEY, T)
    assert dense.count() == 30
    assert dense.where("temperature_2m IS NULL").count() == 2


@pytest.mark.parametrize("block_steps", [24, 31, 200])
def test_blocks_equal_one_window(spark, block_steps):
    dense = densify(hourly(spark, 150, ("a", "b"), drop=(40, 41, 90)), KEY, T)
    build = lambda w: {**lag_columns(w), **rolling_columns(w), "next": F.lead("precipitation", 1).over(w)}
    whole = Window.partitionBy("station_id").orderBy(T)
    expected = dense.select(*KEY, T, *[c.alias(n) for n, c in build(whole).items()])
    got = over_blocks(dense, KEY, T, 24, 1, build, block_steps).select(*expected.columns)
    assert as_set(got) == as_set(expected)


def test_block_shorter_than_context_is_refused(spark):
    with pytest.raises(ValueError):
        over_blocks(hourly(spark, 3), KEY, T, 24, 1, lag_columns, block_steps=12)


def test_year_border_keeps_history(spark):
    store = feature_store(densify(hourly(spark, 24 * 10, start="2023-12-28 00:00:00"), KEY, T), KEY)
    assert store.where(F.col(T) == at("2024-01-01 00:00:00")).count() == 1
    assert store.count() == 24 * 10 - 24 - 1


@pytest.mark.parametrize("cuts", [("2023-12-28 05:00:00",), ("2023-12-27 05:00:00", "2023-12-29 23:00:00", "2023-12-30 00:00:00")])
def test_incremental_equals_full_build(spark, cuts):
    dense = densify(hourly(spark, 200, ("a", "b"), drop=(60, 61, 62)), KEY, T)
    store = feature_store(dense.where(F.col(T) <= at(cuts[0])), KEY)
    for cut in (*cuts[1:], "2024-12-31 00:00:00"):
        store = store.unionByName(incremental_features(dense.where(F.col(T) <= at(cut)), store, KEY))
    assert as_set(store) == as_set(feature_store(dense, KEY))


def test_new_station_is_built_in_full(spark):
    dense = densify(hourly(spark, 100, ("a", "b")), KEY, T)
    store = feature_store(dense.where("station_id = 'a'"), KEY)
    fresh = incremental_features(dense, store, KEY)
    assert {r[0] for r in fresh.select("station_id").distinct().collect()} == {"b"}
    assert fresh.count() == 100 - 25


def test_features_do_not_see_the_future(spark):
    dense = densify(hourly(spark, 120), KEY, T)
    cut = at("2023-12-28 00:00:00")
    changed = dense.withColumns({
        c: F.when(F.col(T) > cut, F.col(c) + 1000).otherwise(F.col(c)) for c in dense.columns if c not in (*KEY, T)
    })
    past = lambda df: add_features(df, KEY).where(F.col(T) <= cut).select(*KEY, T, *ALL_FEATURES)
    assert as_set(past(dense)) == as_set(past(changed))


def test_feature_values_by_hand(spark):
    dense = densify(hourly(spark, 40), KEY, T)
    rows = {r[T]: r for r in add_features(dense, KEY).collect()}
    t = datetime(2023, 12, 26, 6)
    now, before = rows[t], rows[datetime(2023, 12, 26, 5)]
    assert now["temp_lag_1h"] == before["temperature_2m"]
    assert now["temp_delta_1h"] == pytest.approx(now["temperature_2m"] - before["temperature_2m"])
    assert now["temp_lag_24h"] == rows[datetime(2023, 12, 25, 6)]["temperature_2m"]
    assert now["precip_rolling_3h"] == pytest.approx(sum(rows[datetime(2023, 12, 26, h)]["precipitation"] for h in (4, 5, 6)), abs=1e-3)
    assert (now["hour"], now["month"], now["weekday"], now["is_rainy_season"], now["is_afternoon"]) == (6, 12, 3, 1, 0)
    assert now["dewpoint_depression"] == pytest.approx(now["temperature_2m"] - now["dew_point_2m"])
    assert set(BASE_FEATURES) <= set(now.asDict())


def test_forward_fill_crosses_empty_blocks(spark):
    dense = densify(hourly(spark, 100, drop=tuple(range(10, 80))), KEY, T).select(*KEY, T, "temperature_2m")
    filled = forward_fill(dense, KEY, T, "temperature_2m", block_steps=16)
    whole = Window.partitionBy("station_id").orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
    expected = dense.withColumn("temperature_2m", F.last("temperature_2m", ignorenulls=True).over(whole))
    assert as_set(filled) == as_set(expected)


def test_repeated_local_hour_is_summed_and_unknown_stays_unknown(spark):
    t = datetime(2019, 2, 16, 23)
    rows = [("a", t, 1.5, 20.0), ("a", t, 2.0, 19.0), ("b", t, None, None), ("b", t, None, 18.0)]
    df = spark.createDataFrame(rows, f"station_id string, {T} timestamp_ntz, mm double, temp double")
    out = {r["station_id"]: (r["mm"], r["temp"]) for r in merge_repeated_hours(df, KEY, T, "mm", ["temp"]).collect()}
    assert out == {"a": (3.5, 19.0), "b": (None, 18.0)}


def test_nan_becomes_null(spark):
    df = normalise_missing(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, x double"), ["x"])
    assert [r["x"] for r in df.orderBy("i").collect()] == [None, 0.5]


def test_keep_one_first_and_latest(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 3, None)], "k string, o int, v string")
    assert keep_one(df, ["k"], [F.col("o")]).first()["v"] == "y"
    assert keep_one(df, ["k"], [F.col("o")], latest=True).first()["v"] is None


def test_update_feature_table_in_steps(spark, tmp_path):
    table, path = hourly(spark, 150, ("a", "b"), drop=(60, 61)), str(tmp_path / "store")
    early = table.where("station_id = 'a'")
    for cut in ("2023-12-27 05:00:00", "2023-12-29 00:00:00", "2023-12-29 00:00:00"):
        update_feature_table(spark, early.where(F.col(T) <= at(cut)), path, KEY)
    update_feature_table(spark, table, path, KEY)
    got = spark.read.parquet(path)
    assert as_set(got) == as_set(feature_store(densify(table, KEY, T), KEY))
    assert got.count() == got.select("station_id", T).distinct().count()


def test_update_of_an_empty_table_and_repeated_hours(spark, tmp_path):
    table, path = hourly(spark, 80, ("a", "b")), str(tmp_path / "store")
    twice = table.unionByName(table)
    feature_store(densify(table, KEY, T), KEY).limit(0).write.parquet(path)
    update_feature_table(spark, twice.where(F.col(T) <= at("2023-12-26 10:00:00")), path, KEY)
    closed = twice.where((F.col("station_id") == "b") | (F.col(T) <= at("2023-12-26 10:00:00")))
    for _ in range(2):
        update_feature_table(spark, closed, path, KEY)
    update_feature_table(spark, twice, path, KEY)
    got = spark.read.parquet(path)
    assert got.count() == got.select("station_id", T).distinct().count()
    assert as_set(got) == as_set(feature_store(densify(table, KEY, T), KEY))


def test_update_without_station_keys(spark, tmp_path):
    table, path = hourly(spark, 80, ("a",)).drop("station_id"), str(tmp_path / "store")
    for cut in ("2023-12-26 10:00:00", "2023-12-27 10:00:00", "2024-02-01 00:00:00"):
        update_feature_table(spark, table.where(F.col(T) <= at(cut)), path, [])
    assert as_set(spark.read.parquet(path)) == as_set(feature_store(densify(table, [], T), []))
