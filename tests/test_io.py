"""Sources, sinks, streams and the planner."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rainloom.catalog.bindings import event_rows, observation_cells
from rainloom.constants import EXPERIMENTS_DDL
from rainloom.operators.features import LOOKAHEAD, LOOKBACK, feature_store
from rainloom.operators.grid import dense_hourly
from rainloom.operators.ledger import conform, experiment_rows, should_promote
from rainloom.sinks import tables as sink
from rainloom.sources.planner import missing_periods
from rainloom.sources.series_json import normalise_names, read_series
from rainloom.sources.tables import horizon, small_rows, up_to
from rainloom.streaming.incremental import compact, current_store, run_feature_stream
from rainloom.streaming.landing import land
from tests.series import as_set, at

VARS = ["temperature_2m", "relative_humidity_2m"]


def write_series(folder, name, times, envelope=()):
    body = {"time": times, "temperature_2m": [20.5, None, 21.0][: len(times)], "relative_humidity_2m": [60.0, 61.0, 62.0][: len(times)]}
    for level in reversed(envelope):
        body = {"collected_at": "2024-01-01T00:00:00Z", level: body}
    (folder / name).write_text(json.dumps(body, indent=1))


def test_series_files_become_rows(spark, tmp_path):
    write_series(tmp_path, "A701_2024.json", ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"])
    write_series(tmp_path, "A702_2024.json", ["2024-01-01T00:00"])
    df = normalise_names(read_series(spark, str(tmp_path), VARS))
    assert df.columns == ["station_id", "_source_file", "observation_time", "temperature_2m", "relative_humidity"]
    rows = {(r["station_id"], r["observation_time"]): r for r in df.collect()}
    assert len(rows) == 4 and rows[("A701", datetime(2024, 1, 1, 1))]["temperature_2m"] is None
    one = read_series(spark, str(tmp_path), VARS, station="A702")
    assert [r["station_id"] for r in one.collect()] == ["A702"]
    assert one.where(F.col("_source_file").like("%A702%")).count() == 1


@pytest.mark.parametrize("envelope", ["hourly", "data.hourly"])
def test_series_in_an_envelope(spark, tmp_path, envelope):
    write_series(tmp_path, "historical_2024.json", ["2024-01-01T00:00", "2024-01-01T01:00"], envelope.split("."))
    assert read_series(spark, str(tmp_path), VARS, envelope=envelope).count() == 2


def test_series_files_stream_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_series(folder, "A701_2024.json", ["2024-01-01T00:00", "2024-01-01T01:00"])
    run = lambda: land(read_series(spark, str(folder), VARS, stream=True), str(tmp_path / "out"), str(tmp_path / "cp"))
    run(), run()
    write_series(folder, "A702_2024.json", ["2024-01-01T00:00"])
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_planner_rules(spark):
    stations = spark.createDataFrame([("a",)], "station_id string")
    loaded = spark.createDataFrame(
        [("a", date(2024, 1, 1), datetime(2024, 1, 31)), ("a", date(2024, 3, 1), datetime(2024, 3, 14, 12))],
        "station_id string, period date, fetched_at timestamp_ntz",
    )
    plan = lambda **kw: {(r["period"].month, r["reason"]) for r in missing_periods(
        stations, ["station_id"], loaded, "2024-01-01", at("2024-03-15 00:00:00"), **kw).collect()}
    assert plan() == {(2, "missing"), (3, "open")}
    assert plan(stale_hours=24) == {(2, "missing")}
    assert plan(stale_hours=6) == {(2, "missing"), (3, "open")}
    assert plan(delay_days=20) == {(2, "missing")}
    yearly = missing_periods(stations, ["station_id"], loaded.limit(0), "2022-05-01", at("2024-03-15 00:00:00"), period="year")
    assert yearly.count() == 3


def test_horizon_bounds_and_default_as_of(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in range(5)], "t timestamp_ntz")
    hours = lambda d: sorted(r["t"].hour for r in d.collect())
    assert hours(horizon(df, "t", at("2024-01-01 01:00:00"), 2)) == [1, 2]
    assert hours(horizon(df, "t", at("2024-01-01 01:00:00"), 2, closed="right")) == [2, 3]
    assert up_to(df, "t").count() == 5


def test_merge_twice_equals_once_and_adds_columns(spark, tmp_path):
    path = str(tmp_path / "h")
    a = spark.createDataFrame([(1, datetime(2024, 1, 1), 0.1), (2, datetime(2024, 1, 2), 0.2)], "i int, t timestamp_ntz, p double")
    b = spark.createDataFrame([(2, datetime(2024, 1, 2), 9.9, "m"), (3, datetime(2024, 1, 3), 0.3, "m")], "i int, t timestamp_ntz, p double, m string")
    for batch in (a, a, b, b):
        sink.merge_insert_only(batch, path, ["i", "t"], pruned_by="t")
    rows = {r["i"]: (r["p"], r["m"]) for r in sink.read_evolved(spark, path).collect()}
    assert rows == {1: (0.1, None), 2: (0.2, None), 3: (0.3, "m")}


def test_create_if_absent_and_add_columns(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "i int")
    path = str(tmp_path / "t")
    assert sink.create_if_absent(df, path) and not sink.create_if_absent(df, path)
    assert spark.read.schema("i int").parquet(path).count() == 0
    assert sink.with_columns_of(df, {"i": "int", "x": "double"}).schema.simpleString() == "struct<i:int,x:double>"


def test_catalog_table_gets_columns_and_view(spark, tmp_path):
    spark.sql(f"CREATE TABLE ledger_t (i INT) USING parquet LOCATION '{tmp_path}/ledger_t'")
    try:
        assert sink.add_columns(spark, "ledger_t", {"i": "int", "threshold": "double"}) == ["threshold"]
        sink.register_view(spark.table("ledger_t"), "ledger_v")
        assert spark.sql("SELECT threshold FROM ledger_v").count() == 0
    finally:
        spark.sql("DROP TABLE ledger_t")


def test_update_can_set_null(spark):
    target = spark.createDataFrame([(1, 0.5, "a"), (2, 0.6, "b")], "v int, f1 double, s string")
    updates = spark.createDataFrame([(2, None)], "v int, f1 double")
    rows = {r["v"]: (r["f1"], r["s"]) for r in sink.updated_where_matched(target, updates, ["v"], ["f1"]).collect()}
    assert rows == {1: (0.5, "a"), 2: (None, "b")}


def test_ledger_schema_and_promotion(spark):
    m = spark.createDataFrame([("x", 0.5)], "name string, f1 double")
    row = experiment_rows(m, "e", F.col("name"), at("2024-01-01 00:00:00"), n_features=3)
    assert row.schema.simpleString() == spark.createDataFrame([], EXPERIMENTS_DDL).schema.simpleString()
    assert conform(m, "name string, absent int").first()["absent"] is None
    assert should_promote(0.5, None) and should_promote(0.49, 0.5) and not should_promote(0.47, 0.5)
    assert not should_promote(0.5, None, 0.5) and should_promote(0.5, 0.5, 0.49, 0.0)
    with pytest.raises(ValueError):
        small_rows(spark, [(1,)] * 11, "i int", limit=10)


def test_stream_with_late_rows_equals_full_build(spark, tmp_path):
    rows = event_rows(spark, "/root/testdata/sf0.001").where("station_id IN ('click', 'view')").persist()
    late = (F.abs(F.hash("ts")) % 10) == 0
    for i, part in enumerate((rows.where(~late & (F.col("ts") < at("2024-01-12 00:00:00"))), rows.where(~late & (F.col("ts") >= at("2024-01-12 00:00:00"))), rows.where(late))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        run_feature_stream(stream, ["station_id"], "ts", observation_cells(), f"{tmp_path}/raw", f"{tmp_path}/store", f"{tmp_path}/cp")
    got = current_store(spark, f"{tmp_path}/store", ["station_id"])
    full = feature_store(dense_hourly(rows, ["station_id"], "ts", observation_cells()), ["station_id"])
    assert as_set(got, 6) == as_set(full, 6)


def test_one_late_row_recomputes_its_blocks_only(spark, tmp_path):
    """A year of two stations, a gap of 40 days, one late row: the late batch holds the hours it reaches."""
    keys, cells = ["station_id"], observation_cells()
    hours = spark.range(24 * 365).where("id NOT BETWEEN 2000 AND 2960").withColumn("station_id", F.explode(F.array(F.lit("a"), F.lit(None))))
    rows = hours.select(
        "station_id", (at("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"),
        (F.col("id") % 7).cast("double").alias("value"), F.col("id").alias("user_id"), (F.col("id") % 5).cast("int").alias("k"),
    )
    late = (F.col("ts") == at("2024-03-10 05:00:00")) & F.col("station_id").eqNullSafe("a")
    for part, store in ((~late, "one"), (late, "two")):
        if store == "two":
            compact(spark, f"{tmp_path}/one", f"{tmp_path}/two", keys)
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        run_feature_stream(stream, keys, "ts", cells, f"{tmp_path}/raw", f"{tmp_path}/{store}", f"{tmp_path}/cp")
    batches = {r["_batch"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/two").groupBy("_batch").count().collect()}
    assert len(batches) == 2 and batches[max(batches)] <= LOOKBACK + LOOKAHEAD + 1
    got = current_store(spark, f"{tmp_path}/two", keys)
    assert as_set(got, 6) == as_set(feature_store(dense_hourly(rows, keys, "ts", cells), keys), 6)
