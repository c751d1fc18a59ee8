"""Sinks, merges, ledgers and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.catalog.bindings import FORECASTS_SQL, forecast_history
from rainloom.catalog.registry import query
from rainloom.catalog.scores import METRICS_SQL, PERSIST_SQL, _auc_sql, counts_sql, persistence
from rainloom.constants import PROMOTION_TOLERANCE
from rainloom.functions.labels import alert_level
from rainloom.operators.ledger import experiment_rows, promote, ranking, validation_rows
from rainloom.operators.metrics import auc, classification_metrics
from rainloom.session import materialize, scratch_path
from rainloom.sinks import tables as sink
from rainloom.sources.tables import read_table

KEYS = ["inferencia_local", "target_time"]
_moment = lambda text: F.lit(text).cast("timestamp_ntz")


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("station_id"), "ts", "value")


@query("SELECT event_id, event_type AS station_id, ts, value FROM events")
def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping batches merged twice each into a table: every row is there once."""
    path = scratch_path(spark, "history")
    rows = _events(spark, sf_dir)
    first, second = rows.where(F.col("ts") < _moment("2024-01-20 00:00:00")), rows.where(F.col("ts") >= _moment("2024-01-10 00:00:00"))
    for batch in (first, second, first, second):
        sink.merge_insert_only(batch, path, ["station_id", "ts", "event_id"], pruned_by="ts")
    return sink.read_evolved(spark, path)


@query("""
SELECT event_id, event_type AS station_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND value > 50""")
def anti_join_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("station_id"), "ts", "value")
    history = rows.where((F.col("ts") < _moment("2024-01-20 00:00:00")) | ~(F.col("value") > 50))
    return sink.not_yet_present(rows, history, ["event_id", "ts"], pruned_by="ts").select("event_id", "station_id")


@query("""
SELECT s_suppkey, s_name, CASE WHEN n IS NULL THEN s_acctbal WHEN n > 620 THEN NULL ELSE CAST(n AS DOUBLE) END AS s_acctbal
FROM supplier LEFT JOIN (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""")
def merge_update_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching rows take the new value, also where that is null; the rest stays."""
    target = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    counts = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    updates = counts.select("s_suppkey", F.when(F.col("n") <= 620, F.col("n").cast("double")).alias("s_acctbal"))
    return sink.updated_where_matched(target, updates, ["s_suppkey"], ["s_acctbal"])


@query("""
SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 5 = 0 AND s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal,
       s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 5 = 0 AND s_suppkey % 2 = 0) AS rewritten FROM supplier""")
def merge_touched_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values merged into a table by nation: only files of nations with a match are written anew."""
    path = scratch_path(spark, "by-nation")
    target = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    sink.append(target, path, ["s_nationkey"])
    file = F.col("_metadata.file_name").alias("file")
    before = materialize(spark.read.parquet(path).select("s_suppkey", file), "files-before")
    updates = target.where("s_nationkey % 5 = 0 AND s_suppkey % 2 = 0").select("s_suppkey", (F.col("s_acctbal") + 1).alias("s_acctbal"))
    sink.merge_update_partitions(updates.unionByName(updates), path, ["s_suppkey"], ["s_acctbal"], ["s_nationkey"])
    after = spark.read.parquet(path).select("s_suppkey", "s_nationkey", "s_acctbal", file.alias("_file"))
    return after.join(before, "s_suppkey").select("s_suppkey", "s_nationkey", "s_acctbal", (F.col("_file") != F.col("file")).alias("rewritten"))


@query("""
SELECT event_id, value, NULL AS user_id FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
UNION ALL SELECT event_id, value, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'""")
def append_evolving_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table created empty, appended to, then appended to with one more column."""
    path = scratch_path(spark, "evolving")
    rows = read_table(spark, sf_dir, "events").select("event_id", "value", "user_id", "ts")
    old = rows.where(F.col("ts") < _moment("2024-01-15 00:00:00")).select("event_id", "value")
    sink.create_if_absent(old, path)
    sink.append(old, path)
    sink.append(rows.where(F.col("ts") >= _moment("2024-01-15 00:00:00")).select("event_id", "value", "user_id"), path)
    return sink.read_evolved(spark, path)


@query("SELECT event_id, event_type AS station_id, value FROM events WHERE event_type IN ('click', 'view')")
def overwrite_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table overwritten with another schema, partitioned by station and read with pruning."""
    path = scratch_path(spark, "partitioned")
    rows = _events(spark, sf_dir)
    sink.overwrite(rows.select("event_id"), path)
    sink.overwrite(rows.select("event_id", "station_id", "value").repartition("station_id"), path, ["station_id"])
    return spark.read.parquet(path).where(F.col("station_id").isin("click", "view")).select(
        "event_id", F.col("station_id").cast("string").alias("station_id"), "value"
    )


@query("SELECT event_id, event_type AS station_id, ROUND(value, 2) AS value, strftime(ts, '%m') AS month FROM events")
def raw_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed rows as JSON under year/month folders, read back."""
    path = scratch_path(spark, "raw")
    sink.archive_raw(_events(spark, sf_dir), path, "ts")
    schema = "event_id bigint, station_id string, value double, year string, month string"
    return spark.read.schema(schema).json(path).select("event_id", "station_id", F.round("value", 2).alias("value"), "month")


@query("""
SELECT event_id, value, CAST(NULL AS DOUBLE) AS prob_medida, CAST(NULL AS VARCHAR) AS modelo_regional FROM events""")
def add_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", "value")
    return sink.with_columns_of(rows, {"value": "double", "prob_medida": "double", "modelo_regional": "string"})


_ALERT = """CASE WHEN prob_chuva >= 0.85 THEN '🔴 CHUVA FORTE' WHEN prob_chuva >= 0.65 THEN '🟠 CHUVA PROVÁVEL'
       WHEN prob_chuva >= 0.40 THEN '🟡 POSSÍVEL CHUVA' ELSE '🟢 SEM CHUVA' END"""


@query("WITH" + FORECASTS_SQL + f"""
SELECT l_orderkey, l_linenumber, prob_chuva, {_ALERT} AS alerta_chuva, 'rain v' || CAST(station_id % 10 AS VARCHAR) AS modelo,
       strftime(target_time, '%d/%m %H:%M') AS shown FROM fc""")
def prediction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert level, version label and display time of each prediction."""
    return forecast_history(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "prob_chuva", alert_level(F.col("prob_chuva")).alias("alerta_chuva"),
        F.concat_ws(" ", F.lit("rain"), F.concat(F.lit("v"), F.col("station_id") % 10)).alias("modelo"),
        F.date_format("target_time", "dd/MM HH:mm").alias("shown"),
    )


@query(PERSIST_SQL + f""",
c AS (SELECT station_id, {counts_sql('y', 'p')} FROM pr GROUP BY 1),""" + _auc_sql("pr", "station_id", "y") + f""",
m AS (SELECT c.*, auc_roc, {METRICS_SQL} FROM c JOIN auc USING (station_id))
SELECT 'persistencia' AS experimento, station_id || '_chuva' AS variante, 1 AS n_features, CAST(NULL AS DOUBLE) AS threshold, f1, auc_roc, accuracy,
       "precision", recall, CAST(NULL AS BIGINT) AS train_size, n AS test_size, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM m""")
def experiment_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows appended to the experiment ledger and read back."""
    rows = persistence(spark, sf_dir)
    scores = classification_metrics(rows, ["station_id"], "y", "p").join(auc(rows, ["station_id"], "score", "y"), "station_id")
    entries = experiment_rows(
        scores, "persistencia", F.concat_ws("_", "station_id", F.lit("chuva")), _moment("2024-02-01 00:00:00"),
        n_features=1, test_size=F.col("n"),
    )
    path = scratch_path(spark, "experiments")
    sink.append(entries, path)
    metrics = ("f1", "auc_roc", "accuracy", "precision", "recall")
    return spark.read.parquet(path).withColumns(
        {c: F.round(f"`{c}`", 6) for c in metrics} | {"created_at": F.col("created_at").cast("timestamp_ntz")}
    )


@query(PERSIST_SQL + f""",
c AS (SELECT station_id, {counts_sql('y', 'p')} FROM pr GROUP BY 1), m AS (SELECT station_id, {METRICS_SQL} FROM c)
SELECT metrica, 'persistencia' AS fonte, station_id AS ponto, valor, n, TIMESTAMP '2024-02-01 00:00:00' AS created_at
FROM (SELECT station_id, n, UNNEST(['f1', 'recall']) AS metrica, UNNEST([f1, recall]) AS valor FROM m)""")
def metrics_long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as one row per metric, source and point."""
    scores = classification_metrics(persistence(spark, sf_dir), ["station_id"], "y", "p")
    long = validation_rows(scores, F.lit("persistencia"), F.col("station_id"), ["f1", "recall"], "n", _moment("2024-02-01 00:00:00"))
    return long.withColumns({"valor": F.round("valor", 6), "created_at": F.col("created_at").cast("timestamp_ntz")})


@query(PERSIST_SQL + f""",
a AS (SELECT station_id, {counts_sql('y', 'p')} FROM pr GROUP BY 1), b AS (SELECT station_id, {counts_sql('y', 'CAST(score >= 0.3 AS INTEGER)')} FROM pr GROUP BY 1),
d AS (SELECT station_id, {counts_sql('y', 'CAST(score >= 0.6 AS INTEGER)')} FROM pr GROUP BY 1),
f AS (SELECT a.station_id, 2 * b.vp / CAST(2 * b.vp + b.fp + b.fn AS DOUBLE) AS f1_new, 2 * a.vp / CAST(2 * a.vp + a.fp + a.fn AS DOUBLE) AS f1_champion,
             2 * d.vp / CAST(2 * d.vp + d.fp + d.fn AS DOUBLE) AS f1_baseline FROM a JOIN b USING (station_id) JOIN d USING (station_id))
SELECT station_id, ROUND(f1_new, 6) AS f1_new, ROUND(f1_champion, 6) AS f1_champion, f1_new >= f1_champion AS strict_rule,
       f1_new >= f1_champion - 0.02 AS tolerant_rule, f1_new > f1_baseline AND f1_new >= f1_champion - 0.02 AS baseline_rule,
       f1_new > f1_baseline AS first_version FROM f""")
def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate against champion on the same rows, under the three promotion rules."""
    from rainloom.functions.numeric import ratio_or_zero

    hit = lambda p: ratio_or_zero(
        2 * F.count_if((F.col("y") == 1) & p), F.count_if(F.col("y") == 1) + F.count_if(p)
    )
    f1s = persistence(spark, sf_dir).groupBy("station_id").agg(
        hit(F.col("score") >= 0.3).alias("f1_new"), hit(F.col("p") == 1).alias("f1_champion"), hit(F.col("score") >= 0.6).alias("f1_baseline")
    )
    new, champion, baseline = F.col("f1_new"), F.col("f1_champion"), F.col("f1_baseline")
    return f1s.select(
        "station_id", F.round(new, 6).alias("f1_new"), F.round(champion, 6).alias("f1_champion"),
        promote(new, champion).alias("strict_rule"), promote(new, champion, tolerance=PROMOTION_TOLERANCE).alias("tolerant_rule"),
        promote(new, champion, baseline, PROMOTION_TOLERANCE).alias("baseline_rule"),
        promote(new, F.lit(None).cast("double"), baseline).alias("first_version"),
    )


_RUNS_SQL = """
WITH runs AS (
  SELECT o_orderkey AS run_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'Prophet_Rain' ELSE o_orderpriority END AS run_name,
         CASE WHEN o_orderstatus = 'P' THEN 'v1' ELSE o_orderstatus END AS version, o_orderdate AS start_time,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'classifier' WHEN o_orderpriority = '3-MEDIUM' THEN 'regressor' ELSE 'other' END AS type,
         o_totalprice / 1000000 AS v, o_orderkey % 3 AS pick FROM orders),
newest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_name, version ORDER BY start_time DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1),
scored AS (
  SELECT CASE WHEN type = 'classifier' THEN 'classifier' ELSE 'regressor' END AS kind, run_name, version,
         CASE WHEN type = 'classifier' THEN CASE WHEN pick = 0 THEN v ELSE 0 END
              ELSE CASE pick WHEN 1 THEN v WHEN 2 THEN v / 2 ELSE 0 END END AS score
  FROM newest WHERE type IN ('classifier', 'regressor') OR run_name LIKE '%Prophet%')
SELECT kind, run_name, version, ROUND(score, 6) AS score, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY score DESC, run_name, version) AS place FROM scored"""


@query(_RUNS_SQL)
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest run per name and version, metric lookup with fallbacks, ranking by kind."""
    v, pick = F.col("o_totalprice") / 1000000, F.col("o_orderkey") % 3
    metrics = (
        F.when(pick == 0, F.create_map(F.lit("f1"), v))
        .when(pick == 1, F.create_map(F.lit("r2_rain_only"), v, F.lit("r2"), v / 4))
        .otherwise(F.create_map(F.lit("r2"), v / 2))
    )
    priority = F.col("o_orderpriority")
    runs = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(priority == "5-LOW", "Prophet_Rain").otherwise(priority).alias("run_name"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("version"), F.col("o_orderdate").alias("start_time"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "classifier").when(priority == "3-MEDIUM", "regressor").otherwise("other").alias("type"),
        metrics.alias("metrics"),
    )
    return ranking(runs).select("kind", "run_name", "version", F.round("score", 6).alias("score"), "place")
