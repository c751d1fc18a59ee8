"""Ledgers of experiments and model versions, promotion rules, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rainloom.constants import EXPERIMENTS_DDL, PROMOTION_TOLERANCE, VALIDATION_DDL
from rainloom.operators.grid import keep_one


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of the ledger in order and type; absent ones are null."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def experiment_rows(metrics: DataFrame, experiment: str, variant: Column, created_at: Column, **facts) -> DataFrame:
    """Metric rows as entries of the experiment ledger."""
    extra = {k: v if isinstance(v, Column) else F.lit(v) for k, v in facts.items()}
    rows = metrics.withColumns({"experimento": F.lit(experiment), "variante": variant, "created_at": created_at} | extra)
    return conform(rows, EXPERIMENTS_DDL)


def validation_rows(metrics: DataFrame, fonte: Column, ponto: Column, columns: list[str], n: str, created_at: Column) -> DataFrame:
    """Wide metrics as long ``(metrica, fonte, ponto, valor, n)`` rows."""
    wide = metrics.select(
        fonte.alias("fonte"), ponto.alias("ponto"), F.col(n).cast("long").alias("n"),
        *[F.col(c).cast("double").alias(c) for c in columns],
    )
    long = wide.unpivot(["fonte", "ponto", "n"], columns, "metrica", "valor")
    return conform(long.withColumn("created_at", created_at), VALIDATION_DDL)


def promote(
    f1_new: Column, f1_champion: Column, f1_baseline: Column | None = None, tolerance: float = 0.0
) -> Column:
    """Whether a new version becomes champion: it is the first, or not worse than the
    champion beyond the tolerance; and it beats the baseline where there is one."""
    keeps_up = f1_champion.isNull() | (f1_new >= f1_champion - F.lit(tolerance))
    return keeps_up if f1_baseline is None else keeps_up & (f1_new > f1_baseline)


def should_promote(f1_new: float, f1_champion: float | None, f1_baseline: float | None = None, tolerance: float = PROMOTION_TOLERANCE) -> bool:
    """The same rule on the numbers of one training run."""
    beats = f1_baseline is None or f1_new > f1_baseline
    return beats and (f1_champion is None or f1_new >= f1_champion - tolerance)


def newest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each (name, version); a run without version is v1."""
    versioned = runs.withColumn("version", F.coalesce("version", F.lit("v1")))
    return keep_one(versioned, ["run_name", "version"], [F.col("start_time"), F.col("run_id")], latest=True)


def metric(metrics: Column, *names: str) -> Column:
    """First of the named metrics that a run has, else 0."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names], F.lit(0.0))


def ranking(runs: DataFrame) -> DataFrame:
    """Newest runs by kind: classifiers by F1, amount models by R2, best first."""
    m = F.col("metrics")
    kind = F.when(F.col("type") == "classifier", "classifier").when(
        (F.col("type") == "regressor") | F.col("run_name").contains("Prophet"), "regressor"
    )
    scored = newest_runs(runs).withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "kind", "run_name", "version",
        F.when(F.col("kind") == "classifier", metric(m, "f1")).otherwise(metric(m, "r2_rain_only", "r2")).alias("score"),
        F.when(F.col("kind") == "classifier", metric(m, "auc_roc")).otherwise(metric(m, "rmse_rain_only", "rmse")).alias("second"),
    )
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "run_name", "version"))
    return scored.withColumn("place", place)
