"""Reference forecasts that need no fitted model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.constants import ENSEMBLE_MODELS, VOTE_MM
from rainloom.functions.ensemble import votes
from rainloom.functions.numeric import ratio_or_zero
from rainloom.operators.metrics import best_threshold, threshold_sweep

PREFIX = "p_"


def _f1_of(label: str, decision: Column) -> Column:
    hit = F.count_if((F.col(label) == 1) & decision)
    return ratio_or_zero(2 * hit, F.count_if(F.col(label) == 1) + F.count_if(decision))


def single_model_f1(df: DataFrame, group: list[str], label: str, models: list[str] = ENSEMBLE_MODELS) -> DataFrame:
    """F1 of "this model shows rain" for each model, one row per (group, model), in one pass.
    A model without a value says no. ``rank_no`` keeps the order of the model list."""
    decide = lambda m: F.coalesce(F.col(f"{PREFIX}{m}") > 0, F.lit(False))
    entries = [
        F.struct(F.lit(m).alias("modelo"), F.lit(i).alias("rank_no"), _f1_of(label, decide(m)).alias("f1"))
        for i, m in enumerate(models)
    ]
    return df.groupBy(*group).agg(F.array(*entries).alias("_all")).select(*group, F.inline("_all"))


def vote_count(models: list[str] = ENSEMBLE_MODELS, limit: float = VOTE_MM) -> Column:
    """Whole votes, so a vote threshold is compared without rounding."""
    return votes([F.col(f"{PREFIX}{m}") for m in models], limit)


def best_vote_count(df: DataFrame, group: list[str], label: str, models: list[str] = ENSEMBLE_MODELS) -> DataFrame:
    """How many votes give the best F1; the fewest of equals."""
    counted = df.withColumn("_votes", vote_count(models))
    return best_threshold(threshold_sweep(counted, group, "_votes", label, list(range(1, len(models) + 1))), group)


def long_decisions(df: DataFrame, keep: list[str], approaches: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per (row, approach) with its decision and score, for one grouped metrics job."""
    entries = [
        F.struct(F.lit(n).alias("abordagem"), decision.cast("int").alias("pred"), score.cast("double").alias("score"))
        for n, (decision, score) in approaches.items()
    ]
    return df.select(*keep, F.inline(F.array(*entries)))
