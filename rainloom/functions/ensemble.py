"""Row-wise statistics over the columns of several forecast models."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from rainloom.constants import VOTE_MM


def row_count(values: list[Column]) -> Column:
    """How many of the models have a value."""
    return reduce(add, [v.isNotNull().cast("int") for v in values])


def row_mean(values: list[Column]) -> Column:
    """Mean of the models that have a value; null if none has."""
    total = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.try_divide(total, row_count(values))


def row_max(values: list[Column]) -> Column:
    return F.greatest(*values)


def votes(values: list[Column], limit: float = VOTE_MM) -> Column:
    """How many models reach the limit; a missing model counts as "no"."""
    return reduce(add, [F.coalesce((v >= limit).cast("int"), F.lit(0)) for v in values])


def vote_share(values: list[Column], limit: float = VOTE_MM, null_if_all_missing: bool = True) -> Column:
    """Votes over all models, missing ones included in the denominator."""
    out = votes(values, limit) / F.lit(float(len(values)))
    return F.when(row_count(values) > 0, out) if null_if_all_missing else out


def archived_name(lead: int):
    """Column name of an archived run: variable, lead in days, model."""
    return lambda variable, model: f"{variable}_previous_day{lead}_{model}"


def live_name(variable: str, model: str) -> str:
    return f"{variable}_{model}"


def archived_single_name(lead: int):
    return lambda variable: f"{variable}_d{lead}"
