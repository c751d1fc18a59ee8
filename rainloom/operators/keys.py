"""Joins in which a null key is a key like any other."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null meeting null; the keys of the left side are kept."""
    names = {k: f"_right_{k}" for k in keys}
    if not keys:
        return left.join(right, how=how) if how != "left_semi" else left
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())
