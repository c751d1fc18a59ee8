"""Daily amounts as a trend with change points times yearly and weekly seasons.

The trend is linear in pieces whose changes of slope have a Laplace prior, so most are 0; seasons
multiply it. The product of trend and season columns is linear in their pairs, so one distributed
pass over the days gives the Gram matrix of all pairs, and every later step works on that matrix
alone: trend and seasons are fitted in turn, each by coordinate descent given the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rainloom.functions.numeric import clip_at_zero
from rainloom.functions.timeparts import day_index

#: Waves of the year and the week, days of a year, possible changes of slope in the
#: first part of the history, prior scales of changes, of level and slope, and of the seasons.
YEARLY_WAVES, WEEKLY_WAVES, YEAR_DAYS = 10, 3, 365.25
KNOTS, HISTORY = 25, 0.8
CHANGE_SCALE, TREND_SCALE, SEASON_SCALE = 0.1, 5.0, 10.0
TURNS, SWEEPS = 60, 400
STEP = 2_048


def waves() -> list[tuple[int, float]]:
    """(number, period) of every wave."""
    return [(k, YEAR_DAYS) for k in range(1, YEARLY_WAVES + 1)] + [(k, 7.0) for k in range(1, WEEKLY_WAVES + 1)]


def trend_rows(t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(t)), t, np.maximum(t[:, None] - knots, 0.0)])


def season_rows(day: np.ndarray) -> np.ndarray:
    angles = [2 * math.pi * k * day / period for k, period in waves()]
    return np.column_stack([np.ones(len(day)), *[f(a) for a in angles for f in (np.sin, np.cos)]])


@dataclass(frozen=True)
class Seasonal:
    """``amount = scale * trend(t) * (1 + seasons(day))`` with ``t = (day - first) / span``."""

    first: float
    span: float
    scale: float
    knots: np.ndarray
    trend: np.ndarray
    season: np.ndarray

    def estimate(self, day: np.ndarray) -> np.ndarray:
        t = (day - self.first) / self.span
        return self.scale * (trend_rows(t, self.knots) @ self.trend) * (season_rows(day) @ np.concatenate(([1.0], self.season)))


def gram(days: DataFrame, first: float, span: float, scale: float, knots: np.ndarray) -> np.ndarray:
    """Products of all pairs of (trend x season) columns and the amount, summed over ``position`` and ``amount``.

    Partitions add up their days; matrix rows are added up apart, so that no task and no
    message holds more than the matrix.
    """
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                day, y = part.column("position").to_numpy(), part.column("amount").to_numpy() / scale
                pairs = trend_rows((day - first) / span, knots)[:, :, None] * season_rows(day)[:, None, :]
                z = np.column_stack([pairs.reshape(len(day), -1), y])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["row", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(s) for s in table.column("sums").to_pylist())
        return pa.table({"row": table.column("row")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    got = days.mapInArrow(products, "row int, sums binary").groupBy("row").applyInArrow(added, "row int, sums binary").collect()
    return np.array([np.frombuffer(r["sums"]) for r in sorted(got, key=lambda r: r["row"])])


def descend(matrix: np.ndarray, target: np.ndarray, lasso: np.ndarray, ridge: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minimum of ``x'Mx / 2 - target'x + lasso'|x| + ridge'x^2 / 2`` by coordinate descent."""
    x, curve = start.copy(), np.diag(matrix) + ridge
    for _ in range(SWEEPS):
        largest = 0.0
        for j in range(len(x)):
            if curve[j] <= 0:
                continue
            pull = target[j] - matrix[j] @ x + matrix[j, j] * x[j]
            new = math.copysign(max(abs(pull) - lasso[j], 0.0), pull) / curve[j]
            largest = max(largest, abs(new - x[j]))
            x[j] = new
        if largest < 1e-9:
            break
    return x


def fit_seasonal(daily: DataFrame, day: str, amount: str, change_scale: float = CHANGE_SCALE) -> Seasonal:
    """Rows without a day or an amount take no part; without any row the model is 0 everywhere."""
    days = daily.select(day_index(F.col(day)).cast("double").alias("position"), F.col(amount).cast("double").alias("amount")).dropna()
    facts = days.agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.max(F.abs("amount")).alias("top"), F.count(F.lit(1)).alias("n")).first()
    first, span, scale = facts["lo"] or 0.0, max((facts["hi"] or 0.0) - (facts["lo"] or 0.0), 1.0), facts["top"] or 1.0
    knots = np.linspace(0, HISTORY, KNOTS + 1)[1:]
    width, waves_no = 2 + KNOTS, 2 * len(waves())
    trend, season = np.zeros(width), np.zeros(waves_no)
    if not facts["n"]:
        return Seasonal(first, span, scale, knots, trend, season)
    sums = gram(days, first, span, scale, knots)
    pairs, with_y, square = sums[:-1, :-1].reshape(width, 1 + waves_no, width, 1 + waves_no), sums[:-1, -1].reshape(width, 1 + waves_no), sums[-1, -1]
    noise = square / facts["n"]
    lasso = np.array([0.0, 0.0] + [1 / change_scale] * KNOTS)
    ridge = np.array([1 / TREND_SCALE**2] * 2 + [0.0] * KNOTS)
    before = math.inf
    for _ in range(TURNS):
        s = np.concatenate(([1.0], season))
        matrix = np.einsum("aibj,i,j->ab", pairs, s, s)
        trend = descend(matrix, with_y @ s, noise * lasso, noise * ridge, trend)
        matrix = np.einsum("aibj,a,b->ij", pairs, trend, trend)
        target = trend @ with_y - matrix[0]
        season = descend(matrix[1:, 1:], target[1:], np.zeros(waves_no), np.full(waves_no, noise / SEASON_SCALE**2), season)
        s = np.concatenate(([1.0], season))
        rest = square - 2 * trend @ with_y @ s + s @ matrix @ s
        noise = max(float(rest) / facts["n"], 1e-9)
        if abs(before - rest) <= 1e-9 * square:
            break
        before = rest
    return Seasonal(first, span, scale, knots, trend, season)


def estimate(model: Seasonal, day: Column) -> Column:
    """The model as an expression, so that prediction stays in the plan of the rows."""
    position = day_index(day).cast("double")
    t = (position - F.lit(float(model.first))) / F.lit(float(model.span))
    bends = [F.lit(float(d)) * F.greatest(t - F.lit(float(k)), F.lit(0.0)) for d, k in zip(model.trend[2:], model.knots) if d]
    trend = reduce(add, bends, F.lit(float(model.trend[0])) + F.lit(float(model.trend[1])) * t)
    angle = lambda k, period: position * F.lit(2 * math.pi * k / period)
    terms = [F.lit(float(b)) * f(angle(*w)) for (w, f), b in zip(((w, f) for w in waves() for f in (F.sin, F.cos)), model.season)]
    return F.lit(float(model.scale)) * trend * reduce(add, terms, F.lit(1.0))


def predict_seasonal(model: Seasonal, days: DataFrame, day: str, out: str = "yhat") -> DataFrame:
    """The estimated amount of every row's day, never below 0."""
    return days.withColumn(out, clip_at_zero(estimate(model, F.col(day))))
