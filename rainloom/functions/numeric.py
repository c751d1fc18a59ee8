"""Rounding, ratios and encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def stable_round(value: Column, digits: int) -> Column:
    """Half-up rounding that does not depend on the order in which a sum was added up.

    The first rounding removes the last-bit noise a different partitioning can
    leave, so exact ties always fall the same way.
    """
    return F.round(F.round(value, 9), digits)


def round_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def exact_sum(value: Column, scale: int = 2) -> Column:
    """Sum in decimals: the same total whatever the order of the rows."""
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double")


def exact_mean(value: Column, scale: int = 2) -> Column:
    return F.try_divide(exact_sum(value, scale), F.count(value))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null where the denominator is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def missing_to_null(value: Column) -> Column:
    """NaN and null both mean "missing"; only null is kept."""
    return F.nanvl(value, F.lit(None).cast("double"))


def clip_at_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def cycle(value: Column, period: int, digits: int | None = None) -> tuple[Column, Column]:
    """Position on a circle: (sin, cos) of ``value`` on a cycle of ``period`` steps."""
    angle = value * F.lit(2 * math.pi / period)
    pair = F.sin(angle), F.cos(angle)
    return pair if digits is None else tuple(F.round(c, digits) for c in pair)


def direction(degrees: Column) -> tuple[Column, Column]:
    """(sin, cos) of a compass direction in degrees."""
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.when(condition, 1).otherwise(0)


def flag_or_null(condition: Column) -> Column:
    """1 / 0, and null where the condition is unknown."""
    return condition.cast("int")


def share(condition: Column) -> Column:
    """Share of rows for which the condition holds; unknown rows do not count."""
    return ratio(F.sum(condition.cast("int")), F.count(condition))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null for constant or single-row input.

    Works on the moments, because ``corr`` raises on a constant column in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    noise = 1e-12 * (F.lit(1.0) + F.abs(F.avg(px)) * F.abs(F.avg(py)))
    return F.when(spread > noise, F.try_divide(F.covar_pop(px, py), spread))
