"""Calendar arithmetic on zone-free timestamps; independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rainloom.constants import AFTERNOON_HOURS, LEAD_RANGES, LEAD_REST, PEAK_MONTHS, RAINY_MONTHS
from rainloom.functions.numeric import flag

EPOCH_DAY = "1970-01-01"


def to_local(value: Column, fmt: str | None = None) -> Column:
    """Text to a zone-free timestamp."""
    return F.to_timestamp_ntz(value) if fmt is None else F.to_timestamp_ntz(value, F.lit(fmt))


def hours(n) -> Column:
    """An interval of ``n`` hours (number or column)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def day_start(t: Column) -> Column:
    return F.to_date(t).cast("timestamp_ntz")


def hour_floor(t: Column) -> Column:
    """The full hour; ``date_trunc`` would pass through the session zone."""
    return day_start(t) + hours(F.hour(t))


def month_floor(t: Column) -> Column:
    return F.trunc(F.to_date(t), "MM")


def day_index(t: Column) -> Column:
    return F.datediff(F.to_date(t), F.lit(EPOCH_DAY).cast("date"))


def hour_index(t: Column) -> Column:
    """Whole hours since the epoch."""
    return day_index(t).cast("long") * 24 + F.hour(t)


def hour_from_index(index: Column) -> Column:
    days = F.floor(index / 24).cast("int")
    return F.date_add(F.lit(EPOCH_DAY).cast("date"), days).cast("timestamp_ntz") + hours(
        index - days.cast("long") * 24
    )


def now_in_zone(zone: str) -> Column:
    """The present local time of ``zone`` without a zone, for as-of defaults."""
    wall_clock = F.current_timestamp().cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit(zone), wall_clock)


def as_of_or_now(as_of: Column | None, zone: str) -> Column:
    return now_in_zone(zone) if as_of is None else as_of


def utc_to_zone(t: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), t)


def calendar_flags(month: Column, hour: Column) -> dict[str, Column]:
    return {
        "is_rainy_season": flag(month.isin(*RAINY_MONTHS)),
        "is_peak_rain_month": flag(month.isin(*PEAK_MONTHS)),
        "is_afternoon": flag(hour.between(*AFTERNOON_HOURS)),
    }


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds between two zone-free timestamps."""
    clock = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    days = (day_index(later) - day_index(earlier)).cast("long")
    return days * 86400 + clock(later) - clock(earlier)


def lead_hours(target: Column, issued: Column) -> Column:
    """Started hours from issue to target."""
    return F.ceil(seconds_between(target, issued) / 3600).cast("int")


def lead_range(target: Column, issued: Column, ranges=LEAD_RANGES, rest=LEAD_REST) -> Column:
    elapsed = seconds_between(target, issued)
    (first, label), *others = ranges
    chain = F.when(elapsed <= first * 3600, label)
    for upper, name in others:
        chain = chain.when(elapsed <= upper * 3600, name)
    return chain.otherwise(rest)


def gauge_day(t: Column, reading_hour: int, shift: Column | int) -> Column:
    """The day a gauge read at ``reading_hour`` books the hour ``t`` to.

    shift 0: the reading of day d closes the 24 h before it; shift 1: it opens the 24 h after it.
    """
    shift = shift if isinstance(shift, Column) else F.lit(shift)
    return F.date_add(F.to_date(t - hours(reading_hour)), (F.lit(1) - shift).cast("int"))
