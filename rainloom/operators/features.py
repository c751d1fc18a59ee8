"""Features and targets of a dense hourly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from rainloom.constants import ALL_FEATURES, BASE_FEATURES
from rainloom.functions.labels import event
from rainloom.functions.numeric import cycle, direction, flag, stable_round
from rainloom.functions.timeparts import calendar_flags
from rainloom.operators.blocks import BLOCK_STEPS, over_blocks

# Which raw column a short stem stands for, and the steps taken from it.
STEMS = {"temp": "temperature_2m", "precip": "precipitation", "humidity": "relative_humidity"}
LAGS = {"temp": (1, 3, 24), "precip": (1, 3, 24), "humidity": (1, 3)}
MEANS = {"temp": (6,), "humidity": (6,)}
SUMS = {"precip": (3, 6, 24)}
CHANGES = {
    "pressure_tend": ("pressure_msl", (3, 24)),
    "cloud_low_delta": ("cloud_cover_low", (1,)),
    "tcwv_delta": ("tcwv", (3,)),
}
LOOKBACK = 24
LOOKAHEAD = 1


def trailing(window: WindowSpec, steps: int) -> WindowSpec:
    return window.rowsBetween(1 - steps, 0)


def centred(window: WindowSpec, reach: int) -> WindowSpec:
    return window.rowsBetween(-reach, reach)


def framed(aggregate, column: str, frame: WindowSpec, at_least: int = 1) -> Column:
    """Aggregate over a frame; null unless ``at_least`` rows of the frame have a value."""
    value = aggregate(column).over(frame)
    return value if at_least <= 1 else F.when(F.count(column).over(frame) >= at_least, value)


def change(window: WindowSpec, column: str, steps: int) -> Column:
    return F.col(column) - F.lag(column, steps).over(window)


def lag_columns(window: WindowSpec) -> dict[str, Column]:
    return {
        f"{stem}_lag_{k}h": F.lag(STEMS[stem], k).over(window) for stem, steps in LAGS.items() for k in steps
    }


def delta_columns(window: WindowSpec) -> dict[str, Column]:
    return {f"{stem}_delta_1h": change(window, raw, 1) for stem, raw in STEMS.items()}


def rolling_columns(window: WindowSpec, full_window: bool = False, digits: int | None = 3) -> dict[str, Column]:
    """Trailing means and sums. ``full_window`` asks for every hour of the frame."""
    out = {}
    for aggregate, plan in ((F.avg, MEANS), (F.sum, SUMS)):
        for stem, steps in plan.items():
            for k in steps:
                value = framed(aggregate, STEMS[stem], trailing(window, k), k if full_window else 1)
                out[f"{stem}_rolling_{k}h"] = value if digits is None else stable_round(value, digits)
    return out


def change_columns(window: WindowSpec) -> dict[str, Column]:
    return {
        f"{name}_{k}h": change(window, raw, k) for name, (raw, steps) in CHANGES.items() for k in steps
    }


def calendar_columns(time_col: str = "observation_time") -> dict[str, Column]:
    t = F.col(time_col)
    return {"hour": F.hour(t), "month": F.month(t), "weekday": F.dayofweek(t)}


def cycle_columns(hour: Column, month: Column, digits: int | None = 6) -> dict[str, Column]:
    hour_sin, hour_cos = cycle(hour, 24, digits)
    month_sin, month_cos = cycle(month, 12, digits)
    return {"hour_sin": hour_sin, "hour_cos": hour_cos, "month_sin": month_sin, "month_cos": month_cos}


def wind_columns(degrees: str = "wind_direction_10m") -> dict[str, Column]:
    sin, cos = direction(F.col(degrees))
    return {"wind_dir_sin": sin, "wind_dir_cos": cos}


def target_columns(window: WindowSpec, amount: str = "precipitation", keep_unknown: bool = False) -> dict[str, Column]:
    """Amount and yes/no label of the next hour. With ``keep_unknown`` the label is null
    where the next hour is missing; otherwise it is 0 and the null amount marks the row."""
    following = F.lead(amount, 1).over(window)
    label = event(following) if keep_unknown else flag(following > 0)
    return {"target_rain_next_1h": following, "target_will_rain": label}


def add_features(
    dense: DataFrame,
    keys: list[str],
    time_col: str = "observation_time",
    *,
    extras: bool = True,
    targets: bool = False,
    keep_unknown: bool = False,
    full_window: bool = False,
    digits: int | None = 3,
    also=None,
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """All features of a dense series in one windowed pass.

    ``also`` may add further window columns (``window -> {name: column}``) that
    look at most ``LOOKBACK`` steps back and ``LOOKAHEAD`` ahead.
    """
    calendar = calendar_columns(time_col)

    def build(window: WindowSpec) -> dict[str, Column]:
        made = {
            **lag_columns(window), **delta_columns(window), **rolling_columns(window, full_window, digits),
            **calendar,
            **cycle_columns(calendar["hour"], calendar["month"]),
            **calendar_flags(calendar["month"], calendar["hour"]),
        }
        if extras:
            made |= {"dewpoint_depression": F.col("temperature_2m") - F.col("dew_point_2m")}
            made |= change_columns(window) | wind_columns()
        if targets:
            made |= target_columns(window, keep_unknown=keep_unknown)
        return made | (also(window) if also else {})

    return over_blocks(dense, keys, time_col, LOOKBACK, LOOKAHEAD, build, block_steps)


def training_rows(featured: DataFrame) -> DataFrame:
    """Rows with a full day of history and a known next hour."""
    return featured.dropna(subset=["temp_lag_24h", "precip_lag_24h", "target_rain_next_1h"])


def feature_store(
    dense: DataFrame, keys: list[str], time_col: str = "observation_time", block_steps: int = BLOCK_STEPS
) -> DataFrame:
    rows = training_rows(add_features(dense, keys, time_col, targets=True, block_steps=block_steps))
    return rows.select(*keys, time_col, *ALL_FEATURES, "target_will_rain", "target_rain_next_1h")


def shifted_features(
    dense_forecast: DataFrame, keys: list[str], features: list[str] = BASE_FEATURES,
    time_col: str = "observation_time", extras: bool = False,
) -> DataFrame:
    """The feature vector of hour t-1 offered at hour t (predicting t from a forecast series).

    Features first, then one step of lag; the second window reuses the blocks of a dense series.
    """
    featured = add_features(
        dense_forecast, keys, time_col, extras=extras, full_window=True, digits=None
    ).select(*keys, time_col, *features)
    return over_blocks(
        featured, keys, time_col, 1, 0, lambda w: {c: F.lag(c, 1).over(w) for c in features}
    )
