"""Features from the forecasts of one or several models for the hour itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from rainloom.constants import ARCHIVE_VARIABLES, CAPE_MODELS, ENSEMBLE_MODELS
from rainloom.functions.ensemble import row_max, row_mean, vote_share
from rainloom.functions.numeric import cycle
from rainloom.operators.blocks import over_blocks
from rainloom.operators.features import centred, change, framed, wind_columns

SHORT = {"cloud_cover": "nuv", "relative_humidity_2m": "ur"}


def ensemble_feature_names() -> list[str]:
    names = [f"{stem}_{m}" for m in ENSEMBLE_MODELS for stem in ("p", "p3", "nuv", "ur")]
    names += [f"cape_{m}" for m in CAPE_MODELS]
    names += ["ens_media", "ens_max", "ens_frac", "ens_frac3"]
    return names + ["hora_sin", "hora_cos", "mes_sin", "mes_cos"]


def ensemble_features(
    dense: DataFrame, keys: list[str], name: Callable[[str, str], str], time_col: str = "observation_time",
    keep: list[str] | None = None,
) -> DataFrame:
    """35 features of the hour t from six models. A model without a column counts as missing."""
    def source(variable: str, model: str) -> Column:
        column = name(variable, model)
        return F.col(column).cast("double") if column in dense.columns else F.lit(None).cast("double")

    rain = {m: f"p_{m}" for m in ENSEMBLE_MODELS}
    inputs = {rain[m]: source("precipitation", m) for m in ENSEMBLE_MODELS}
    for variable, stem in SHORT.items():
        inputs |= {f"{stem}_{m}": source(variable, m) for m in ENSEMBLE_MODELS}
    inputs |= {f"cape_{m}": source("cape", m) for m in CAPE_MODELS}
    t = F.col(time_col)
    hora_sin, hora_cos = cycle(F.hour(t), 24)
    mes_sin, mes_cos = cycle(F.month(t), 12)
    around = {f"p3_{m}": rain[m] for m in ENSEMBLE_MODELS}
    neighbours = over_blocks(
        dense.select(*keys, time_col, *(keep or []), *[c.alias(n) for n, c in inputs.items()]),
        keys, time_col, 1, 1,
        lambda w: {n: framed(F.sum, p, centred(w, 1)) for n, p in around.items()},
    )
    amounts = [F.col(c) for c in rain.values()]
    sums = [F.col(c) for c in around]
    return neighbours.select(
        *keys, time_col, *(keep or []), *inputs, *around,
        row_mean(amounts).alias("ens_media"), row_max(amounts).alias("ens_max"),
        vote_share(amounts).alias("ens_frac"),
        vote_share(sums, null_if_all_missing=False).alias("ens_frac3"),
        hora_sin.alias("hora_sin"), hora_cos.alias("hora_cos"), mes_sin.alias("mes_sin"), mes_cos.alias("mes_cos"),
    ).select(*keys, time_col, *(keep or []), *ensemble_feature_names())


def phase_features(
    dense: DataFrame, keys: list[str], name: Callable[[str], str], time_col: str = "observation_time",
    keep: list[str] | None = None,
) -> DataFrame:
    """Single-model features: the forecast of the hour, its neighbours to allow for errors
    of phase, and the monthly index ``oni`` if the input has it."""
    raw = dense.select(
        *keys, time_col, *(keep or []), *(["oni"] if "oni" in dense.columns else []),
        *[F.col(name(v)).cast("double").alias(v) for v in ARCHIVE_VARIABLES],
    )
    t = F.col(time_col)
    hour_sin, hour_cos = cycle(F.hour(t), 24)
    month_sin, month_cos = cycle(F.month(t), 12)

    def build(window: WindowSpec) -> dict[str, Column]:
        made = {}
        for k in (1, 2, 3):
            made[f"precip_lag_{k}"] = F.lag("precipitation", k).over(window)
            made[f"precip_lead_{k}"] = F.lead("precipitation", k).over(window)
        return made | {
            "precip_win_7h": framed(F.sum, "precipitation", centred(window, 3), at_least=7),
            "pressure_tend_3h": change(window, "pressure_msl", 3),
            "dewpoint_depression": F.col("temperature_2m") - F.col("dew_point_2m"),
            **wind_columns(),
            "hour_sin": hour_sin, "hour_cos": hour_cos, "month_sin": month_sin, "month_cos": month_cos,
        }

    return over_blocks(raw, keys, time_col, 3, 3, build)
