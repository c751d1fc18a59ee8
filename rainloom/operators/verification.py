"""Forecasts against what was observed later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.functions.labels import event, outcome
from rainloom.functions.numeric import exact_sum, guarded_corr, ratio, ratio_or_zero
from rainloom.functions.timeparts import lead_hours, lead_range, hours
from rainloom.operators.grid import keep_one

T = "observation_time"


def _mean_pct(column: str) -> Column:
    return F.round(F.try_divide(exact_sum(F.col(column), 4), F.count(column)) * 100, 1)


def summary_by_alert(predictions: DataFrame) -> DataFrame:
    """Hours, mean probability and time range per alert level. Times are compared as times
    and formatted last, because formatted text does not sort across months."""
    shown = lambda c: F.date_format(c, "dd/MM HH:mm")
    return (
        predictions.groupBy("alerta_chuva")
        .agg(
            F.count(F.lit(1)).alias("horas"), _mean_pct("prob_chuva").alias("prob_media_pct"),
            shown(F.min(T)).alias("primeira_hora"), shown(F.max(T)).alias("ultima_hora"),
        )
        .orderBy(F.desc("prob_media_pct"))
    )


def forecast_report(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.sum("pred_vai_chover").alias("horas_com_chuva_prevista"),
        F.count(F.lit(1)).alias("total_horas"),
        _mean_pct("prob_chuva").alias("prob_media_pct"),
        F.round(F.max("prob_chuva") * 100, 1).alias("prob_maxima_pct"),
        F.date_format(F.min(F.when(F.col("pred_vai_chover") == 1, F.col(T))), "HH:mm").alias("primeira_chuva_prevista"),
    )


def issued_before(history: DataFrame) -> DataFrame:
    return history.where(F.col("inferencia_local") < F.col("target_time"))


def latest_before_target(history: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Last forecast issued before its target, per (keys, target). An aggregate, so a target
    with very many forecasts is reduced before the shuffle."""
    order = [F.col("inferencia_local"), *[F.col(c) for c in tie]]
    return keep_one(issued_before(history), [*keys, "target_time"], order, latest=True)


def with_truth(forecasts: DataFrame, truth: DataFrame, keys: list[str], as_of: Column | None = None) -> DataFrame:
    """Join the observation of the target hour; hours after ``as_of`` are not known yet.
    The probability is shown with three digits."""
    known = truth if as_of is None else truth.where(F.col(T) <= as_of)
    known = known.select(*keys, F.col(T).alias("target_time"), F.col("precipitation").alias("chuva_real_mm"))
    return forecasts.join(known, [*keys, "target_time"]).withColumns({
        "prob_chuva": F.round("prob_chuva", 3), "api_vai_chover": event(F.col("api_precip_alvo")), "choveu": event(F.col("chuva_real_mm")),
    })


def accuracy_hourly(
    history: DataFrame, truth: DataFrame, keys: list[str], tie: list[str], truth_keys: list[str] | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Per target: the last forecast before it, the observation and the outcome label."""
    matched = with_truth(latest_before_target(history, keys, tie), truth, truth_keys or [], as_of)
    return matched.withColumn("resultado_classificacao", outcome(F.col("choveu"), F.col("pred_vai_chover")))


def accuracy_by_lead(
    history: DataFrame, truth: DataFrame, truth_keys: list[str] | None = None, as_of: Column | None = None
) -> DataFrame:
    """All forecasts with their lead time and lead range, and the observation."""
    ahead = issued_before(history).withColumns({
        "antecedencia_h": lead_hours(F.col("target_time"), F.col("inferencia_local")),
        "faixa_antecedencia": lead_range(F.col("target_time"), F.col("inferencia_local")),
    })
    return with_truth(ahead, truth, truth_keys or [], as_of)


def contingency(df: DataFrame, group: list[str], estimate: str, truth: str, limits: list[float]) -> DataFrame:
    """Detection scores at several limits, from one aggregation; limit 0 means above 0."""
    pairs = df.dropna(subset=[estimate, truth])
    entries = []
    for limit in limits:
        a, b = event(F.col(estimate), limit), event(F.col(truth), limit)
        count = lambda x, y: F.count_if((a == x) & (b == y))
        entries.append(F.struct(
            F.lit(float(limit)).alias("limiar_mm"), F.count(F.lit(1)).alias("horas"),
            count(1, 1).alias("vp"), count(1, 0).alias("fp"), count(0, 1).alias("fn"), count(0, 0).alias("vn"),
        ))
    counts = pairs.groupBy(*group).agg(F.array(*entries).alias("_all")).select(*group, F.inline("_all"))
    vp, fp, fn, n = (F.col(c) for c in ("vp", "fp", "fn", "horas"))
    floor = lambda c: F.greatest(c, F.lit(1))
    return counts.withColumns({
        "freq_om": ratio(vp + fp, n), "freq_inmet": ratio(vp + fn, n),
        "pod": ratio(vp, floor(vp + fn)), "far": ratio(fp, floor(vp + fp)), "csi": ratio(vp, floor(vp + fp + fn)),
        "vies_freq": ratio(vp + fp, floor(vp + fn)),
    })


def shifted_join(series: DataFrame, other: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """``other`` moved by each lag and joined on time. One equi-join; the moved series has
    one row per lag and hour."""
    moved = other.select("*", F.explode(F.array(*[F.lit(k) for k in lags])).alias("defasagem_h"))
    moved = moved.withColumn(T, F.col(T) + hours(F.col("defasagem_h")))
    return series.join(moved, [*keys, T])


def lag_scores(aligned: DataFrame, truth: str, estimate: str, wet: float) -> DataFrame:
    """Hours, correlation and F1 per lag, pooled over stations."""
    known = aligned.dropna(subset=[truth, estimate])
    a, b = F.col(truth) >= wet, F.col(estimate) >= wet
    hit = F.count_if(a & b)
    return known.groupBy("defasagem_h").agg(
        F.count(F.lit(1)).alias("horas"), guarded_corr(F.col(truth), F.col(estimate)).alias("corr"),
        ratio_or_zero(2 * hit, F.count_if(a) + F.count_if(b)).alias("f1"),
    )
