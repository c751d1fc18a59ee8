"""Scores of yes/no forecasts, probabilities and amounts, as grouped aggregates."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.functions.numeric import ratio, ratio_or_zero
from rainloom.operators.keys import join_on
from rainloom.operators.prefix import exact_quantiles, running_totals
from rainloom.operators.profile import best_per_group

COUNTS = ["vp", "fp", "fn", "vn"]
ALL = "todas"


def confusion_counts(df: DataFrame, group: list[str], label: str, predicted: str) -> DataFrame:
    """The four counts per group; rows without label or forecast do not count."""
    hit = lambda y, p: F.count_if((F.col(label) == y) & (F.col(predicted) == p))
    return df.groupBy(*group).agg(
        hit(1, 1).alias("vp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("vn")
    )


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from the counts; 0 where undefined."""
    vp, fp, fn, vn = (F.col(c) for c in COUNTS)
    n = vp + fp + fn + vn
    return counts.withColumns({
        "n": n, "precision": ratio_or_zero(vp, vp + fp), "recall": ratio_or_zero(vp, vp + fn),
        "f1": ratio_or_zero(2 * vp, 2 * vp + fp + fn), "accuracy": ratio_or_zero(vp + vn, n),
        "positivos_previstos": ratio_or_zero(vp + fp, n),
    })


def classification_metrics(df: DataFrame, group: list[str], label: str, predicted: str) -> DataFrame:
    return with_scores(confusion_counts(df, group, label, predicted))


def rolled_up_metrics(df: DataFrame, group: list[str], station: str, label: str, predicted: str) -> DataFrame:
    """Metrics per station and for all stations together. The rollup runs over the counts
    of the stations, not over the rows."""
    per_station = confusion_counts(df, [*group, station], label, predicted)
    sets = [F.col(c) for c in group]
    rolled = per_station.groupingSets([[*sets, F.col(station)], sets], *sets, F.col(station)).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.grouping(station).alias("_pooled")
    )
    name = F.when(F.col("_pooled") == 1, ALL).otherwise(F.col(station))
    return with_scores(rolled.withColumn(station, name).drop("_pooled"))


def score_counts(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*group, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def _ranked(df: DataFrame, group: list[str], score: str, label: str, splits: list[float] | None) -> DataFrame:
    return running_totals(score_counts(df, group, score, label), group, score, ["pos", "neg"], splits)


def _area(ranked: DataFrame, group: list[str]) -> DataFrame:
    pairs = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    p, n = F.max("pos_all").cast("double"), F.max("neg_all").cast("double")
    return ranked.groupBy(*group).agg(ratio(pairs, p * n).alias("auc_roc"))


def auc(df: DataFrame, group: list[str], score: str, label: str, splits: list[float] | None = None) -> DataFrame:
    """Exact area under the ROC curve with ties at half weight; null with one class only.

    ``splits`` only balances the work; by default taken from the scores.
    """
    return _area(_ranked(df, group, score, label, splits), group)


def rolled_up_auc(
    df: DataFrame, group: list[str], station: str, score: str, label: str, splits: list[float] | None = None
) -> DataFrame:
    """The same per station and for all stations together. Rows are counted once per station and
    score; the counts of the stations, not the rows, add up to those of all."""
    counts = score_counts(df, [*group, station], score, label)
    sets = [F.col(c) for c in [*group, score]]
    rolled = counts.groupingSets([[*sets, F.col(station)], sets], *sets, F.col(station)).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.grouping(station).alias("_pooled")
    )
    name = F.when(F.col("_pooled") == 1, ALL).otherwise(F.col(station))
    both = rolled.withColumn(station, name).drop("_pooled")
    return _area(running_totals(both, [*group, station], score, ["pos", "neg"], splits), [*group, station])


def roc_points(df: DataFrame, group: list[str], score: str, label: str, splits: list[float] | None = None) -> DataFrame:
    """One point per distinct score used as threshold."""
    above = lambda m: F.col(f"{m}_all") - F.col(f"{m}_before")
    return _ranked(df, group, score, label, splits).select(
        *group, F.col(score).alias("threshold"),
        ratio(above("neg"), F.col("neg_all")).alias("fpr"), ratio(above("pos"), F.col("pos_all")).alias("tpr"),
    )


def brier(score: str, label: str) -> Column:
    return F.avg(F.pow(F.col(score) - F.col(label), F.lit(2)))


def regression_metrics(df: DataFrame, group: list[str], truth: str, estimate: str) -> DataFrame:
    """RMSE, MAE and R2 over all rows and over rows with truth above 0."""
    error = F.col(estimate) - F.col(truth)

    def over(name: str, keep: Column) -> Column:
        pick = lambda c: F.when(keep, c)
        sst = F.var_pop(pick(F.col(truth))) * F.count(pick(F.col(truth)))
        return F.struct(
            F.lit(name).alias("rows"), F.count(pick(error)).alias("n"), F.sqrt(F.avg(pick(error * error))).alias("rmse"),
            F.avg(pick(F.abs(error))).alias("mae"), (1 - ratio(F.sum(pick(error * error)), sst)).alias("r2"),
        )

    entries = F.array(over("all", F.lit(True)), over("wet", F.col(truth) > 0))
    return df.dropna(subset=[truth, estimate]).groupBy(*group).agg(entries.alias("_all")).select(*group, F.inline("_all"))


def grid(first: int, last: int, step: int) -> list[float]:
    """Thresholds from whole hundredths, free of accumulated float error."""
    return [i / 100 for i in range(first, last + 1, step)]


def threshold_sweep(
    df: DataFrame, group: list[str], score: str, label: str, thresholds: list[float]
) -> DataFrame:
    """Metrics at every threshold from one aggregation.

    Each row is counted once, under the number of thresholds it reaches; the
    counts per threshold follow from at most len(thresholds)+1 rows per group.
    """
    ordered = sorted(thresholds)
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    reached = reduce(add, [(F.col(score) >= F.lit(t)).cast("int") for t in ordered])
    cells = known.groupBy(*group, reached.alias("_reached")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("_step"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ordered)])
    opened = cells.select("*", F.inline(steps))
    passed = F.col("_reached") >= F.col("_step")
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    counts = opened.groupBy(*group, "threshold").agg(
        total("_pos", passed).alias("vp"), total("_neg", passed).alias("fp"),
        total("_pos", ~passed).alias("fn"), total("_neg", ~passed).alias("vn"),
    )
    return with_scores(counts)


def best_threshold(sweep: DataFrame, group: list[str]) -> DataFrame:
    """Threshold of the best F1 per group; the lowest of equals."""
    return best_per_group(sweep, group, "f1", [F.col("threshold")])


def median_threshold(best: DataFrame) -> DataFrame:
    """Median of the thresholds of the folds."""
    return exact_quantiles(best, [], "threshold", [0.5], splits=[]).select(F.col("quantile").alias("threshold"))


def apply_group_threshold(df: DataFrame, best: DataFrame, group: list[str], score: str, predicted: str) -> DataFrame:
    """Decide each row at the threshold of its group."""
    chosen = best.select(*group, F.col("threshold").alias("_t"))
    joined = join_on(df, chosen, group) if group else df.withColumn("_t", chosen.select("_t").scalar())
    return joined.withColumn(predicted, (F.col(score) >= F.col("_t")).cast("int")).drop("_t")


def balanced_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Rows with weight n / (2 n_class)."""
    totals = df.agg(F.struct(
        F.count(label).alias("n"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )).scalar()
    of_class = F.when(F.col(label) == 1, totals["pos"]).when(F.col(label) == 0, totals["neg"])
    return df.withColumn(weight, ratio(totals["n"], 2 * of_class))
