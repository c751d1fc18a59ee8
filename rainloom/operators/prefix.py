"""Running totals, positions and exact order statistics that never sort a whole group in one task.

Values are first counted per distinct value (partial aggregation), then cut at
global quantile splits. Totals per slice are small; the running total inside a
slice is a window over (group, slice). No slice holds much more than its share.
The number of slices follows from the number of distinct values; there is one
way at every size. Null groups are groups; null values are left out, NaN is the
largest value.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from rainloom.operators.keys import join_on
from rainloom.session import materialize

SLICE = "_slice"
#: Distinct values per slice; for many values slices and their number grow alike.
SLICE_ROWS = 50_000


def quantile_splits(values: DataFrame, column: str, slice_rows: int = SLICE_ROWS) -> list[float]:
    """Inner cut points from one approximate pass; none where one slice holds all.

    They only balance the work: results are exact whatever the cut points are.
    """
    n = values.where(F.col(column).isNotNull()).count()
    slices = math.ceil(n / max(slice_rows, 10 * math.isqrt(n)))
    if slices < 2:
        return []
    probs = [i / slices for i in range(1, slices)]
    cuts = values.agg(F.percentile_approx(F.col(column).cast("double"), probs, 4 * slices)).first()[0]
    return sorted({c for c in cuts or [] if math.isfinite(c)})


def sliced(df: DataFrame, column: str, splits: list[float]) -> DataFrame:
    """Number the slice of each value; slices are ordered like the values, NaN being in the last."""
    cast = df.where(F.col(column).isNotNull()).withColumn("_position", F.col(column).cast("double"))
    if not splits:
        return cast.withColumn(SLICE, F.when(F.isnan("_position"), 1.0).otherwise(0.0)).drop("_position")
    edges = [float("-inf"), *splits, float("inf")]
    return Bucketizer(splits=edges, inputCol="_position", outputCol=SLICE, handleInvalid="keep").transform(cast).drop("_position")


def _below(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def slice_offsets(cut: DataFrame, group: list[str], measures: list[str]) -> DataFrame:
    """Per (group, slice): own totals, ``_<m>_slice`` (sum over smaller slices) and ``<m>_all``."""
    zero, whole = F.lit(0).cast("long"), Window.partitionBy(*group)
    per_slice = cut.groupBy(*group, SLICE).agg(*[F.sum(m).alias(m) for m in measures])
    before = {f"_{m}_slice": F.coalesce(F.sum(m).over(_below(group, SLICE)), zero) for m in measures}
    return per_slice.withColumns(before | {f"{m}_all": F.sum(m).over(whole) for m in measures})


def running_totals(
    counts: DataFrame, group: list[str], column: str, measures: list[str], splits: list[float] | None = None
) -> DataFrame:
    """``counts`` has one row per (group, value). Adds ``<m>_before`` (sum over smaller
    values) and ``<m>_all`` (sum over the group) for each measure.

    Without ``splits`` the counts are written once and cut by their own quantiles.
    """
    if splits is None:
        counts = materialize(counts, "counts")
        splits = quantile_splits(counts, column)
    zero = F.lit(0).cast("long")
    cut = sliced(counts, column, splits)
    offsets = slice_offsets(cut, group, measures).drop(*measures)
    inside = _below([*group, SLICE], column)
    before = {f"{m}_before": F.col(f"_{m}_slice") + F.coalesce(F.sum(m).over(inside), zero) for m in measures}
    return join_on(cut, offsets, [*group, SLICE]).withColumns(before).drop(SLICE, *[f"_{m}_slice" for m in measures])


def exact_quantiles(
    df: DataFrame, group: list[str], column: str, probs: list[float], splits: list[float] | None = None
) -> DataFrame:
    """Interpolated quantiles per group, one row per (group, p)."""
    known = df.where(F.col(column).isNotNull())
    return quantiles_of_counts(known.groupBy(*group, column).agg(F.count(F.lit(1)).alias("n")), group, column, probs, splits)


def quantiles_of_counts(
    counts: DataFrame, group: list[str], column: str, probs: list[float], splits: list[float] | None = None
) -> DataFrame:
    """The same from ``n`` rows per (group, value). Only the slices that hold a wanted rank are sorted."""
    if splits is None:
        counts = materialize(counts, "counts")
        splits = quantile_splits(counts, column)
    rank = F.col("p") * (F.col("n_all") - 1)
    ranks = {"_lo": F.floor(rank), "_hi": F.ceil(rank), "_part": rank - F.floor(rank)}
    cut = sliced(counts, column, splits)
    wanted = slice_offsets(cut, group, ["n"]).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumns(ranks)
    reached = wanted.where((F.col("_n_slice") <= F.col("_hi")) & (F.col("_n_slice") + F.col("n") > F.col("_lo"))).drop("n", "n_all")
    inside = _below([*group, "p", SLICE], column)
    before = F.col("_n_slice") + F.coalesce(F.sum("n").over(inside), F.lit(0).cast("long"))
    ranked = join_on(cut, reached, [*group, SLICE]).withColumn("n_before", before)
    holds = lambda position: (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
    low, high = F.max(F.when(holds(F.col("_lo")), F.col(column))), F.max(F.when(holds(F.col("_hi")), F.col(column)))
    return (
        ranked.where(holds(F.col("_lo")) | holds(F.col("_hi")))
        .groupBy(*group, "p")
        .agg(low.alias("_v_lo"), high.alias("_v_hi"), F.max("_part").alias("_part"))
        .select(*group, "p", (F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * F.col("_part")).alias("quantile"))
    )


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows from 0 in a total order: ranges are sorted apart and offset by the rows before them."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.col("_first"), F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias("_before"))
    return ranged.join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_place") - F.col("_first")).drop("_range", "_place", "_first", "_before")
