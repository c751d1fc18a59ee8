"""Temporal splits, gates and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.operators.keys import join_on
from rainloom.operators.prefix import positions

T = "observation_time"


def _moment(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else value


def months_before(moment: Column, months: int) -> Column:
    """Calendar months back, keeping the hour."""
    return moment - F.expr(f"INTERVAL {int(months)} MONTHS")


def latest(df: DataFrame, time_col: str = T) -> Column:
    """The last time of the frame as a scalar, without joining it back."""
    return df.agg(F.max(time_col)).scalar()


def split_at(df: DataFrame, first: str | Column, second: str | Column, names: tuple[str, str, str], time_col: str = T) -> DataFrame:
    """Label rows by two cut-off times: before the first, between them, from the second on."""
    t = F.col(time_col)
    label = F.when(t < _moment(first), names[0]).when(t < _moment(second), names[1]).otherwise(names[2])
    return df.withColumn("split", label)


def rolling_split(df: DataFrame, end: Column, calibrate_months: int, test_months: int, time_col: str = T) -> DataFrame:
    """Train / calibrate / test by months before ``end``, test being the last ones."""
    test = months_before(end, test_months)
    return split_at(df, months_before(test, calibrate_months), test, ("train", "calibrate", "test"), time_col)


def trailing_per_group(df: DataFrame, keys: list[str], months: int, time_col: str = T) -> DataFrame:
    """The last ``months`` of each group up to its own end: ``(end - months, end]``.

    The ends come from an aggregate joined back, so no group is held in one task.
    """
    ends = df.groupBy(*keys).agg(F.max(time_col).alias("_end"))
    return join_on(df, ends, keys).where(F.col(time_col) > months_before(F.col("_end"), months)).drop("_end")


def newer_than_sink(df: DataFrame, sink: DataFrame, time_col: str = T) -> DataFrame:
    """Rows after the high-water mark of the sink; all rows if the sink is empty."""
    mark = latest(sink, time_col)
    return df.where(mark.isNull() | (F.col(time_col) > mark))


def complete_in_all(df: DataFrame, *column_sets: list[str]) -> DataFrame:
    """Rows complete for every compared variant, so all are measured on the same rows."""
    return df.dropna(subset=sorted(set().union(*column_sets)))


def large_enough(df: DataFrame, keys: list[str], at_least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups with enough rows, and the groups left out with their sizes."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    kept = join_on(df, sizes.where(F.col("rows") >= at_least).select(*keys), keys, "left_semi")
    return kept, sizes.where(F.col("rows") < at_least)


def new_rows_gate(df: DataFrame, trained_until: Column, as_of: Column, at_least: int, time_col: str = T) -> DataFrame:
    """How many rows came since the last training and whether that is enough to retrain."""
    fresh = F.count_if((F.col(time_col) > trained_until) & (F.col(time_col) <= as_of))
    return df.agg(fresh.alias("novos")).select("novos", (F.col("novos") >= at_least).alias("retreinar"))


def fold_turns(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Turns of the rule "next largest group to the fold with fewest rows, the first of equals".

    ``sizes``: how many groups there are of each size. A turn ``(size, first, end, order)`` gives the
    groups of one size from the first to before the end to the folds of ``order`` in rotation: folds
    less than one size apart take one group each before any takes a second. A size has at most as
    many turns as there are folds.
    """
    load, turns = [0] * folds, []
    for size, count in sorted(sizes, reverse=True):
        done = 0
        while done < count:
            least = min(load)
            order = sorted((f for f in range(folds) if load[f] - least < size), key=lambda f: (load[f], f))
            others = [load[f] for f in range(folds) if load[f] - least >= size]
            rounds = (min(others) - least) // size if others else count
            taken = min(count - done, rounds * len(order))
            turns.append((size, done, done + taken, order))
            for place, f in enumerate(order):
                load[f] += size * (taken // len(order) + (place < taken % len(order)))
            done += taken
    return turns


def fold_numbers(sizes: dict, folds: int) -> dict:
    """Fold of each of a few groups, given their rows: the rule of ``assign_folds``."""
    order = sorted(sizes, key=lambda g: (-sizes[g], g is not None, "" if g is None else g))
    load, found = [0] * max(1, min(folds, len(sizes))), {}
    for g in order:
        found[g] = load.index(min(load))
        load[found[g]] += sizes[g]
    return found


def assign_folds(df: DataFrame, group: list[str], folds: int) -> DataFrame:
    """Whole groups to folds: the largest group next, to the fold with fewest rows.

    Never more folds than groups; a null group is one. Equally large groups follow each other in the
    order of their keys, nulls first. The groups are numbered range by range; the driver sees how many
    groups there are of each size (at most the square root of twice the rows) and states turns.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    numbered = positions(sizes, [F.desc("_rows"), *[F.asc_nulls_first(g) for g in group]], "_no")
    kinds = numbered.groupBy("_rows").agg(F.count(F.lit(1)).alias("n"), F.min("_no").alias("first")).collect()
    firsts = {r["_rows"]: r["first"] for r in kinds}
    turns = fold_turns([(r["_rows"], r["n"]) for r in kinds], max(1, min(folds, sum(r["n"] for r in kinds))))
    stated = df.sparkSession.createDataFrame(
        [(size, firsts[size] + first, firsts[size] + end, order) for size, first, end, order in turns], "_size long, _first long, _end long, _order array<int>"
    )
    mine = (F.col("_rows") == F.col("_size")) & (F.col("_no") >= F.col("_first")) & (F.col("_no") < F.col("_end"))
    place = F.pmod(F.col("_no") - F.col("_first"), F.size("_order")).cast("int")
    placed = numbered.join(stated, mine).select(*group, F.col("_order")[place].alias("fold"))
    return join_on(df, placed, group)
