"""Time blocks with overlap, so that one long or hot series never lands in one task.

A window partitioned by station alone puts a whole station in one task. Here a
series is cut into blocks of fixed length and each block carries copies of the
rows just before and after it. A window over (keys, block) then gives the same
values as the window over the whole series, and the copies are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from rainloom.functions.timeparts import hour_index
from rainloom.operators.keys import join_on

BLOCK = "_block"
HOME = "_home"
BLOCK_STEPS = 768


def step_index(time_col: str, step_hours: int = 1) -> Column:
    index = hour_index(F.col(time_col))
    return index if step_hours == 1 else F.floor(index / step_hours)


def block_of(time_col: str, block_steps: int = BLOCK_STEPS, step_hours: int = 1) -> Column:
    return F.floor(step_index(time_col, step_hours) / block_steps)


def with_overlap(
    df: DataFrame, time_col: str, back: int, ahead: int, block_steps: int = BLOCK_STEPS, step_hours: int = 1
) -> DataFrame:
    """Each row in its own block, plus a copy in a neighbour that needs it as context."""
    if max(back, ahead) > block_steps:
        raise ValueError("a block must be at least as long as the context it lends")
    home = block_of(time_col, block_steps, step_hours)
    offset = step_index(time_col, step_hours) - home * block_steps
    targets = F.array_compact(
        F.array(home, F.when(offset >= block_steps - back, home + 1), F.when(offset < ahead, home - 1))
    )
    return df.select("*", home.alias(HOME), F.explode(targets).alias(BLOCK))


def over_blocks(
    df: DataFrame,
    keys: list[str],
    time_col: str,
    back: int,
    ahead: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    block_steps: int = BLOCK_STEPS,
    step_hours: int = 1,
) -> DataFrame:
    """Add the columns ``build(window)`` makes; ``df`` must be dense in time per key.

    ``back``/``ahead`` are the most steps any of the columns looks behind/ahead.
    All columns share one shuffle and one sort.
    """
    lent = with_overlap(df, time_col, back, ahead, block_steps, step_hours)
    window = Window.partitionBy(*keys, BLOCK).orderBy(time_col)
    made = build(window)
    kept = [c for c in df.columns if c not in made]
    return (
        lent.select(*kept, HOME, BLOCK, *[c.alias(name) for name, c in made.items()])
        .where(F.col(BLOCK) == F.col(HOME))
        .drop(HOME, BLOCK)
    )


def forward_fill(
    df: DataFrame, keys: list[str], time_col: str, value: str, block_steps: int = BLOCK_STEPS, step_hours: int = 1
) -> DataFrame:
    """Last known value so far. Blocks are filled on their own; the value carried into a
    block comes from a table with one row per (keys, block)."""
    blocked = df.withColumn(BLOCK, block_of(time_col, block_steps, step_hours))
    ends = blocked.groupBy(*keys, BLOCK).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(time_col))).alias("_end")
    )
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, BLOCK, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy(*keys, BLOCK).orderBy(time_col).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(so_far), F.col("_carried"))
    return join_on(blocked, carried, [*keys, BLOCK], "left").withColumn(value, filled).select(*df.columns)
