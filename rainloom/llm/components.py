"""Connected components by iterated joins; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rainloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (``src``, ``dst``) in one direction. Returns (``node``, ``label``), the label
    being the smallest node of the component.

    Each round takes the smallest label among the neighbours (pre-aggregated before the
    shuffle) and then the label of the label, so chains shorten by half at least. Rounds are
    written to the shared folder, which cuts the lineage.
    """
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()
    both = materialize(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edges")
    state = materialize(
        both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(state.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node")).agg(F.min("label").alias("_near"))
        )
        lower = state.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_label"))
        roots = lower.select(F.col("node").alias("_label"), F.col("_label").alias("_root"))
        jumped = lower.join(roots, "_label", "left").select(
            "node", F.least("_label", F.coalesce("_root", "_label")).alias("label"), "_old"
        )
        step = materialize(jumped, "labels")
        moved = step.where(F.col("label") != F.col("_old")).isEmpty()
        state = step.select("node", "label")
        if moved:
            return state
