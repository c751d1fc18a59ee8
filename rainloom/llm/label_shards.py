"""Shards of near-equal bytes that keep linked documents together, by balanced label propagation.

Documents of one group are linked with one another. Those of a group that start in one shard are a
cell: they have the same neighbours and move together, so a group has at most as many cells as there
are shards, however many documents it has. Rounds move cells to the shard where most of their
neighbours are, as far as the quotas of bytes allow; what a shard gives away counts towards what it
may take. Only groups that are still spread take part, until they rest; what the quotas left behind
then joins its majority. At the end the shards are made even: the documents, in order of shard and
group, are cut into runs of equal bytes, which parts one group at each border at most. A group
larger than a shard fills the room that the others leave.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from rainloom.session import materialize

SHARDS = 16
#: Rounds without fewer spread groups after which the rest joins its majority.
PATIENCE = 3
#: Bytes that a shard may hold during the rounds, as a multiple of its even share.
SLACK = 1.05
#: Share of a shard's bytes up to which a group moves as a whole or not at all.
WHOLE = 1 / 8


def accepted_shares(loads: list[float], flows: dict[tuple[int, int], float], capacity: float) -> list[float]:
    """Share of the wish to enter each shard that its quota allows, what leaves it included.

    The largest shares that agree with one another: all wishes are granted at first, and cut
    where a shard would overflow until nothing changes, so exchanges between full shards go through.
    """
    n = len(loads)
    into, share = [sum(v for (_, t), v in flows.items() if t == k) for k in range(n)], [1.0] * n
    for _ in range(200):
        leaving = [sum(v * share[t] for (s, t), v in flows.items() if s == k) for k in range(n)]
        share = [min(1.0, max(0.0, (capacity - loads[k] + leaving[k]) / into[k])) if into[k] else 1.0 for k in range(n)]
    return share


def draw(*columns: Column) -> Column:
    """An even number in 0 to 1 that only the columns decide."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def filled(giants: DataFrame, sizes: dict[int, float], rooms: list[float]) -> DataFrame:
    """Deal the documents of groups larger than a shard over the free room, each group over neighbouring shards."""
    bounds, whole = list(accumulate(rooms))[:-1], max(sum(rooms), 1e-9)
    ends = list(accumulate(sizes.values()))
    start, share = F.lit(0.0), F.lit(0.0)
    for group, end in zip(sizes, ends):
        here = F.col("group") == group
        start, share = F.when(here, (end - sizes[group]) / ends[-1]).otherwise(start), F.when(here, sizes[group] / ends[-1]).otherwise(share)
    place = (start + share * draw(F.col("row"))) * whole
    return giants.withColumn("shard", F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= place)).cast("int"))


def wished(cells: DataFrame, turn: int) -> DataFrame:
    """``target`` of every cell: the shard with most members of its group, ties by hash; and the spread groups' bytes."""
    together = cells.groupBy("group", "shard").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.collect_list(F.struct("start", "n", "bytes")).alias("cells"))
    own = Window.partitionBy("group")  # one row per shard
    top = F.max(F.struct("n", F.xxhash64("group", "shard"), "shard")).over(own)
    wide = together.withColumns({"target": top["shard"], "all_bytes": F.sum("bytes").over(own), "kinds": F.count(F.lit(1)).over(own), "turn": F.lit(turn)})
    return wide.select("group", "shard", "target", "all_bytes", "kinds", "turn", F.inline("cells")).select(
        "group", "start", "shard", "target", "n", "bytes", "all_bytes", (F.col("kinds") > 1).alias("spread"), "turn")


def propagated(items: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """``items``: (row, group, size). Adds ``shard`` after the rounds.

    Groups larger than a shard, fewer than there are shards, can't come together; they leave the
    room to the others and fill what is left. A round is one grouping of the cells of spread groups and
    one small aggregation. Only giants' ids, shard totals and flows between shards reach the driver.
    """
    items = items.withColumn("start", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(shards)).cast("int"))
    loads = {r["start"]: float(r["size"]) for r in items.groupBy("start").agg(F.sum("size").alias("size")).collect()}
    total = sum(loads.values())
    here = [F.col("start") == k for k in range(shards)]
    members = items.groupBy("group").agg(
        F.array(*[F.count_if(c) for c in here]).alias("ns"), F.array(*[F.sum(F.when(c, F.col("size")).otherwise(0)) for c in here]).alias("sizes"),
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
    ).where("n > 1")
    linked = materialize(members, "groups")
    large = linked.where(F.col("bytes") > total / shards).orderBy("group")
    sizes = {r["group"]: float(r["bytes"]) for r in large.select("group", "bytes").collect()}
    giant = F.col("group").isin([*sizes]) if sizes else F.lit(False)
    for r in large.select("sizes").collect():
        for k, size in enumerate(r["sizes"]):
            loads[k] = loads.get(k, 0.0) - float(size)
    cells = linked.where(~giant).select("group", F.posexplode(F.arrays_zip("ns", "sizes")).alias("start", "cell")).where("cell.ns > 0")
    cells = cells.select("group", "start", F.col("start").alias("shard"), F.col("cell.ns").alias("n"), F.col("cell.sizes").alias("bytes"))
    capacity, settled = total / shards * slack, []
    least, idle, turn = None, 0, 0
    while True:
        wishes = materialize(wished(cells, turn), "wishes")
        known = wishes.groupBy("spread", "shard", "target").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        settled.append(wishes.where("NOT spread").select("group", "start", "shard"))
        flows = {(r["shard"], r["target"]): float(r["bytes"]) for r in known if r["spread"] and r["shard"] != r["target"]}
        if not flows:
            break
        cut = sum(r["n"] for r in known if r["spread"])
        idle = idle + 1 if least is not None and cut >= least else 0
        least = cut if least is None else min(least, cut)
        if idle >= PATIENCE:
            settled.append(wishes.where("spread").select("group", "start", F.col("target").alias("shard")))
            break
        shares = accepted_shares([loads.get(k, 0.0) for k in range(shards)], flows, capacity)
        few = F.col("all_bytes") <= capacity * WHOLE
        luck = F.when(few, draw(F.col("group"), F.col("turn"))).otherwise(draw(F.col("group"), F.col("start"), F.col("turn")))
        goes = (F.col("target") != F.col("shard")) & (luck < F.get(F.array(*[F.lit(x) for x in shares]), F.col("target")))
        moved = wishes.where("spread").withColumn("after", F.when(goes, F.col("target")).otherwise(F.col("shard")))
        for r in moved.where("after != shard").groupBy("shard", "after").agg(F.sum("bytes").alias("bytes")).collect():
            loads[r["shard"]] = loads.get(r["shard"], 0.0) - float(r["bytes"])
            loads[r["after"]] = loads.get(r["after"], 0.0) + float(r["bytes"])
        cells = moved.select("group", "start", F.col("after").alias("shard"), "n", "bytes")
        turn += 1
    ends = settled[0]
    for more in settled[1:]:
        ends = ends.unionByName(more)
    ends = ends.where("start != shard").select("group", "start", F.col("shard").alias("_end"))
    state = items.where(~giant).join(ends, ["group", "start"], "left")
    state = state.select("row", "group", "size", F.coalesce("_end", "start").alias("shard"))
    if not sizes:
        return state
    state = materialize(state, "shards")
    loads = {r["shard"]: float(r["size"]) for r in state.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    rooms = [max(0.0, total / shards - loads.get(k, 0.0)) for k in range(shards)]
    return state.unionByName(filled(items.where(giant).drop("start"), sizes, rooms))


def evened(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Cut the order of (shard, group, row) into runs of equal bytes: ``shard`` and ``slot``.

    Positions come from ranges of the order that are summed up apart and then offset, so no
    task holds a shard.
    """
    order = ["shard", "group", "row"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select("row", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    offsets = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    total = ranged.agg(F.sum("size").alias("total")).scalar()
    inside = Window.partitionBy("part").orderBy("place")
    at = ranged.join(offsets, "part").select(
        "row", (F.col("n_before") + F.row_number().over(inside) - 1).alias("at"),
        (F.col("bytes_before") + F.sum("size").over(inside) - F.col("size") + F.floor(F.col("size") / 2)).alias("middle"),
    )
    cut = materialize(at.select("row", "at", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / total)).cast("int").alias("shard")), "cut")
    firsts = cut.groupBy("shard").agg(F.min("at").alias("first"))
    return cut.join(firsts, "shard").select("row", "shard", (F.col("at") - F.col("first")).alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Documents with equal texts are a group; a null text is like an empty one. ``size`` is the
    bytes of the text plus 1. The law is ``bytes``; slots run from 0 without gaps. Repeated rows
    and null ids are placed like any others; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.length(text)).alias("group"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "sized")
    if rows.isEmpty():
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    placed = evened(propagated(rows.select("row", "group", "size"), shards), shards)
    return rows.join(placed, "row").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
