"""Similarity join of documents on word n-grams by MinHash bands, verified on the full sets.

Equal sets are one class and are matched once. Classes that share a band go to one component;
every pair of a component is verified, exactly and in blocks, so a pair isn't lost because a
bucket is large. Results are counts and class ids, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from rainloom.llm.components import components
from rainloom.llm.textblocks import BLOCK_BYTES, blocks, distinct_per_text, flat, mixed, owners, span_hashes, sums, word_bounds
from rainloom.session import materialize

WORDS = 5
THRESHOLD = 0.8
#: Share of the pairs at exactly the threshold that must meet in a band; pairs above meet more often.
RECALL = 0.9999
#: Hashes per document at most.
MOST_HASHES = 200
#: Classes compared with one another in one step.
BLOCK = 256
COLUMNS = 8192


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest chance meetings, that reach ``recall``."""
    best = None
    for rows in range(1, 33):
        met = threshold**rows
        bands = 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-met))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding within the given number of hashes reaches the recall")
    return best


def gram_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and the index of each text's first.

    A text of 1 to n - 1 words has one gram, all its words; one without words has none.
    """
    data, offsets = flat(texts)
    starts, ends, firsts = word_bounds(data, offsets)
    hashes, words = span_hashes(data, starts, ends), np.diff(firsts)
    grams = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    begins = np.concatenate((np.zeros(1, np.int64), np.cumsum(grams)))
    text = owners(begins)
    place = np.arange(len(text)) - begins[text] + firsts[text]
    value = np.zeros(len(text), np.uint64)
    for k in range(n):
        inside = place + k < firsts[text + 1]
        word = hashes[np.minimum(place + k, max(len(hashes) - 1, 0))] if len(hashes) else hashes
        value = np.where(inside, mixed(value * np.uint64(0x9E3779B97F4A7C15) + word), value)
    text, value, _ = distinct_per_text(value, begins)
    return value, np.searchsorted(text, np.arange(len(words) + 1))


def signatures(docs: DataFrame, bands: int, rows: int, n: int = WORDS) -> DataFrame:
    """(doc_id, n_grams, set_a, set_b, bands): the set's identity and one hash per band.

    The hash of a band starts from its number, so it names the bucket by itself.
    """
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            value, firsts = gram_sets(part.column("text"), n)
            count = np.diff(firsts)
            some = np.flatnonzero(count)
            out = np.zeros((len(count), bands), np.uint64)
            high = (value >> np.uint64(32)).astype(np.uint32)
            moved = np.empty_like(high)
            for band in range(bands if len(some) else 0):
                held = np.full(len(some), band, np.uint64)
                for k in range(band * rows, (band + 1) * rows):
                    np.multiply(high, odd[k], out=moved)
                    moved += add[k]
                    held = mixed(held ^ np.minimum.reduceat(moved, firsts[some]).astype(np.uint64))
                out[some, band] = held
            spread = mixed(value)
            keys = [sums(spread, firsts).view(np.int64), sums(mixed(spread + np.uint64(1)), firsts).view(np.int64)]
            flat_bands = pa.array(out[some].view(np.int64).ravel())
            width = np.where(count > 0, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(count), *map(pa.array, keys),
                 pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(width))).astype(np.int32)), flat_bands)],
                names=["doc_id", "n_grams", "set_a", "set_b", "bands"],
            )

    schema = "doc_id long, n_grams long, set_a long, set_b long, bands array<long>"
    return docs.select(F.col("doc_id").cast(LongType()).alias("doc_id"), "text").mapInArrow(sign, schema)


def linked(inter: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose intersection over union is at least ``threshold``, in whole numbers."""
    cut = round(threshold * 10_000)
    return 10_000 * inter >= cut * (size[:, None] + size[None, :] - inter)


def verify_cell(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, ids: np.ndarray, threshold: float, within: bool):
    """Links among one block or between two: (position, classes, documents, smallest id reached)."""
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    first = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for at, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        dense = np.zeros((len(sets), COLUMNS if len(edges) > 2 else max(1, int(shared.sum()))), np.float32)
        dense[row[low:high], column[low:high] - at * COLUMNS] = 1
        inter += dense @ dense.T
    link = linked(inter.astype(np.int64), size, threshold)
    np.fill_diagonal(link, False)
    if not within:
        link &= side[:, None] != side[None, :]
    some = np.flatnonzero(link.any(axis=1))
    reach = ids.copy()
    while True:
        lower = np.minimum(reach, np.where(link, reach[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == reach).all():
            break
        reach = lower
    return some, link[some].sum(axis=1), (link[some] * weight[None, :]).sum(axis=1), reach[some]


def verified(members: DataFrame, threshold: float, n: int) -> DataFrame:
    """``members``: (cell, within, side, rep, copies, text), sorted by cell within partitions.

    Yields (rep, classes, documents, root) for every class with a link in a cell.
    """
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            size = 0
            for part in blocks(batches):
                cell = part.column("cell").to_numpy()
                cut = int(np.flatnonzero(cell == cell[-1])[0])
                if held and held[-1].column("cell")[-1].as_py() != cell[0] and size >= BLOCK_BYTES:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                if cut and size + part.nbytes >= BLOCK_BYTES:
                    yield pa.Table.from_batches([*held, part.slice(0, cut)])
                    held, size, part = [], 0, part.slice(cut)
                held.append(part)
                size += part.nbytes
            if held:
                yield pa.Table.from_batches(held)

        for table in cells():
            value, firsts = gram_sets(table.column("text"), n)
            cell, side, within = (table.column(c).to_numpy() for c in ("cell", "side", "within"))
            rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
            found = []
            again = np.concatenate(([False], (cell[1:] == cell[:-1]) & (rep[1:] == rep[:-1])))
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            for low, high in zip(starts, [*starts[1:], len(cell)]):
                at = np.arange(low, high)[~again[low:high]]
                if len(at) > 1:
                    sets = [value[firsts[k] : firsts[k + 1]] for k in at]
                    some, classes, documents, root = verify_cell(sets, side[at], copies[at], rep[at], threshold, bool(within[low]))
                    found.append((rep[at][some], classes, documents, root))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], names=["rep", "classes", "documents", "root"])

    return members.mapInArrow(check, "rep long, classes long, documents long, root long")


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One row per document: ``doc_id``, ``copy_id``, ``class_id``, ``n_links``.

    ``copy_id`` is the smallest doc_id with the same set of n-grams, ``class_id`` the smallest
    of all documents reached over links (Jaccard of ``threshold`` or more), ``n_links`` the
    number of other documents that this one is linked with. A text without words links to
    nothing. Rows with a null doc_id come back with null ids and 0 links; repeated rows count
    as documents of their own. A doc_id is taken to name one text. An empty table gives an empty result.
    """
    bands, rows = bands_for(threshold, recall)
    signed = materialize(signatures(docs, bands, rows, n), "signatures")
    known = signed.where(F.col("doc_id").isNotNull() & (F.col("n_grams") > 0))
    key = ["n_grams", "set_a", "set_b"]
    classes = materialize(
        known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")), "classes"
    )
    met = classes.select("rep", F.explode("bands").alias("bucket")).repartition("bucket")
    buckets = met.groupBy("bucket").agg(F.min("rep").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = met.join(buckets, "bucket").select("src", F.col("rep").alias("dst"))
    groups = components(stars)
    sizes = groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = (
        groups.join(sizes, "label").join(classes.select(F.col("rep").alias("node"), "copies"), "node")
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    texts = docs.select(F.col("doc_id").cast(LongType()).alias("node"), "text").where("node IS NOT NULL")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = (
        texts.join(placed, "node")
        .withColumn("_other", other)
        .select(
            F.xxhash64("label", F.least("side", "_other"), F.greatest("side", "_other")).alias("cell"),
            (F.col("side") == F.col("_other")).alias("within"), "side", F.col("node").alias("rep"), "copies", "text",
        )
        .repartition("cell").sortWithinPartitions("cell", "side", "rep")
    )
    links = materialize(verified(cells, threshold, n), "links")
    counts = links.groupBy("rep").agg(F.sum("documents").alias("documents"))
    roots = components(links.select(F.col("root").alias("src"), F.col("rep").alias("dst")))
    per_class = (
        classes.select(*key, "rep", "copies")
        .join(counts, "rep", "left")
        .join(roots.select(F.col("node").alias("rep"), F.col("label").alias("class_id")), "rep", "left")
    )
    return (
        signed.select("doc_id", *[F.when(F.col("doc_id").isNotNull() & (F.col("n_grams") > 0), F.col(c)).alias(c) for c in key])
        .join(per_class, key, "left")
        .select(
            "doc_id",
            F.coalesce("rep", "doc_id").alias("copy_id"),
            F.coalesce("class_id", "rep", "doc_id").alias("class_id"),
            (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("documents", F.lit(0))).cast("long").alias("n_links"),
        )
    )


def one_per_group(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class; of repeated rows, one stays.

    Rows with a null doc_id have no class and stay.
    """
    kept = similar_documents(docs, threshold, n).where(F.col("class_id") == F.col("doc_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    once = named.dropDuplicates(["doc_id"])
    return once.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
