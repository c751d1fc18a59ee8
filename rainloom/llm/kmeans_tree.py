"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every vector is put into one of its leaves. A query
walks down the tree, keeps the branches it passes by in a priority queue ordered by distance to
their centres, and so visits leaves from the most promising on. How many it visits is
calibrated: leaves are added until a set of sample queries, compared with all vectors, reaches
the wanted recall. The vectors of visited leaves are compared exactly, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rainloom.session import materialize

#: Vectors that the tree is fitted on, at most, branches per node, and levels.
SAMPLE, BRANCHES, LEVELS = 20_000, 12, 2
ROUNDS = 12
#: Queries that the number of visits is calibrated on, at most, and the recall they must reach.
CALIBRATION, RECALL = 128, 0.97
#: Vectors of one leaf that are compared in one step; a larger leaf is dealt over several.
CELL = 4096
NEAREST = 5


def usable(vector: str) -> Column:
    """Neither null nor empty, with finite components, not all zero."""
    v = F.col(vector)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column in double precision; all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of every pair; a pair's value doesn't depend on the others it is computed with."""
    return np.einsum("ij,kj->ik", unit(left), unit(right))


class Tree:
    """Centres by level; the leaves are the nodes of the last level, numbered in order."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, levels: int = LEVELS):
        rng = np.random.default_rng(7)
        self.branches, self.levels = branches, levels
        self.centres: list[np.ndarray] = []
        width = sample.shape[1] if sample.ndim == 2 else 1
        groups = [sample]
        for _ in range(levels):
            found, parts = [], []
            for rows in groups:
                centre, label = split(rows, branches, rng, width)
                found.append(centre)
                parts += [rows[label == k] for k in range(branches)]
            self.centres.append(np.array(found))
            groups = parts
        self.leaves = branches**levels

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each unit row: the nearest centre at every level."""
        node = np.zeros(len(rows), np.int64)
        for centres in self.centres:
            near = np.zeros(len(rows), np.int64)
            for k in np.unique(node):
                here = np.flatnonzero(node == k)
                near[here] = np.argmin(distances(rows[here], centres[k]), axis=1)
            node = node * self.branches + near
        return node

    def best_first(self, row: np.ndarray) -> Iterator[int]:
        """Leaves for one unit row, the most promising branch first."""
        heap = [(0.0, 0, 0)]
        while heap:
            _, level, node = heapq.heappop(heap)
            if level == self.levels:
                yield node
                continue
            away = distances(row[None], self.centres[level][node])[0]
            for k, d in enumerate(away.tolist()):
                if d < np.inf:
                    heapq.heappush(heap, (d, level + 1, node * self.branches + k))


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of unit rows to centres, less a constant of the row; empty branches are infinitely far."""
    return np.nan_to_num((centres**2).sum(axis=1) - 2 * rows @ centres.T, nan=np.inf)


def split(rows: np.ndarray, k: int, rng: np.random.Generator, width: int) -> tuple[np.ndarray, np.ndarray]:
    """k-means from well-spread seeds; NaN centres where there are fewer different rows than ``k``."""
    centres = np.full((k, width), np.nan)
    label = np.zeros(len(rows), np.int64)
    if not len(rows):
        return centres, label
    seeds = [rows[0]]
    away = ((rows - seeds[0]) ** 2).sum(axis=1)
    while len(seeds) < k and away.max() > 1e-12:
        seeds.append(rows[rng.choice(len(rows), p=away / away.sum())])
        away = np.minimum(away, ((rows - seeds[-1]) ** 2).sum(axis=1))
    centres[: len(seeds)] = seeds
    for _ in range(ROUNDS):
        label = np.argmin(distances(rows, centres), axis=1)
        for j in range(len(seeds)):
            if (label == j).any():
                centres[j] = rows[label == j].mean(axis=0)
    return centres, np.argmin(distances(rows, centres), axis=1)


def top_rows(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query (rows of ``score``), ties to the smaller id, never the query itself."""
    score = np.where(ids[None, :] == query[:, None], -np.inf, score)
    keep = min(k, score.shape[1])
    edge = -np.partition(-score, keep - 1, axis=1)[:, keep - 1] if keep else np.zeros(len(query))
    row, at = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
    order = np.lexsort((ids[at], -score[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(query)))[row]
    row, at = row[place < keep], at[place < keep]
    return query[row], ids[at], score[row, at]


FOUND = "query_id long, vec_id long, score double"


def merged_top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query out of the cells' bests; a cell gives k at most."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(vectors: DataFrame, ids: np.ndarray, rows: np.ndarray, k: int) -> DataFrame:
    """Nearest of a bounded set of queries among all vectors, block by block."""
    held = vectors.sparkSession.sparkContext.broadcast((ids, rows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, wanted = held.value
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for batch in batches:
            for low in range(0, batch.num_rows, CELL):
                part = batch.slice(low, CELL)
                found = top_rows(query, part.column("vec_id").to_numpy(), cosines(wanted, matrix(part.column("vector"))), k)
                best = tuple(np.concatenate(x) for x in zip(best, found))
            order = np.lexsort((best[1], -best[2], best[0]))
            best = tuple(x[order] for x in best)
            place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            best = tuple(x[place < k] for x in best)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "score"])

    return merged_top(vectors.mapInArrow(search, FOUND), k)


def visits_needed(tree: Tree, queries: np.ndarray, rows: np.ndarray, nearest: list[tuple[int, int, int]], k: int, recall: float) -> int:
    """Fewest leaves to visit so that the sample queries find ``recall`` of their true neighbours.

    ``nearest``: (query, neighbour, leaf of the neighbour).
    """
    rank = {}
    for query, row in zip(queries.tolist(), unit(rows) if len(rows) else rows):
        rank[query] = {leaf: place for place, leaf in enumerate(tree.best_first(row), 1)}
    visit = sorted(rank[q][leaf] for q, _, leaf in nearest)
    return visit[min(len(visit) - 1, int(np.ceil(recall * len(visit))) - 1)] if visit else tree.leaves


def nearest_vectors(
    table: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST,
    recall: float = RECALL, sample: int = SAMPLE, calibration: int = CALIBRATION,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest by cosine of every row that satisfies ``queries``.

    A row's own id is no candidate of its. Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, nor do those of another length than most have (of equally
    frequent lengths the longest counts). Repeated ids count once, with the smallest of their
    vectors; a null id takes no part. Equal vectors tie, smaller ids first.
    Where a query's leaves hold fewer than k vectors, all leaves are visited. An empty table
    gives an empty result.
    """
    spark = table.sparkSession
    rows = table.where(F.col(f"`{key}`").isNotNull() & usable(f"`{vector}`")).select(
        F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    first = F.min(F.struct("vector", "asks")).alias("row")
    rows = materialize(rows.groupBy("vec_id", F.size("vector").alias("width")).agg(first).select("vec_id", "row.*", "width"), "vectors")
    common = rows.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).select("width").limit(1)
    rows = rows.where(F.col("width") == common.scalar()).drop("width")
    ranked = F.xxhash64("vec_id")
    drawn = rows.orderBy(ranked, "vec_id").limit(sample).select("vector").toArrow()
    tree = Tree(unit(matrix(drawn.column("vector"))) if drawn.num_rows else np.zeros((0, 1)))
    held = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, CELL):
                part = batch.slice(low, CELL)
                leaf = held.value.leaf(unit(matrix(part.column("vector"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], names=[*part.schema.names, "leaf"])

    placed = materialize(rows.mapInArrow(place, "vec_id long, vector array<double>, asks boolean, leaf long"), "placed")
    asked = placed.where("asks").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(calibration).select("vec_id", "vector").toArrow()
    ids = asked.column("vec_id").to_numpy()
    vectors = matrix(asked.column("vector")) if asked.num_rows else np.zeros((0, 1))
    exact = brute_force(placed, ids, vectors, k).join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "vec_id", "leaf")
    visits = visits_needed(tree, ids, vectors, [tuple(r) for r in exact.collect()], k, recall)
    cells = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("cells", F.ceil(F.col("n") / CELL).cast("int"))
    counts = {r["leaf"]: (r["n"], r["cells"]) for r in cells.collect()}
    sizes = spark.sparkContext.broadcast(counts)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                at, leaf, cell = [], [], []
                for i, row in enumerate(unit(matrix(part.column("vector")))):
                    found = 0
                    for seen, node in enumerate(held.value.best_first(row), 1):
                        n, split_in = sizes.value.get(node, (0, 0))
                        at += [i] * split_in
                        leaf += [node] * split_in
                        cell += range(split_in)
                        found += n
                        if seen >= visits and found > k:
                            break
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(at, pa.int64())), part.column("vector").take(pa.array(at, pa.int64())), pa.array(leaf, pa.int64()), pa.array(cell, pa.int32())],
                    names=["vec_id", "vector", "leaf", "cell"],
                )

    visited = placed.where("asks").select("vec_id", "vector").repartition("vec_id").mapInArrow(walk, "vec_id long, vector array<double>, leaf long, cell int")
    owned = placed.join(F.broadcast(cells.select("leaf", "cells")), "leaf").select(
        "vec_id", "vector", "leaf", F.pmod(ranked, F.col("cells")).cast("int").alias("cell"), F.lit(False).alias("asks")
    )
    both = owned.unionByName(visited.withColumn("asks", F.lit(True))).repartition("leaf", "cell").sortWithinPartitions("leaf", "cell", "asks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held_ids, held_rows = None, [], []
        for batch in batches:
            names = list(zip(batch.column("leaf").to_pylist(), batch.column("cell").to_pylist(), batch.column("asks").to_pylist()))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(low, high - low)
                if here != names[low][:2]:
                    here, held_ids, held_rows = names[low][:2], [], []
                part_ids, part_rows = part.column("vec_id").to_numpy(), matrix(part.column("vector"))
                if not names[low][2]:
                    held_ids.append(part_ids)
                    held_rows.append(part_rows)
                    continue
                if not held_ids:
                    continue
                own, own_rows = np.concatenate(held_ids), np.concatenate(held_rows)
                held_ids, held_rows = [own], [own_rows]
                for step in range(0, len(part_ids), 256):
                    some = slice(step, step + 256)
                    found = top_rows(part_ids[some], own, cosines(part_rows[some], own_rows), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return merged_top(both.select("leaf", "cell", "asks", "vec_id", "vector").mapInArrow(compare, FOUND), k).select("query_id", "rank", "vec_id", "score")
