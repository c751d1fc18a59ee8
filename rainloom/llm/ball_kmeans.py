"""Vector codes by ball k-means: each part of a vector is replaced by the index of its nearest entry.

Components are whole numbers, so every distance is exact. After the first round an entry is a
ball: its centre, and the largest distance of its members to where the entry stood. Only entries
that lie less than two radii away (its neighbours) can take a member. Members nearer to the centre
than half the way to the nearest neighbour are its stable core and keep their entry unseen; the
others lie in rings, and a ring is compared only with the neighbours whose half-way it reaches.
A ball that stands still among neighbours that stand still skips the round as a whole.

The vectors stay in tables that Spark reads block by block; per round the driver sees one row of
sums for each entry of each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rainloom.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held within this bound either way, so that no sum of squares passes 64 bits.
BOUND = 1 << 26
#: Whole numbers up to this are exact in double precision.
EXACT = 1 << 53


def finite(vector: str) -> Column:
    """Neither null nor empty, and every component a finite number (all may be zero)."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(vector: str) -> Column:
    """Components as whole numbers ``floor(SCALE * x)``, held within ``BOUND``."""
    def one(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int")

    return F.transform(F.col(vector), one)


def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    largest = max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0), 1)
    if 4 * rows.shape[1] * int(largest) ** 2 < EXACT:
        rows, entries = rows.astype(np.float64), entries.astype(np.float64)
    away = (rows**2).sum(axis=1)[:, None] - 2 * (rows @ entries.T) + (entries**2).sum(axis=1)[None]
    return away.astype(np.int64)


def own_distance(rows: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((rows - entries[code]) ** 2).sum(axis=1)


class Balls:
    """The codebook of one part position as balls: entries, their neighbours, and which may skip."""

    def __init__(self, entries: np.ndarray, radius: np.ndarray | None = None, before: Balls | None = None):
        self.entries, self.first = entries, before is None
        if before is None:
            return
        shift = ((entries - before.entries) ** 2).sum(axis=1)
        moved = shift > 0
        # no member is farther from the entry's new place than from the old one plus the way between
        reach = np.sqrt(radius.astype(np.float64)) + np.sqrt(shift.astype(np.float64))
        reach = reach * (1 + 1e-9) + 1e-6
        between = squared(entries, entries)
        near = between <= 4 * reach[:, None] ** 2
        np.fill_diagonal(near, True)
        self.neighbours, self.halves = [], []
        for i in range(len(entries)):
            at = np.flatnonzero(near[i])
            at = at[np.lexsort((at, between[i, at]))]
            self.neighbours.append(at)
            self.halves.append(between[i, at])
        self.skip = np.array([not moved[at].any() for at in self.neighbours])

    def assign(self, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Index of the nearest entry of every row, ties to the lower index; ``code`` is the last round's."""
        if self.first:
            return np.argmin(squared(rows, self.entries), axis=1).astype(np.int64)
        out = code.copy()
        reach = 4 * own_distance(rows, self.entries, code)
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(self.entries) + 1))
        for i in np.flatnonzero((np.diff(cuts) > 0) & ~self.skip):
            members = order[cuts[i] : cuts[i + 1]]
            ring = np.searchsorted(self.halves[i], reach[members], "right")
            active = ring > 1
            members, ring = members[active], ring[active]
            wide = 2
            while len(members):
                here = ring <= wide
                out[members[here]] = self._nearest(rows[members[here]], self.neighbours[i][:wide], ring[here])
                members, ring, wide = members[~here], ring[~here], wide * 2
        return out

    @staticmethod
    def _masked(away: np.ndarray, ring: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.where(rank[None] < ring[:, None], away, np.iinfo(np.int64).max)

    def _nearest(self, rows: np.ndarray, candidates: np.ndarray, ring: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0, np.int64)
        rank = np.argsort(candidates)
        away = self._masked(squared(rows, self.entries[candidates[rank]]), ring, rank)
        return candidates[rank][np.argmin(away, axis=1)]


def ints(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def cuts(width: int, parts: int) -> list[slice]:
    return [slice(p * width // parts, (p + 1) * width // parts) for p in range(parts)]


def assigned(state: DataFrame, books: list[Balls], width: int) -> DataFrame:
    """``state`` (key, label, whole numbers, codes of the last round) with the codes of this one."""
    held = state.sparkSession.sparkContext.broadcast(books)
    names = ["vec_id", "label", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = cuts(width, len(held.value))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, old = ints(batch.column("whole")), ints(batch.column("code"))
            new = np.column_stack([b.assign(rows[:, s], old[:, p]) for p, (b, s) in enumerate(zip(held.value, parts))])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists(new, pa.int32())], names=[*names, "code"])

    return state.select(*names, "code").mapInArrow(run, state.select(*names, "code").schema)


def entry_sums(state: DataFrame, books: list[Balls], width: int) -> list:
    """Per part and entry: members, component sums, and the largest squared distance to the entry."""
    held = state.sparkSession.sparkContext.broadcast([b.entries for b in books])
    most = max(s.stop - s.start for s in cuts(width, len(books)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = cuts(width, len(held.value))
        count = [np.zeros(len(e), np.int64) for e in held.value]
        far = [np.zeros(len(e), np.int64) for e in held.value]
        total = [np.zeros((len(e), most), np.int64) for e in held.value]
        for batch in batches:
            rows, code = ints(batch.column("whole")), ints(batch.column("code"))
            for p, s in enumerate(parts):
                own = code[:, p]
                count[p] += np.bincount(own, minlength=len(count[p]))
                np.maximum.at(far[p], own, own_distance(rows[:, s], held.value[p], own))
                np.add.at(total[p][:, : s.stop - s.start], own, rows[:, s])
        for p in range(len(parts)):
            used = np.flatnonzero(count[p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]), pa.array(far[p][used]), lists(total[p][used], pa.int64())],
                names=["part", "entry", "n", "far", "total"],
            )

    sums = state.select("whole", "code").mapInArrow(run, "part int, entry int, n long, far long, total array<long>")
    each = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(most)]
    return sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *each).collect()


def moved(books: list[Balls], rows: list, width: int) -> list[Balls]:
    """The next codebooks: each used entry at the floor of its members' mean; unused entries stay."""
    parts = cuts(width, len(books))
    entries = [b.entries.copy() for b in books]
    far = [np.zeros(len(b.entries), np.int64) for b in books]
    for r in rows:
        size = parts[r["part"]].stop - parts[r["part"]].start
        entries[r["part"]][r["entry"]] = [int(r[f"t{k}"]) // r["n"] for k in range(size)]
        far[r["part"]][r["entry"]] = r["far"]
    return [Balls(e, f, b) for e, f, b in zip(entries, far, books)]


def digest(books: list[Balls]) -> str:
    text = ",".join(str(x) for b in books for x in b.entries.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def coded_vectors(
    vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all usable vectors, and the codebook of every part position.

    ``vectors`` has ``vec_id``, ``label`` and the vector; other columns are left out. Rows whose
    vector is null, empty or holds null or non-finite components are dropped, and so are vectors
    of another length than most have (of equally frequent lengths the longest counts); a length
    that ``parts`` doesn't divide is cut as evenly as it goes. Components beyond ``BOUND / SCALE``
    count as that bound. Repeated rows are coded each on its own. The first codebook
    comes from the smallest vec_ids (null ids last, equal ids by their components), and has fewer
    entries than asked for where there are fewer rows. Null labels count as one label. An empty
    table gives an empty result.

    Result: ``vec_id``, ``label``, ``code`` (index per part), ``error`` and ``codebooks_sha256``.
    """
    usable = vectors.select("vec_id", "label", vector).where(finite(vector))
    lengths = usable.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths["width"] if lengths else parts
    start = usable.where(F.size(vector) == width).select("vec_id", "label", whole(vector).alias("whole"))
    state = materialize(start.withColumn("code", F.array_repeat(F.lit(0), parts)), "ball-vectors")
    seeds = state.orderBy(F.asc_nulls_last("vec_id"), "whole").select("whole").limit(entries).collect()
    seeds = np.array([r["whole"] for r in seeds], np.int64).reshape(len(seeds), width)
    books = [Balls(seeds[:, s]) for s in cuts(width, parts)]
    for _ in range(rounds if len(seeds) else 0):
        state = materialize(assigned(state, books, width), "ball-round")
        books = moved(books, entry_sums(state, books, width), width)
    if len(seeds):
        state = assigned(state, books, width)
    return with_error(state, books, width), [b.entries for b in books]


def with_error(state: DataFrame, books: list[Balls], width: int) -> DataFrame:
    held = state.sparkSession.sparkContext.broadcast([b.entries for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, code = ints(batch.column("whole")), ints(batch.column("code"))
            error = sum(own_distance(rows[:, s], e, code[:, p]) for p, (e, s) in enumerate(zip(held.value, cuts(width, len(held.value)))))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("vec_id", "label", "code")], pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = state.select("vec_id", "label", "code", F.lit(0).cast("long").alias("error")).schema
    return state.where(F.size("code") > 0).mapInArrow(run, schema).withColumn("codebooks_sha256", F.lit(digest(books)))


def hex_code(code: str = "code", parts: int = PARTS) -> Column:
    """Indexes in part order, two hex digits each."""
    return F.lower(reduce(F.concat, [F.lpad(F.hex(F.col(code)[p]), 2, "0") for p in range(parts)]))


def code_table(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``code`` (hex), ``error``, ``label_error`` (sum over equal labels) and the digest of all entries."""
    coded = coded_vectors(vectors, vector)[0]
    coded = materialize(coded.select("vec_id", "label", hex_code().alias("code"), "error", "codebooks_sha256"), "ball-codes")
    totals = coded.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_of")), "left").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
