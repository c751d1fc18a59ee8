"""Gradient boosting on histograms, for many models at once and with missing values as data.

Inputs are cut into at most 255 quantile bins; missing values have a bin of their own and go to
the side of a split that gains more. A tree grows best leaf first: of all leaves the one whose
split gains most is split next. All it needs are sums of gradients and curvatures per (model,
node, input, bin). They are whole numbers of ``UNIT``, so a sum doesn't depend on how rows are
partitioned, and a model comes out the same wherever its histograms are added up:

* models whose binned rows are known to fit into one task (``LOCAL_CELLS``) grow there, each
  model in its own task, all of them in one Spark job;
* larger models grow through aggregations, one job for the next nodes of all models together.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rainloom.session import materialize

BINS, MISSING = 255, 255
#: Gradients and curvatures are counted in units of 1 / UNIT: 2^33 rows fit into 64 bits.
UNIT = 1 << 30
#: Rows times inputs of one model that a task may hold.
LOCAL_CELLS = 1 << 26
#: Rounds after which the scores so far are written, so that no task replays more trees.
REPLAY = 10


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    step: float = 0.05
    leaves: int = 31
    l2: float = 1.0
    least_rows: int = 20
    least_curve: float = 1e-3

    def leaf(self, gradient: int, curve: int) -> float:
        return -self.step * (gradient / UNIT) / (curve / UNIT + self.l2)


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool


@dataclass
class Node:
    """Sums over the rows of a node, and its best split if there is one."""

    gradient: int
    curve: int
    rows: int
    split: Split | None

    def value(self, s: Settings) -> float:
        return s.leaf(self.gradient, self.curve)


# --- trees --------------------------------------------------------------------------------

@dataclass
class Tree:
    """Node 0 is the root; a leaf has feature -1. Inputs up to the bin go left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, nodes: dict[int, Node], parted: set[int], s: Settings) -> Tree:
        """From nodes by path (root 1, children 2p and 2p + 1) and the paths that were split."""
        tree, places = cls(), {}
        for path in sorted(p for p in nodes if p == 1 or p // 2 in parted):
            places[path] = len(places)
        for path in places:
            node = nodes[path]
            inner = path in parted
            tree.feature.append(node.split.feature if inner else -1)
            tree.bin.append(node.split.bin if inner else 0)
            tree.missing_left.append(bool(inner and node.split.missing_left))
            tree.left.append(places[2 * path] if inner else -1)
            tree.right.append(places[2 * path + 1] if inner else -1)
            tree.value.append(0.0 if inner else node.value(s))
            tree.gain.append(node.split.gain if inner else 0.0)
        return tree

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, side, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            node = at[rows]
            x = bins[rows, feature[node]]
            goes_left = np.where(x == MISSING, side[node], x <= cut[node])
            at[rows] = np.where(goes_left, left[node], right[node])
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves_of(bins)]


def shared_gains(trees: list[Tree], inputs: int) -> np.ndarray:
    """Share of every input in the gains of all splits."""
    total = np.zeros(inputs)
    for t in trees:
        for f, g in zip(t.feature, t.gain):
            if f >= 0:
                total[f] += g
    return total / total.sum() if total.sum() > 0 else total


@dataclass
class Ensemble:
    cuts: list[list[float]]
    base: float
    trees: list[Tree]

    def raw(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.cuts)
        return self.base + sum((t.scores(bins) for t in self.trees), np.zeros(len(bins)))

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(values)))

    def gains(self) -> np.ndarray:
        return shared_gains(self.trees, len(self.cuts))

    def dumps(self) -> str:
        return json.dumps({"cuts": self.cuts, "base": self.base, "trees": [t.__dict__ for t in self.trees]})

    @classmethod
    def loads(cls, text: str) -> Ensemble:
        facts = json.loads(text)
        return cls(facts["cuts"], facts["base"], [Tree(**t) for t in facts["trees"]])


def binned(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin of every value: the number of cuts below it."""
    out = np.empty(values.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(np.array(c), values[:, f], "left")
        out[np.isnan(values[:, f]), f] = MISSING
    return out


# --- histograms and splits ----------------------------------------------------------------

def gradients(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log loss, in units."""
    chance = 1 / (1 + np.exp(-raw))
    return np.rint((chance - label) * UNIT), np.rint(chance * (1 - chance) * UNIT)


def histogram(bins: np.ndarray, gradient: np.ndarray, curve: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Sums per (input, bin): gradient, curvature, rows."""
    n, width = bins.shape
    out = np.zeros((3, width * 256), np.int64)
    offset = np.arange(width, dtype=np.int64) * 256
    for start in range(0, n, step):
        part = slice(start, start + step)
        flat = (bins[part] + offset).ravel()
        for k, w in enumerate((gradient[part], curve[part])):
            out[k] += np.bincount(flat, np.repeat(w, width), width * 256).astype(np.int64)
        out[2] += np.bincount(flat, minlength=width * 256)
    return out.reshape(3, width, 256)


def node_of(hist: np.ndarray, s: Settings) -> Node:
    """The node's sums and its best split; ties to the first input, then the smallest bin."""
    gradient, curve, rows = (int(x) for x in hist[:, 0].sum(axis=1)) if hist.shape[1] else (0, 0, 0)
    node = Node(gradient, curve, rows, None)
    if rows < 2 * s.least_rows or not hist.shape[1]:
        return node
    used = max(1, int(np.flatnonzero(hist[2, :, :BINS].any(axis=0)).max(initial=0)))
    left = np.cumsum(hist[:, :, :used], axis=2)
    missing = hist[:, :, MISSING][:, :, None]
    both = np.stack([left, left + missing])  # missing values to the right, or to the left
    g, h, n = both[:, 0] / UNIT, both[:, 1] / UNIT, both[:, 2]
    total_g, total_h = gradient / UNIT, curve / UNIT
    fine = (n >= s.least_rows) & (rows - n >= s.least_rows) & (h >= s.least_curve) & (total_h - h >= s.least_curve)
    with np.errstate(divide="ignore", invalid="ignore"):  # sides without rows have no curvature
        gain = np.where(fine, g**2 / (h + s.l2) + (total_g - g) ** 2 / (total_h - h + s.l2) - total_g**2 / (total_h + s.l2), -np.inf)
    best = gain.max(axis=0)
    at = int(best.argmax())
    f, b = divmod(at, used)
    if not best[f, b] > 1e-9:
        return node
    if hist[2, f, MISSING]:
        side = bool(gain[1, f, b] > gain[0, f, b])
    else:  # none seen here: later ones go with the larger part
        side = bool(2 * n[0, f, b] >= rows)
    node.split = Split(float(best[f, b]), f, b, side)
    return node


def goes_left(bins: np.ndarray, split: Split) -> np.ndarray:
    x = bins[:, split.feature]
    return np.where(x == MISSING, split.missing_left, x <= split.bin)


def base_score(label_sum: float, rows: int) -> float:
    mean = min(max(label_sum / rows if rows else 0.5, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


# --- models that fit into a task ----------------------------------------------------------

def grow(bins: np.ndarray, gradient: np.ndarray, curve: np.ndarray, s: Settings) -> tuple[Tree, np.ndarray]:
    """One tree, best leaf first, and the score it gives every row."""
    hists = {1: histogram(bins, gradient, curve)}
    nodes, members = {1: node_of(hists[1], s)}, {1: np.arange(len(bins))}
    heap = [(-nodes[1].split.gain, 1)] if nodes[1].split else []
    parted: set[int] = set()
    while heap and len(parted) + 1 < s.leaves:
        _, path = heapq.heappop(heap)
        rows, whole = members.pop(path), hists.pop(path)
        side = goes_left(bins[rows], nodes[path].split)
        parts = {2 * path: rows[side], 2 * path + 1: rows[~side]}
        small = min(parts, key=lambda p: len(parts[p]))
        mine = parts[small]
        hists[small] = histogram(bins[mine], gradient[mine], curve[mine])
        hists[small ^ 1] = whole - hists[small]
        parted.add(path)
        for p in parts:
            members[p], nodes[p] = parts[p], node_of(hists[p], s)
            if nodes[p].split:
                heapq.heappush(heap, (-nodes[p].split.gain, p))
    scores = np.zeros(len(bins))
    for p, rows in members.items():
        scores[rows] = nodes[p].value(s)
    return Tree.of(nodes, parted, s), scores


def boosted_trees(bins: np.ndarray, label: np.ndarray, s: Settings) -> tuple[float, list[Tree]]:
    base = base_score(float(label.sum()), len(label))
    raw, trees = np.full(len(label), base), []
    for _ in range(s.rounds):
        tree, scores = grow(bins, *gradients(raw, label), s)
        if len(tree.feature) <= 1:
            break
        trees.append(tree)
        raw += scores
    return base, trees


def local_models(rows: DataFrame, models: int, width: int, s: Settings) -> dict[int, tuple[float, list[Tree]]]:
    """``rows``: ``bins``, ``y`` and the numbers of the models that learn from the row. Every model has a partition of its own."""
    def train(table: pa.Table) -> pa.Table:
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, width)
        base, trees = boosted_trees(bins, table.column("y").to_numpy(), s)
        return pa.table({"model": table.column("model")[:1], "trees": [Ensemble([], base, trees).dumps()]})

    each = rows.select("bins", "y", F.explode("models").alias("model")).repartitionByRange(models, "model").groupBy("model").applyInArrow(train, "model int, trees string")
    found = ((r["model"], Ensemble.loads(r["trees"])) for r in each.collect())
    return {m: (e.base, e.trees) for m, e in found}


# --- models that grow through aggregations -------------------------------------------------

def best_first(nodes: dict[int, Node], leaves: int) -> tuple[set[int], list[int]]:
    """Paths that are split as far as the known nodes tell, and paths that must be known next."""
    heap = [(-nodes[1].split.gain, 1)] if nodes[1].split else []
    parted, unknown = set(), []
    while heap and len(parted) + 1 < leaves:
        _, path = heapq.heappop(heap)
        parted.add(path)
        for p in (2 * path, 2 * path + 1):
            if p not in nodes:
                unknown.append(p)
            elif nodes[p].split:
                heapq.heappush(heap, (-nodes[p].split.gain, p))
    return parted, unknown


def paths_of(bins: np.ndarray, nodes: dict[int, Node], wanted: set[int]) -> np.ndarray:
    """Path of the wanted node that each row lies in, 0 where it lies in none."""
    above = {p >> k for p in wanted for k in range(1, p.bit_length())}
    out, queue = np.zeros(len(bins), np.int64), [(1, np.arange(len(bins)))]
    while queue:
        path, rows = queue.pop()
        if path in wanted:
            out[rows] = path
        if path in above and len(rows):
            side = goes_left(bins[rows], nodes[path].split)
            queue += [(2 * path, rows[side]), (2 * path + 1, rows[~side])]
    return out


def _arrays(batch: pa.RecordBatch, width: int, models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels, scores so far (rows x models), and which model learns from which row."""
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, width)
    raw = np.frombuffer(b"".join(batch.column("raw").to_pylist()), np.float64).reshape(n, models)
    lists = batch.column("models")
    learns = np.zeros((n, models), bool)
    sizes = np.diff(lists.offsets.to_numpy())
    learns[np.repeat(np.arange(n), sizes), lists.flatten().to_numpy()] = True
    return bins, batch.column("y").to_numpy(), raw, learns


def next_nodes(state: DataFrame, width: int, models: int, since: dict, nodes: dict, wanted: dict, s: Settings) -> list:
    """Sums and best splits of the wanted nodes of all models, in one job."""
    held = state.sparkSession.sparkContext.broadcast((since, nodes, wanted))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since, nodes, wanted = held.value
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            bins, label, raw, learns = _arrays(batch, width, models)
            for m, paths in wanted.items():
                mine = np.flatnonzero(learns[:, m])
                own, score = bins[mine], raw[mine, m]
                for tree in since[m]:
                    score = score + tree.scores(own)
                gradient, curve = gradients(score, label[mine])
                at = paths_of(own, nodes[m], set(paths))
                for p in paths:
                    here = at == p
                    if here.any():
                        hist = histogram(own[here], gradient[here], curve[here])
                        total[m, p] = total[m, p] + hist if (m, p) in total else hist
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m for m, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int64()), pa.array([total[k].tobytes() for k in keys], pa.binary())],
            names=["model", "path", "hist"],
        )

    def best(table: pa.Table) -> pa.Table:
        hist = np.zeros((3, width, 256), np.int64)
        for one in table.column("hist").to_pylist():
            hist += np.frombuffer(one, np.int64).reshape(hist.shape)
        node = node_of(hist, s)
        split = node.split or Split(float("nan"), -1, 0, False)
        return pa.table({
            "model": table.column("model")[:1], "path": table.column("path")[:1], "gradient": [node.gradient], "curve": [node.curve], "rows": [node.rows],
            "gain": [split.gain], "feature": [split.feature], "bin": [split.bin], "missing_left": [split.missing_left],
        })

    return state.mapInArrow(sums, "model int, path long, hist binary").groupBy("model", "path").applyInArrow(
        best, "model int, path long, gradient long, curve long, rows long, gain double, feature long, bin long, missing_left boolean"
    ).collect()


def aggregated_models(rows: DataFrame, width: int, bases: dict[int, float], s: Settings) -> dict[int, tuple[float, list[Tree]]]:
    """The same models as ``local_models``; no task holds more than its own rows and some histograms."""
    models = max(bases) + 1 if bases else 0
    start = np.array([bases.get(m, 0.0) for m in range(models)]).tobytes()
    state = rows.withColumn("raw", F.lit(bytearray(start)))
    trees: dict[int, list[Tree]] = {m: [] for m in bases}
    since: dict[int, list[Tree]] = {m: [] for m in bases}
    growing = set(bases)
    for round_no in range(s.rounds):
        nodes: dict[int, dict[int, Node]] = {m: {} for m in growing}
        wanted = {m: [1] for m in growing}
        while wanted:
            for r in next_nodes(state, width, models, since, nodes, wanted, s):
                split = Split(r["gain"], r["feature"], r["bin"], r["missing_left"]) if r["feature"] >= 0 else None
                nodes[r["model"]][r["path"]] = Node(r["gradient"], r["curve"], r["rows"], split)
            more = {m: best_first(nodes[m], s.leaves)[1] for m in wanted if nodes[m]}
            wanted = {m: paths for m, paths in more.items() if paths}
        for m in list(growing):
            tree = Tree.of(nodes[m], best_first(nodes[m], s.leaves)[0], s) if nodes[m] else Tree()
            if len(tree.feature) <= 1:
                growing.discard(m)
            else:
                trees[m].append(tree)
                since[m].append(tree)
        if not growing:
            break
        if (round_no + 1) % REPLAY == 0:
            state = materialize(_caught_up(state, width, models, since), "boosting")
            since = {m: [] for m in bases}
    return {m: (bases[m], trees[m]) for m in bases}


def _caught_up(state: DataFrame, width: int, models: int, since: dict) -> DataFrame:
    held = state.sparkSession.sparkContext.broadcast(since)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, raw, learns = _arrays(batch, width, models)
            raw = raw.copy()
            for m, trees in held.value.items():
                mine = np.flatnonzero(learns[:, m])
                for tree in trees:
                    raw[mine, m] += tree.scores(bins[mine])
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), batch.column("models"), pa.array([r.tobytes() for r in raw], pa.binary())], names=["bins", "y", "models", "raw"])

    return state.select("bins", "y", "models", "raw").mapInArrow(run, state.select("bins", "y", "models", "raw").schema)


# --- from a feature frame to models ----------------------------------------------------------

def quantile_cuts(rows: DataFrame, inputs: int) -> list[list[float]]:
    """Cut points of every input: its different quantiles at 1/256 to 255/256, without the largest value."""
    shares = [k / (BINS + 1) for k in range(1, BINS + 1)]
    number = [F.when(~F.isnan(f"x{i}"), F.col(f"x{i}")).alias(f"x{i}") for i in range(inputs)]
    each = [c for i in range(inputs) for c in (F.percentile_approx(f"x{i}", shares, 10_000).alias(f"q{i}"), F.max(f"x{i}").alias(f"m{i}"))]
    got = rows.select(*number).agg(*each).first() if inputs else None
    return [sorted({float(q) for q in got[f"q{i}"] or [] if q < got[f"m{i}"]})[:BINS - 1] for i in range(inputs)]


def with_bins(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """The inputs ``x0`` on as bytes, one bin each."""
    held = rows.sparkSession.sparkContext.broadcast(cuts)
    kept = ["y", "models", "seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(held.value))]
            bins = binned(np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0)), held.value)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), *[batch.column(c) for c in kept]], names=["bins", *kept])

    return rows.mapInArrow(run, "bins binary, y double, models array<int>, seed long")


def binned_table(rows: DataFrame, features: list[str], label: str, masks: dict[str, Column]) -> tuple[DataFrame, list[list[float]], list]:
    """The labelled rows of any mask in bins, written once; the cut points; rows and positives of every model.

    ``seed`` is a hash of the whole row, and ``models`` numbers the masks that are true for it.
    """
    numbers = F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(k)) for k, m in enumerate(masks.values())])
    inputs = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    used = rows.select(
        *inputs, F.col(f"`{label}`").cast("double").alias("y"), F.array_compact(numbers).cast("array<int>").alias("models"),
        F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("seed"),
    ).where(F.col("y").isNotNull() & (F.size("models") > 0))
    cuts = quantile_cuts(used, len(features))
    table = materialize(with_bins(used, cuts), "binned")
    sizes = table.select("y", F.explode("models").alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).collect()
    return table, cuts, sizes


def rows_of(table: DataFrame, models: list[int]) -> DataFrame:
    return table.withColumn("models", F.array_intersect("models", F.array(*[F.lit(m) for m in models]))).where(F.size("models") > 0)


def ensembles(rows: DataFrame, features: list[str], label: str, masks: dict[str, Column], s: Settings = Settings(), local_cells: int | None = None) -> dict[str, Ensemble]:
    """One model per mask, fitted on the rows for which it is true.

    Rows without a label take no part; null and NaN inputs are missing values. Cut points are those
    of all rows of any mask. A model without rows, or with one class only, has no trees.
    """
    table, cuts, sizes = binned_table(rows, features, label, masks)
    limit, width = LOCAL_CELLS if local_cells is None else local_cells, len(features)
    small = [r["model"] for r in sizes if r["n"] * max(width, 1) <= limit]
    large = {r["model"]: base_score(r["ones"], r["n"]) for r in sizes if r["model"] not in small}
    found = local_models(rows_of(table, small), len(small), width, s) if small else {}
    found |= aggregated_models(rows_of(table, [*large]), width, large, s) if large else {}
    return {name: Ensemble(cuts, *found.get(k, (0.0, []))) for k, name in enumerate(masks)}


def chances(models: dict, df: DataFrame, features: list[str], wanted: dict[str, Column] | None = None) -> Column:
    """A column of (model, score) for every model that is wanted for the row; all models in one pass."""
    names = list(models)
    held = df.sparkSession.sparkContext.broadcast(models)
    asked = F.array(*[F.coalesce(wanted[m], F.lit(False)) if wanted else F.lit(True) for m in names])

    @F.pandas_udf("array<struct<model:string,score:double>>")
    def run(inputs: pd.DataFrame, ask: pd.Series) -> pd.Series:
        values = inputs.to_numpy(dtype=float)
        ask = np.array(ask.tolist(), bool).reshape(len(values), len(names))
        out: list[list] = [[] for _ in range(len(values))]
        for k, name in enumerate(names):
            rows = np.flatnonzero(ask[:, k])
            if len(rows):
                for i, v in zip(rows.tolist(), held.value[name].probability(values[rows]).tolist()):
                    out[i].append({"model": name, "score": v})
        return pd.Series(out)

    return run(F.struct(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]), asked)
