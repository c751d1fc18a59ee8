"""Random forests on histograms whose classes are balanced within every bag.

A row's weight in a tree's bag is a Poisson number drawn by hash of the row and the tree, so bags
need no pass of their own and come out the same wherever the row lies. The two classes of each bag
are weighted to equal totals. Each node looks at a few inputs drawn by hash of tree and node, and
at further ones as long as none of them splits it. The gain of a split is that of ``boosting`` without
its penalty, with weighted positives as gradient and weights as curvature: the decrease of the Gini
impurity. As there, models that fit into a task grow in one job, and larger ones by aggregations, level
by level for all trees of all models.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rainloom.operators import boosting
from rainloom.operators.boosting import UNIT, Node, Split, Tree, binned, binned_table, goes_left, histogram, node_of, paths_of, rows_of, shared_gains

#: Nodes whose histograms one job adds up, at most.
NODES = 4096
_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 300
    depth: int = 12
    least_rows: int = 20
    #: ``bag``: classes weigh the same in every bag; ``all``: over all rows; else no weights
    balance: str = "bag"
    l2: float = 0.0
    least_curve: float = 1e-9

    def leaf(self, gradient: int, curve: int) -> float:
        return gradient / curve if curve else 0.0


@dataclass
class Forest:
    cuts: list[list[float]]
    trees: list[Tree]

    def probability(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.cuts)
        return sum((t.scores(bins) for t in self.trees), np.zeros(len(bins))) / max(len(self.trees), 1)

    def gains(self) -> np.ndarray:
        return shared_gains(self.trees, len(self.cuts))

    def dumps(self) -> str:
        return json.dumps({"cuts": self.cuts, "trees": [t.__dict__ for t in self.trees]})

    @classmethod
    def loads(cls, text: str) -> Forest:
        facts = json.loads(text)
        return cls(facts["cuts"], [Tree(**t) for t in facts["trees"]])


def bag_counts(seeds: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in the bag of a tree: Poisson with mean 1, by hash."""
    x = seeds.astype(np.uint64) ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    even = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, even, "right")


def class_weights(zeros: int, ones: int) -> tuple[float, float]:
    """Weights with which both classes total half of all; 0 for a class without rows."""
    total = zeros + ones
    return total / (2 * zeros) if zeros else 0.0, total / (2 * ones) if ones else 0.0


def weighted(counts: np.ndarray, label: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted positives and weights of the rows of a bag, in units."""
    weight = np.rint(counts * np.where(label > 0, weights[1], weights[0]) * UNIT)
    return np.where(label > 0, weight, 0.0), weight


def drawn(tree: int, path: int, inputs: int) -> np.ndarray:
    """All inputs in the order in which a node looks at them."""
    return np.random.default_rng([tree, path]).permutation(inputs)


def groups(inputs: int) -> list[slice]:
    """The square root of the inputs first, then one by one."""
    first = max(1, int(np.sqrt(inputs)))
    return [slice(0, first), *[slice(k, k + 1) for k in range(first, inputs)]] if inputs else []


def settled(node: Node, chosen: np.ndarray) -> Node:
    """The node with its split in terms of all inputs."""
    if node.split:
        node.split = Split(node.split.gain, int(chosen[node.split.feature]), node.split.bin, node.split.missing_left)
    return node


def pure(node: Node) -> bool:
    return node.gradient == 0 or node.gradient == node.curve


# --- models that fit into a task ----------------------------------------------------------

def grow(bins: np.ndarray, gradient: np.ndarray, curve: np.ndarray, tree: int, s: ForestSettings) -> Tree:
    """``bins`` and sums of the rows of one bag."""
    nodes: dict[int, Node] = {}
    parted, open_nodes = set(), [(1, np.arange(len(bins)))]
    while open_nodes:
        path, rows = open_nodes.pop()
        node = Node(int(gradient[rows].sum()), int(curve[rows].sum()), len(rows), None)
        if path.bit_length() <= s.depth and len(rows) >= 2 * s.least_rows and not pure(node):
            order = drawn(tree, path, bins.shape[1])
            for part in groups(bins.shape[1]):
                found = settled(node_of(histogram(bins[np.ix_(rows, order[part])], gradient[rows], curve[rows]), s), order[part])
                if found.split:
                    node = found
                    break
        nodes[path] = node
        if node.split:
            parted.add(path)
            side = goes_left(bins[rows], node.split)
            open_nodes += [(2 * path, rows[side]), (2 * path + 1, rows[~side])]
    return Tree.of(nodes, parted, s)


def forest_trees(bins: np.ndarray, label: np.ndarray, seeds: np.ndarray, s: ForestSettings) -> list[Tree]:
    every = class_weights(int((label == 0).sum()), int((label > 0).sum()))
    trees = []
    for t in range(s.trees):
        counts = bag_counts(seeds, t)
        mine = np.flatnonzero(counts)
        own = class_weights(int(counts[label == 0].sum()), int(counts[label > 0].sum()))
        weights = {"bag": own, "all": every}.get(s.balance, (1.0, 1.0))
        trees.append(grow(bins[mine], *weighted(counts[mine], label[mine], weights), t, s))
    return trees


def local_models(rows: DataFrame, models: int, width: int, s: ForestSettings) -> dict[int, list[Tree]]:
    def train(table: pa.Table) -> pa.Table:
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, width)
        trees = forest_trees(bins, table.column("y").to_numpy(), table.column("seed").to_numpy(), s)
        return pa.table({"model": table.column("model")[:1], "trees": [Forest([], trees).dumps()]})

    each = rows.select("bins", "y", "seed", F.explode("models").alias("model")).repartitionByRange(models, "model").groupBy("model").applyInArrow(train, "model int, trees string")
    return {r["model"]: Forest.loads(r["trees"]).trees for r in each.collect()}


# --- models that grow through aggregations -------------------------------------------------

def bag_totals(rows: DataFrame, s: ForestSettings) -> dict[tuple[int, int], tuple[int, int]]:
    """(zeros, ones) in the bag of every (model, tree)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            seeds, label, models = batch.column("seed").to_numpy(), batch.column("y").to_numpy(), batch.column("model").to_numpy()
            for m in np.unique(models):
                mine = models == m
                for t in range(s.trees):
                    counts = bag_counts(seeds[mine], t)
                    ones = int(counts[label[mine] > 0].sum())
                    total.setdefault(int(m), np.zeros((s.trees, 2), np.int64))[t] += (int(counts.sum()) - ones, ones)
        for m, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.trees, m, np.int32)), pa.array(np.arange(s.trees, dtype=np.int32)), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["model", "tree", "zeros", "ones"])

    each = rows.select("seed", "y", F.explode("models").alias("model")).mapInArrow(count, "model int, tree int, zeros long, ones long")
    got = each.groupBy("model", "tree").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect()
    return {(r["model"], r["tree"]): (r["zeros"], r["ones"]) for r in got}


def next_nodes(rows: DataFrame, width: int, weights: dict, nodes: dict, wanted: list[tuple[int, int, int, int]], s: ForestSettings) -> list:
    """Sums and splits of nodes (model, tree, path, group of inputs) in one job."""
    by_tree: dict[tuple[int, int], dict[int, int]] = {}
    for m, t, path, group in wanted:
        by_tree.setdefault((m, t), {})[path] = group
    held = rows.sparkSession.sparkContext.broadcast((weights, {k: nodes[k] for k in by_tree}, by_tree))

    def chosen(tree: int, path: int, group: int) -> np.ndarray:
        return drawn(tree, path, width)[groups(width)[group]]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, nodes, by_tree = held.value
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)
            label, seeds, models = batch.column("y").to_numpy(), batch.column("seed").to_numpy(), batch.column("models")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(models.offsets.to_numpy()))
            member = models.flatten().to_numpy()
            for (m, t), paths in by_tree.items():
                mine = owner[member == m]
                counts = bag_counts(seeds[mine], t)
                mine, counts = mine[counts > 0], counts[counts > 0]
                gradient, curve = weighted(counts, label[mine], weights[m, t])
                at = paths_of(bins[mine], nodes[m, t], set(paths))
                for path in np.unique(at[at > 0]).tolist():
                    here = at == path
                    hist = histogram(bins[np.ix_(mine[here], chosen(t, path, paths[path]))], gradient[here], curve[here])
                    key = (m, t, path)
                    total[key] = total[key] + hist if key in total else hist
        keys = list(total)
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["model", "tree", "path", "hist"])

    def best(table: pa.Table) -> pa.Table:
        m, t, path = (table.column(c)[0].as_py() for c in ("model", "tree", "path"))
        inputs = chosen(t, path, held.value[2][m, t][path])
        hist = sum(np.frombuffer(h, np.int64) for h in table.column("hist").to_pylist()).reshape(3, len(inputs), 256)
        node = settled(node_of(hist, s), inputs)
        split = node.split or Split(float("nan"), -1, 0, False)
        return pa.table({
            "model": [m], "tree": [t], "path": [path], "gradient": [node.gradient], "curve": [node.curve], "rows": [node.rows],
            "gain": [split.gain], "feature": [split.feature], "bin": [split.bin], "missing_left": [split.missing_left],
        })

    return rows.select("bins", "y", "seed", "models").mapInArrow(sums, "model long, tree long, path long, hist binary").groupBy("model", "tree", "path").applyInArrow(
        best, "model long, tree long, path long, gradient long, curve long, rows long, gain double, feature long, bin long, missing_left boolean"
    ).collect()


def aggregated_models(rows: DataFrame, width: int, sizes: dict[int, tuple[int, int]], s: ForestSettings) -> dict[int, list[Tree]]:
    """The same models as ``local_models``. ``sizes``: zeros and ones of every model."""
    bags = bag_totals(rows, s)
    of = lambda m, t: {"bag": class_weights(*bags[m, t]), "all": class_weights(*sizes[m])}.get(s.balance, (1.0, 1.0))
    weights = {k: of(*k) for k in bags}
    nodes: dict[tuple[int, int], dict[int, Node]] = {k: {} for k in bags}
    wanted, later = [(m, t, 1, 0) for m, t in sorted(bags)], []
    while wanted:
        tried = {(m, t, path): group for m, t, path, group in wanted[:NODES]}
        for r in next_nodes(rows, width, weights, nodes, wanted[:NODES], s):
            m, t, path = r["model"], r["tree"], r["path"]
            split = Split(r["gain"], r["feature"], r["bin"], r["missing_left"]) if r["feature"] >= 0 else None
            node = Node(r["gradient"], r["curve"], r["rows"], split)
            group = tried[m, t, path]
            grows = path.bit_length() <= s.depth and node.rows >= 2 * s.least_rows and not pure(node)
            if not grows:
                node.split = None
            elif split is None and group + 1 < len(groups(width)):
                later.append((m, t, path, group + 1))
            nodes[m, t][path] = node
            if node.split:
                later += [(m, t, 2 * path, 0), (m, t, 2 * path + 1, 0)]
        wanted = wanted[NODES:]
        if not wanted:
            wanted, later = sorted(later), []
    found: dict[int, list[Tree]] = {m: [] for m in sizes}
    for m, t in sorted(nodes):
        known = nodes[m, t]
        found[m].append(Tree.of(known, {p for p, n in known.items() if n.split}, s))
    return found


def forests(rows: DataFrame, features: list[str], label: str, masks: dict[str, Column], s: ForestSettings = ForestSettings(), local_cells: int | None = None) -> dict[str, Forest]:
    """One forest per mask, fitted on the labelled rows for which it is true; inputs may be missing."""
    table, cuts, sizes = binned_table(rows, features, label, masks)
    limit, width = boosting.LOCAL_CELLS if local_cells is None else local_cells, len(features)
    small = [r["model"] for r in sizes if r["n"] * max(width, 1) <= limit]
    large = {r["model"]: (int(r["n"] - r["ones"]), int(r["ones"])) for r in sizes if r["model"] not in small}
    found = local_models(rows_of(table, small), len(small), width, s) if small else {}
    found |= aggregated_models(rows_of(table, [*large]), width, large, s) if large else {}
    return {name: Forest(cuts, found.get(k, [])) for k, name in enumerate(masks)}
