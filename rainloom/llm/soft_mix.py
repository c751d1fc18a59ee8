"""Mixing documents to target weights of domains that are known only as probabilities.

A multinomial classifier, fitted on a bounded sample of a labelled table, gives every document
a posterior over the domains. Nonnegative rates per document are then found by projected
gradient steps on the squared error of the expected token totals, scaled by the curvature that
the same aggregation gives: each step adds up a few numbers, as many for any number of
documents, and the update of a rate needs only its own row and those sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from rainloom.llm.textblocks import blocks, distinct_per_text, flat, span_hashes, word_bounds
from rainloom.llm.textshape import BINS, MEASURES, binned, measures
from rainloom.session import materialize

#: Labelled rows that the classifier is fitted on, at most: the smallest by hash of the key.
SAMPLE = 6_000
BUCKETS = 1 << 18
WIDTH = BUCKETS + MEASURES * BINS
EPOCHS, RATE, DECAY = 100, 0.03, 1e-4
#: A word column is learned from only with so many texts and so large a chi-square against the domains.
LEAST_TEXTS, LEAST_CHI = 5, 20.0
#: Share of the tokens that each domain should have.
TARGETS = {"clean": 0.90, "poor": 0.05, "toxic": 0.05}
STEPS, TOLERANCE, DAMPING = 60, 1e-6, 1e-4


def sparse_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of each text's first entry, column, value, words): presence of hashed words, and shape bins."""
    data, offsets = flat(texts)
    starts, ends, firsts = word_bounds(data, offsets)
    text, hashes, _ = distinct_per_text(span_hashes(data, starts, ends) >> np.uint64(46), firsts)
    shape = binned(measures(data, offsets))
    row, at = np.nonzero(shape)
    rows = np.concatenate((text, row))
    columns = np.concatenate((hashes.astype(np.int64), BUCKETS + at))
    values = np.concatenate((np.ones(len(text)), shape[row, at]))
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(len(firsts))), columns[order], values[order], np.diff(firsts)


class Classifier:
    """Multinomial logistic regression on sparse rows, fitted by Adam over the whole sample.

    Columns that tell nothing about the domains keep a weight of 0.
    """

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.weights = np.zeros((WIDTH, len(domains)), np.float32)

    def posteriors(self, firsts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        n = len(firsts) - 1
        rows = np.repeat(np.arange(n), np.diff(firsts))
        part = self.weights[columns] * values[:, None]
        z = np.column_stack([np.bincount(rows, part[:, k], n) for k in range(len(self.domains))]) if len(self.domains) else np.zeros((n, 0))
        z = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
        return z / z.sum(axis=1, keepdims=True) if z.size else z

    def fit(self, firsts, columns, values, target: np.ndarray) -> Classifier:
        n = len(firsts) - 1
        if not n:
            return self
        rows = np.repeat(np.arange(n), np.diff(firsts))
        met = np.column_stack([np.bincount(columns, target[rows, k], WIDTH) for k in range(target.shape[1])])
        texts = met.sum(axis=1)
        even = texts[:, None] * target.mean(axis=0)
        telling = ((met - even) ** 2 / np.maximum(even, 1e-9)).sum(axis=1)
        chosen = (texts >= LEAST_TEXTS) & (telling >= LEAST_CHI) | (np.arange(WIDTH) >= BUCKETS)
        here = chosen[columns]
        rows, columns, values = rows[here], columns[here], values[here]
        firsts = np.searchsorted(rows, np.arange(n + 1))
        used, columns = np.unique(columns, return_inverse=True)
        mean, square = np.zeros((len(used), target.shape[1])), np.zeros((len(used), target.shape[1]))
        small = Classifier(self.domains)
        small.weights = np.zeros((len(used), target.shape[1]), np.float32)
        for step in range(1, EPOCHS + 1):
            error = (small.posteriors(firsts, columns, values) - target) / n
            slope = np.column_stack([np.bincount(columns, values * error[rows, k], len(used)) for k in range(target.shape[1])])
            slope += DECAY * small.weights / n
            mean = 0.9 * mean + 0.1 * slope
            square = 0.99 * square + 0.01 * slope**2
            small.weights -= (RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.weights[used] = small.weights
        return self


def fit(labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> Classifier:
    """``labelled``: ``key``, ``domain`` and ``text`` of at most ``sample`` rows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            firsts, columns, values, _ = sparse_terms(part.column("text"))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("domain"), lists(columns.astype(np.int32)), lists(values.astype(np.float32))],
                names=["key", "domain", "columns", "values"],
            )

    got = labelled.where(F.col("domain").isin(domains)).select("key", "domain", "text").mapInArrow(
        rows, "key long, domain string, columns array<int>, values array<float>"
    ).orderBy("key").limit(sample).toArrow().combine_chunks()
    known = got.column("domain").to_pylist()
    target = np.array([[d == k for k in domains] for d in known], float).reshape(len(known), len(domains))
    columns, values = (got.column(c).combine_chunks() for c in ("columns", "values"))
    sizes = pa.compute.list_value_length(columns).to_numpy(zero_copy_only=False) if len(known) else np.zeros(0, np.int64)
    firsts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes).astype(np.int64)))
    return Classifier(domains).fit(firsts, columns.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float), target)


def labelled_domains(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(key, domain, text) of at most ``sample`` labelled documents, chosen by hash.

    A document marked toxic is ``toxic``; else it is ``poor`` or ``clean`` by its quality.
    Several labels of a document count by their largest toxicity and smallest quality; one
    without a quality is no example. Only the chosen keys are broadcast.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(
        "doc_id", F.xxhash64("doc_id").alias("key"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean").alias("domain"),
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("key", "domain", "text")


def posteriors(docs: DataFrame, model: Classifier, keep_text: bool = True) -> DataFrame:
    """Add ``n_tokens`` (words) and ``posterior`` (one probability per domain) to every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("n_tokens", "posterior") and (keep_text or f.name != "text")]
    names = [f.name for f in kept]
    k = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            firsts, columns, values, words = sparse_terms(part.column("text"))
            p = held.value.posteriors(firsts, columns, values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(words.astype(np.int64)), lists], names=[*names, "n_tokens", "posterior"])

    return docs.mapInArrow(run, StructType([*kept, StructField("n_tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))]))


def replayed(p: np.ndarray, slopes: np.ndarray, most: float | None = None) -> np.ndarray:
    """Rates after the given steps, from 1: each moves against its slope, from 0 up to ``most``, if given."""
    rate = np.ones(len(p))
    for move in (p @ slopes.T).T if len(slopes) else ():
        rate = np.clip(rate - move, 0.0, most)
    return rate


def domain_totals(weighed: DataFrame, slopes: np.ndarray, most: float | None = None) -> np.ndarray:
    """Expected tokens per domain under the rates of these steps, then the entries of the curvature.

    Partitions add up their rows; only K + K * K numbers of each reach the driver.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in batches:
            tokens = part.column("n_tokens").to_numpy().astype(float)
            p = part.column("posterior").flatten().to_numpy().reshape(len(tokens), -1)
            rate = replayed(p, slopes, most)
            total_of = (p * (rate * tokens)[:, None]).sum(axis=0)
            own = np.concatenate((total_of, (p.T @ (p * tokens[:, None])).ravel()))
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    got = weighed.select("n_tokens", "posterior").mapInArrow(add, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    return np.array([r["value"] for r in got])


def solve(weighed: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE, most: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of all steps and the totals reached, within ``tolerance`` of all tokens or after ``steps``.

    Least squares on the totals, in the metric of the inverse curvature (the sum of tokens times
    products of posteriors). With rates scaled by the documents' lengths that function's largest
    curvature is 1, so a full gradient step, cut to the allowed rates, always descends. Damping
    keeps the metric finite where a domain has no text to reach its target with.
    """
    k = len(targets)
    slopes, reached, metric = np.zeros((0, k)), np.zeros(k), None
    for step in range(steps + 1):
        both = domain_totals(weighed, slopes, most)
        if not len(both):
            break
        reached, curve = both[:k], both[k:].reshape(k, k)
        if step == steps or np.abs(reached - targets).max() <= tolerance * targets.sum():
            break
        if metric is None:
            metric = np.linalg.inv(curve + DAMPING * max(np.trace(curve) / k, 1e-9) * np.eye(k))
        slopes = np.vstack([slopes, metric @ (reached - targets)])
    return slopes, reached


RESULTS = ("n_tokens", "posterior", "rate", "copies", "targets", "reached")


def mixed_rates(
    docs: DataFrame, model: Classifier, weights: dict[str, float] = TARGETS, keep_text: bool = True, most: float | None = None
) -> DataFrame:
    """Every row with ``n_tokens``, ``posterior``, ``rate`` (0 or more) and ``copies``.

    The targets are ``weights`` of all tokens there are; ``targets`` and ``reached`` hold, in every
    row, the wanted and the reached totals by domain. ``most`` limits the rates, so that totals
    may stay below their targets. Columns of ``docs`` with the name of a result are replaced. ``copies`` is the rate, rounded up or
    down by a hash of the doc_id, so that it equals the rate on average; a null doc_id counts
    as one value. A text without words takes part with no tokens and the rate of its posterior.
    Equal texts get equal rates. An empty table gives an empty result.
    """
    weighed = materialize(posteriors(docs, model, keep_text), "posteriors")
    total = weighed.agg(F.sum("n_tokens")).first()[0] or 0
    share = np.array([weights[d] for d in model.domains], float)
    targets = share / share.sum() * total
    slopes, reached = solve(weighed, targets, most=most)
    kept = [f for f in weighed.schema.fields if f.name.lower() not in RESULTS[2:]]
    names = [f.name for f in kept]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            p = part.column("posterior").flatten().to_numpy().reshape(part.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(replayed(p, slopes, most))], names=[*names, "rate"])

    even = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    return weighed.select(*names).mapInArrow(rate, StructType([*kept, StructField("rate", DoubleType())])).withColumns({
        "copies": F.floor(F.col("rate") + even),
        "targets": F.array(*[F.lit(float(x)) for x in targets]), "reached": F.array(*[F.lit(float(x)) for x in reached]),
    })


def mixed(docs: DataFrame, model: Classifier, weights: dict[str, float] = TARGETS, most: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its ``copies`` say (not at all for 0).

    All columns come back as they were, whatever their names.
    """
    carried = [c if c in ("doc_id", "text") else f"kept_{i}" for i, c in enumerate(docs.columns)]
    inner = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(carried, docs.columns)])
    rates = mixed_rates(inner, model, weights, most=most).where("copies > 0")
    return rates.select(*carried, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(
        *[F.col(k).alias(c) for k, c in zip(carried, docs.columns)]
    )
