"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed byte trigrams and soft bins of the text's shape. A bounded sample of labelled
documents gives term weights and the latent space (leading eigenvectors of the weighted term
products). Its vectors and labels are broadcast; every document is compared with all of them in
blocks, and the labels of the nearest vote with their similarity as weight. The votes of the
two labels are weighed against their frequencies, so a rare label isn't outvoted by its rarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rainloom.llm.textblocks import blocks, flat, unused
from rainloom.llm.textshape import BINS, MEASURES, binned, measures, trigram_counts

#: Labelled rows that the model is fitted on, at most: the smallest by hash of the key.
SAMPLE = 6_000
BUCKETS = 1024
DIMENSIONS = 48
NEIGHBOURS = 25
#: Weight of a shape bin beside a trigram, and power of the similarity in a vote.
SHAPE_WEIGHT, POWER = 3.0, 4
THRESHOLD = 0.3
#: Documents compared at once.
ROWS = 256


def term_rows(texts: pa.Array) -> np.ndarray:
    """Dampened term counts, one row per text; trigrams have length 1 together."""
    data, offsets = flat(texts)
    grams = np.log1p(trigram_counts(data, offsets, BUCKETS))
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    return np.hstack([grams, binned(measures(data, offsets))]).astype(np.float32)


class Model:
    """Term weights, latent directions, and the labelled vectors with their labels."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray):
        seen = (terms > 0).mean(axis=0) if len(terms) else np.zeros(terms.shape[1])
        self.weights = np.log(1.5 / (seen + 0.5 / max(1, len(terms)))).clip(0.05).astype(np.float32)
        self.weights[BUCKETS:] *= SHAPE_WEIGHT
        weighted = terms * self.weights
        _, directions = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        self.directions = np.ascontiguousarray(directions[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
        self.labels = labels.astype(np.float64)
        positive = self.labels.sum()
        self.against = float(np.clip(positive / max(len(labels) - positive, 1e-9), 1 / 20, 20)) if len(labels) else 1.0
        self.vectors = self.project(terms)

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = (terms * self.weights) @ self.directions
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Exact cosines with every labelled vector, block by block; votes of the nearest."""
        out = np.full(len(terms), 0.5)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for low in range(0, len(terms), ROWS):
            cosines = self.project(terms[low : low + ROWS]) @ self.vectors.T
            near = np.argpartition(cosines, -k, axis=1)[:, -k:] if k < len(self.labels) else np.tile(np.arange(k), (len(cosines), 1))
            weight = np.clip(np.take_along_axis(cosines, near, 1), 1e-6, None).astype(np.float64) ** POWER
            yes = (weight * self.labels[near]).sum(axis=1)
            no = (weight * (1 - self.labels[near])).sum(axis=1) * self.against
            out[low : low + ROWS] = yes / (yes + no)
        return np.clip(out, 0.0, 1.0)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """``labelled``: ``text`` and ``label`` (0 to 1) of at most ``sample`` rows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            terms = term_rows(part.column("text"))
            yield pa.RecordBatch.from_pydict({
                "key": part.column("key"), "label": part.column("label"),
                "terms": pa.array([row.tobytes() for row in terms], pa.binary()),
            })

    got = labelled.select("key", F.col("label").cast("double").alias("label"), "text").mapInArrow(
        rows, "key long, label double, terms binary"
    ).orderBy("key").limit(sample).toArrow()
    width = BUCKETS + MEASURES * BINS
    terms = np.frombuffer(b"".join(got.column("terms").to_pylist()), np.float32).reshape(-1, width)
    return Model(terms, got.column("label").to_numpy())


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, usable, sample: int = SAMPLE) -> DataFrame:
    """Text and mean label of at most ``sample`` keys that satisfy ``usable``, chosen by hash.

    Several labels of one key count as their mean; null labels don't count. Only the chosen
    keys, at most ``sample``, are broadcast to the scan of the documents.
    """
    known = labels.where(F.col(value).isNotNull() & usable).groupBy("doc_id").agg(F.avg(value).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("key", F.xxhash64("doc_id"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("key", "label", "text")


def quality_scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Null and empty texts are scored like any other; without labelled rows every score is 0.5.
    Equal texts, repeated rows too, get equal scores up to float rounding; an empty table gives
    an empty one. Columns of ``docs`` with the name of a result are replaced, any other name may
    be kept. The broadcast is bounded by the sample.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.select(f"`{c}`").schema[0] for c in keep if c.lower() not in ("score", "predicted")]
    names = [f.name for f in fields]
    (source,) = unused(names, "_text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, source):
            scores = held.value.scores(term_rows(part.column(source)))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in names], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=[*names, "score", "predicted"],
            )

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
    schema = StructType([*fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias(source)).mapInArrow(score, schema)
