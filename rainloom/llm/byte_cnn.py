"""Language identification by a convolutional network over bytes.

Texts are cut into windows of fixed length. Each byte has a small vector; filters of several
widths slide over a window, the largest response of each filter goes to a softmax layer. The
network is trained in numpy on a bounded sample of labelled text. For prediction the filters
become one table of responses per byte and tap, so a window costs look-ups and additions.
The language of a text is that of its windows' mean probabilities, weighted by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rainloom.llm.textblocks import FOLD, blocks, flat, owners, sums, unused

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
#: Labelled documents that are learned from, at most, and windows of each, evenly spaced.
SAMPLE, PER_TEXT = 4_000, 3
STEPS, BATCH, RATE = 480, 128, 0.006
#: Share of the training windows that are shortened, so that short texts are learned too.
SHORTENED = 0.35
BLANK = 32
UNKNOWN = "und"


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 as small letters."""
    data = FOLD[data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data[1:][capital] += 0x20
    return data


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, filled up with blanks, and the index of each text's first. An empty text has one."""
    count = np.maximum(1, -(-np.diff(offsets) // WINDOW))
    firsts = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
    out = np.full(int(firsts[-1]) * WINDOW, BLANK, np.uint8)
    text = owners(offsets)
    out[np.arange(len(data)) - offsets[text] + firsts[text] * WINDOW] = lowered(data)
    return out.reshape(-1, WINDOW), firsts


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {
            "bytes": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), "bias": np.zeros(len(languages)),
        } | {f"filter{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS} | {f"shift{w}": np.zeros(FILTERS) for w in WIDTHS}
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        self.tables = None

    def responses(self, rows: np.ndarray, width: int) -> np.ndarray:
        """(window, place, filter) before the shift, from the tables of taps."""
        reach = WINDOW - width + 1
        total = self.tables[width][0][rows[:, :reach]]
        for tap in range(1, width):
            total += self.tables[width][tap][rows[:, tap : tap + reach]]
        return total

    def tabulate(self) -> None:
        w = self.weights
        self.tables = {n: [w["bytes"] @ w[f"filter{n}"][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(n)] for n in WIDTHS}

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.weights["out"] + self.weights["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of every window, some hundred windows at a time."""
        out = [np.zeros((0, len(self.languages)), np.float32)]
        for low in range(0, len(rows), 256):
            some = rows[low : low + 256]
            out.append(self.softmax(np.hstack([np.maximum(self.responses(some, w).max(axis=1) + self.weights[f"shift{w}"], 0) for w in WIDTHS])))
        return np.concatenate(out)

    def gradients(self, rows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Only the place of each filter's largest response passes a gradient on."""
        self.tabulate()
        w, places, pooled = self.weights, [], []
        for width in WIDTHS:
            response = self.responses(rows, width)
            places.append(response.argmax(axis=1))
            pooled.append(np.maximum(np.take_along_axis(response, places[-1][:, None], 1)[:, 0] + w[f"shift{width}"], 0))
        hidden = np.hstack(pooled)
        error = (self.softmax(hidden) - target) / len(rows)
        out = {"out": hidden.T @ error, "bias": error.sum(axis=0), "bytes": np.zeros_like(w["bytes"])}
        back = np.where(hidden > 0, error @ w["out"].T, 0)
        for k, width in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            seen = rows[np.arange(len(rows))[:, None, None], places[k][:, :, None] + np.arange(width)]
            vectors = w["bytes"][seen].reshape(len(rows), FILTERS, -1)
            out[f"filter{width}"] = np.einsum("bf,bfd->df", g, vectors)
            out[f"shift{width}"] = g.sum(axis=0)
            share = (g[:, :, None] * w[f"filter{width}"].T[None]).reshape(-1, EMBEDDING)
            for d in range(EMBEDDING):
                out["bytes"][:, d] += np.bincount(seen.ravel(), share[:, d], 256)
        return out

    def train(self, rows: np.ndarray, label: np.ndarray, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        target = np.eye(len(self.languages), dtype=np.float32)[label]
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-STEPS * BATCH // len(rows)))])
        for step in range(1, STEPS + 1):
            some = order[(step - 1) * BATCH : step * BATCH]
            batch = rows[some].copy()
            cut = np.where(rng.random(len(some)) < SHORTENED, rng.integers(12, 120, len(some)), WINDOW)
            batch[np.arange(WINDOW)[None] >= cut[:, None]] = BLANK
            rate = RATE * (1 - 0.95 * step / STEPS)
            for k, g in self.gradients(batch, target[some]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.weights[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.tabulate()
        return self


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Network | None:
    """``labelled``: ``key``, ``lang`` and ``text``; the ``sample`` rows of the smallest hash of the key are learned from.

    Rows without a language or text are none. Without any, there is no network.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            rows, firsts = windows(*flat(part.column("text")))
            count = np.diff(firsts)
            take = np.minimum(count, PER_TEXT)
            text = np.repeat(np.arange(len(count)), take)
            place = np.arange(len(text)) - np.repeat(np.cumsum(take) - take, take)
            chosen = rows[firsts[text] + place * count[text] // take[text]]
            yield pa.RecordBatch.from_arrays(
                [part.column("hash").take(pa.array(text)), part.column("lang").take(pa.array(text)), pa.array(place), pa.array([r.tobytes() for r in chosen], pa.binary())],
                names=["hash", "lang", "place", "window"],
            )

    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND key IS NOT NULL").select(F.xxhash64("key").alias("hash"), "lang", "text", "key")
    chosen = known.select("hash", "key").orderBy("hash", "key").limit(sample)
    edge = chosen.agg(F.max("hash")).first()[0]
    if edge is None:
        return None
    got = known.where(F.col("hash") <= F.lit(edge)).select("hash", "lang", "text").mapInArrow(
        cut, "hash long, lang string, place long, window binary"
    ).orderBy("hash", "place", "window").limit(sample * PER_TEXT).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    rows = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    label = np.array([languages.index(x) for x in got.column("lang").to_pylist()])
    return Network(languages).train(rows, label)


def predicted(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score``, the probability of it.

    A null text or one without a letter is ``und`` with score 0, and so is any text if nothing
    was learned. Whole texts are read, however long. Repeated rows are predicted alike, an empty
    table gives an empty one. Columns named like a result are replaced, all others are kept.
    """
    names = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score")]
    fields = [docs.select(f"`{c}`").schema[0] for c in names]
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    keep = [F.col(f"`{c}`") for c in names]
    if network is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(network)

    (marked,) = unused(names, "_lettered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in blocks(batches):
            rows, firsts = windows(*flat(part.column("text")))
            letters = ((rows >= 97) & (rows <= 122) | (rows >= 128)).sum(axis=1) + 1e-6
            p = model.predict(rows) * letters[:, None]
            total = np.column_stack([sums(p[:, k].astype(np.float64), firsts) for k in range(p.shape[1])]) / sums(letters, firsts)[:, None]
            best = total.argmax(axis=1)
            lettered = part.column(marked).to_numpy(zero_copy_only=False)
            language = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())]
            score = np.where(lettered, np.clip(total[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(language, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(marked)
    return docs.select(*keep, "text", lettered).mapInArrow(run, schema)
