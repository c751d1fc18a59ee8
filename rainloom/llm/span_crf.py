"""Personal data by a semi-Markov conditional random field.

Words with digits or at signs are cut into tokens. Every run of up to ``LONGEST`` tokens is a
candidate segment, scored as a whole: how many digits it has and in which groups, which marks,
how it starts and ends, what stands around it, whether its digits pass the Luhn test. A dynamic
programme over the tokens then picks the boundaries and kinds of all segments at once; training
sums over all ways to cut with the same recursion. A token outside any segment scores 0.

The base rules of ``personal_patterns`` label the training examples, cut at whole tokens, and their
spans always stay; the model adds what they miss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from rainloom.llm.personal_patterns import KINDS, TOKEN, Span, base_spans, islands, joined, listed, luhn, secrets
from rainloom.llm.textblocks import blocks
from rainloom.session import materialize

LONGEST = 16
#: Different examples that the model is fitted on, at most: for every kind, and for none, a like
#: share of the ones with the smallest hash.
SAMPLE = 1_800
#: Code points of an example; a longer one is no example (it is still searched).
EXAMPLE = 400
EPOCHS, RATE, DECAY = 60, 0.25, 0.05
#: A segment must beat the ways without it by so much.
MARGIN = 1.0
#: Code points of islands that are cut together, at least, and tokens whose segments are scored at once.
STEP, TOKENS = 1 << 15, 1 << 12

_BOUNDS = {
    "digits": [1, 2, 4, 6, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20], "letters": [1, 2, 4, 8, 16, 24], "tokens": [2, 3, 4, 5, 6, 7, 8, 9, 12],
    "length": [4, 8, 12, 16, 24, 32, 40, 64], "@": [1, 2], ".": [1, 2, 3, 4], "-": [1, 2, 3, 4], "+": [1, 2], "()": [1, 2, 3], "other": [1, 2, 3],
    "gaps": [1, 2, 3, 4], "groups": [1, 2, 3, 4, 5],
}
_EDGES = {"first": 8, "last": 8, "before": 8, "after": 8, "word": 64, "address": 3, "luhn": 3, "mixed": 3, "first|digits": 8 * 15, "before|first": 64, "last|after": 64}
_SIZES = [len(b) + 1 for b in _BOUNDS.values()] + list(_EDGES.values())
_STARTS = np.concatenate(([0], np.cumsum(_SIZES)))
WIDTH = int(_STARTS[-1])


def kind_of(c: str) -> int:
    """Class of the character at an edge of a segment."""
    if not c or c.isspace():
        return 0
    if "0" <= c <= "9":
        return 1
    if c.isalpha():
        return 2
    return {"@": 3, ".": 4, "+": 5, "(": 5, "-": 6}.get(c, 7)


def joins(left: str, right: str) -> bool:
    """Whether a segment may go on over the space between these characters."""
    return left in "0123456789)-" and right in "0123456789(-"


class Lattice:
    """Tokens of several islands, and all their candidate segments with the columns of their features."""

    def __init__(self, pieces: list[tuple[str, str]]):
        """``pieces``: each island with the word before it."""
        marks = "@.-+"
        rows, self.spans, self.firsts = [], [], [0]
        for text, word in pieces:
            hint = int(hashlib.md5(word.lower().encode("utf-8", "replace")).hexdigest()[:8], 16) % 64 if word else 0
            for m in TOKEN.finditer(text):
                token, start, end = m.group(), m.start(), m.end()
                digits = sum("0" <= c <= "9" for c in token)
                letters = sum(c.isalpha() for c in token)
                gap = start > 0 and text[start - 1].isspace()
                closed = gap and not joins(text[start - 2] if start > 1 else " ", token[0])
                group = token.isdigit() and token.isascii()
                value = int(token) if group and len(token) <= 3 else 999
                rows.append((
                    digits, letters, end - start, *[token == c for c in marks], token in "()", letters + digits == 0 and token not in "@.-+()", gap, closed, group,
                    group and value <= 255, digits > 0 and letters > 0, kind_of(token[0]), kind_of(token[-1]), kind_of(text[start - 1 : start]), kind_of(text[end : end + 1]), hint,
                ))
                self.spans.append((start, end))
            self.firsts.append(len(rows))
        self.tokens = np.array(rows, np.int64).reshape(len(rows), 19)
        self.digits = ["".join(x for x in m.group() if "0" <= x <= "9") for text, _ in pieces for m in TOKEN.finditer(text)]
        self.island = np.repeat(np.arange(len(pieces)), np.diff(self.firsts))
        self.total = np.vstack([np.zeros((1, 14), np.int64), np.cumsum(self.tokens[:, :14], axis=0)])

    def segments(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, end token, feature columns) of the candidates that start at tokens ``low`` to ``high``."""
        t, n, island, total = self.tokens, len(self.tokens), self.island, self.total
        starts, sizes = [], []
        for size in range(1, LONGEST + 1):
            at = np.arange(low, max(low, min(high, n - size + 1)))
            inside = island[at] == island[at + size - 1]
            inside &= total[at + size, 10] - total[at + 1, 10] == 0
            starts.append(at[inside])
            sizes.append(np.full(int(inside.sum()), size))
        i, size = np.concatenate(starts), np.concatenate(sizes)
        j = i + size
        s = total[j] - total[i]
        gaps = s[:, 9] - t[i, 9] if len(i) else s[:, 9]
        # a segment holds a digit or an at sign, and neither starts nor ends with a bare mark but + and (
        keep = ((s[:, 0] > 0) | (s[:, 3] > 0)) & np.isin(t[i, 14], [1, 2, 5]) & np.isin(t[j - 1, 15], [1, 2]) if len(i) else np.zeros(0, bool)
        i, j, s, size, gaps = i[keep], j[keep], s[keep], size[keep], gaps[keep]
        valid = np.zeros(len(i), np.int64)
        maybe = np.flatnonzero((s[:, 0] >= 12) & (s[:, 0] <= 19) & (s[:, 1] == 0))
        valid[maybe] = [1 + luhn("".join(self.digits[a:b])) for a, b in zip(i[maybe].tolist(), j[maybe].tolist())]
        address = (s[:, 11] == 4) & (s[:, 4] == 3) & (size == 7)
        counted = [s[:, 0], s[:, 1], size, s[:, 2], s[:, 3], s[:, 4], s[:, 5], s[:, 6], s[:, 7], s[:, 8], gaps, s[:, 11]]
        columns = [np.searchsorted(b, x, "right") for b, x in zip(_BOUNDS.values(), counted)]
        first, last, before, after = t[i, 14], t[j - 1, 15], t[i, 16], t[j - 1, 17]
        mixed = np.where(s[:, 13] == 0, 0, np.where(size == 1, 2, 1))
        columns += [first, last, before, after, t[i, 18], address.astype(np.int64) + (address & (s[:, 12] == 4)), valid, mixed]
        columns += [first * 15 + columns[0], before * 8 + first, last * 8 + after]
        return i, j, np.column_stack(columns) + _STARTS[:-1] if len(i) else np.zeros((0, len(_SIZES)), np.int64)


def best_cut(lattice: Lattice, weights: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """(first token, end token, kind) of the segments of the best cut of every island."""
    n, kept = len(lattice.tokens), []
    for low in range(0, n, TOKENS):
        i, j, columns = lattice.segments(low, low + TOKENS)
        scores = weights[columns].sum(axis=1) - margin if len(i) else np.zeros((0, weights.shape[1]))
        good = (scores > 0).any(axis=1)  # a segment worth less than its tokens outside is in no best cut
        kept.append((i[good], j[good], scores[good].argmax(axis=1), scores[good].max(axis=1, initial=0)))
    start, end, kind, score = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 4
    best, back = np.zeros(n + 1), np.full(n + 1, -1)
    order = np.argsort(end, kind="stable")
    at = np.searchsorted(end[order], np.arange(n + 2))
    for e in range(1, n + 1):
        best[e] = best[e - 1]
        here = order[at[e] : at[e + 1]]
        if len(here):
            total = best[start[here]] + score[here]
            k = int(total.argmax())
            if total[k] > best[e]:
                best[e], back[e] = total[k], here[k]
    found, e = [], n
    while e > 0:
        if back[e] >= 0:
            s = back[e]
            found.append((int(start[s]), int(end[s]), int(kind[s])))
            e = int(start[s])
        else:
            e -= 1
    return found[::-1]


def posteriors(n: int, start: np.ndarray, end: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of every segment and kind over ``n`` tokens, and the log of the sum over all cuts."""
    weight = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    order, begins = np.argsort(end, kind="stable"), np.argsort(start, kind="stable")
    at, first = np.searchsorted(end[order], np.arange(n + 2)), np.searchsorted(start[begins], np.arange(n + 1))
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    for e in range(1, n + 1):
        here = order[at[e] : at[e + 1]]
        ahead[e] = np.logaddexp.reduce(np.concatenate(([ahead[e - 1]], ahead[start[here]] + weight[here]))) if len(here) else ahead[e - 1]
    for b in range(n - 1, -1, -1):
        here = begins[first[b] : first[b + 1]]
        behind[b] = np.logaddexp.reduce(np.concatenate(([behind[b + 1]], behind[end[here]] + weight[here]))) if len(here) else behind[b + 1]
    inside = ahead[start] + behind[end] - ahead[n]
    return np.exp(scores + inside[:, None]), float(ahead[n])


class SpanModel:
    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((WIDTH, len(KINDS))) if weights is None else weights

    def fit(self, examples: list[tuple[str, str, list[Span]]], epochs: int = EPOCHS) -> SpanModel:
        """``examples``: island, word before it, labelled spans. Adam on the log likelihood of whole cuts."""
        lattice = Lattice([(text, word) for text, word, _ in examples])
        start, end, columns = lattice.segments(0, len(lattice.tokens))
        if not len(start):
            return self
        want = np.zeros((len(start), len(KINDS)))
        where = {}
        for b, (_, _, spans) in enumerate(examples):
            where.update({(b, start, end): KINDS.index(kind) for kind, start, end in spans})
        edges = np.array(lattice.spans)
        for s, (b, i, j) in enumerate(zip(lattice.island[start], edges[start, 0], edges[end - 1, 1])):
            k = where.get((int(b), int(i), int(j)))
            if k is not None:
                want[s, k] = 1
        count = columns.shape[1]
        used, columns = np.unique(columns, return_inverse=True)
        columns = columns.reshape(len(start), count)
        weights, mean, square = (np.zeros((len(used), len(KINDS))) for _ in range(3))
        for step in range(1, epochs + 1):
            chance, _ = posteriors(len(lattice.tokens), start, end, weights[columns].sum(axis=1))
            error = chance - want
            slope = np.column_stack([np.bincount(columns.ravel(), np.repeat(error[:, k], count), len(used)) for k in range(len(KINDS))])
            slope += DECAY * weights
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.weights = np.zeros((WIDTH, len(KINDS)))
        # a column that no example had says nothing for a kind, and so speaks against it
        self.weights[:] = min(0.0, float(weights.min())) / 4
        self.weights[used] = weights
        return self

    def spans(self, text: str) -> list[Span]:
        """Segments of the best cut of a whole text."""
        found, batch, size = [], [], 0
        for start, end in islands(text):
            batch.append((start, end))
            size += end - start
            if size >= STEP:
                found += self._cut(text, batch)
                batch, size = [], 0
        return found + self._cut(text, batch)

    def _cut(self, text: str, where: list[tuple[int, int]]) -> list[Span]:
        if not where:
            return []
        lattice = Lattice([(text[a:b], word_before(text, a)) for a, b in where])
        offset = np.repeat([a for a, _ in where], np.diff(lattice.firsts))
        place = lambda i, j: (int(offset[i]) + lattice.spans[i][0], int(offset[i]) + lattice.spans[j - 1][1])
        return [(KINDS[k], *place(i, j)) for i, j, k in best_cut(lattice, self.weights)]


def word_before(text: str, start: int) -> str:
    """The last word of letters in the 40 code points before."""
    words = [m.group() for m in TOKEN.finditer(text[max(0, start - 40) : start]) if m.group()[0].isalpha()]
    return words[-1] if words else ""


def all_spans(text: str, model: SpanModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and the model's that they don't cover.

    A found span is added if it meets no base span, or holds those that it meets as a whole.
    """
    base = base_spans(text)
    added = []
    if base:
        edges = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in edges])
        reach = np.maximum.accumulate([b for _, b in edges])
    for kind, start, end in model.spans(text):
        if base:
            at = int(np.searchsorted(starts, end))
            met = [e for e in edges[max(0, int(np.searchsorted(reach, start, "right"))) : at] if e[1] > start]
            if any(a < start or b > end or (a, b) == (start, end) for a, b in met):
                continue
        added.append((kind, start, end))
    return base, added


def examples(docs: DataFrame) -> DataFrame:
    """(island, word, labels) of all texts: different islands of up to ``EXAMPLE`` code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            seen = {}
            for text in part.column("text").to_pylist():
                for a, b in islands(text or ""):
                    if b - a <= EXAMPLE:
                        # the naming word of a secret stands before the island
                        lead = max(0, a - 24)
                        far = [(k, s - (a - lead), e - (a - lead)) for k, s, e in secrets(text[lead:b]) if s >= a - lead]
                        known = base_spans(text[a:b]) + far
                        seen[text[a:b], word_before(text, a)] = joined(known)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.string())], names=["island", "word", "labels"])

    return docs.select("text").mapInArrow(run, "island string, word string, labels string")


def widened(text: str, labels: str) -> list[Span]:
    """Labelled spans at whole tokens; of overlapping ones the longest stays."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in labels.split(",") if x)]
    taken, found = np.zeros(len(text) + 1, bool), []
    for kind, start, end in sorted(spans, key=lambda s: (s[1] - s[2], KINDS.index(s[0]))):
        start = max([a for a, b in tokens if a <= start < b], default=start)
        end = max([b for a, b in tokens if a < end <= b], default=end)
        if not taken[start:end].any():
            taken[start:end] = True
            found.append((kind, start, end))
    return found


def fit(docs: DataFrame, sample: int = SAMPLE) -> SpanModel:
    """A model from a bounded sample of the islands of ``docs`` (``text``; null: empty)."""
    every = materialize(examples(docs).distinct().withColumn("order", F.xxhash64("island", "word")), "span-examples")
    share = max(1, sample // (len(KINDS) + 1))
    chosen = []
    for kind in [*KINDS, ""]:
        mine = every.where(F.col("labels").contains(f"{kind}:")) if kind else every.where(F.col("labels") == "")
        chosen += mine.orderBy("order", "island", "word").limit(share).collect()
    chosen = sorted({(r["island"], r["word"], r["labels"]) for r in chosen})
    return SpanModel().fit([(text, word, widened(text, labels)) for text, word, labels in chosen])


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())])


def personal_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``personal``: all spans as (kind, start, end, base).

    Offsets are code points, the end exclusive. A null text is empty and has no spans. Long texts are
    searched to their end. Repeated rows are searched each on its own. A column ``personal`` of
    ``docs`` gives way. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in (text, "personal")]
    names = [f.name for f in kept]
    inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def found(value: str | None) -> list[dict]:
        base, added = all_spans(value or "", held.value)
        ours = set(base)
        return [{"kind": k, "start": a, "end": b, "base": (k, a, b) in ours} for k, a, b in listed(base + added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text):
            spans = pa.array([found(v) for v in part.column(text).to_pylist()], inner)
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], spans], names=[*names, "personal"])

    return docs.select(*[F.col(f"`{n}`") for n in [*names, text]]).mapInArrow(run, StructType([*kept, StructField("personal", ArrayType(SPAN))]))
