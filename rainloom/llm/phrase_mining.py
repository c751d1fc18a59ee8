"""Collocations: phrases of 2 to 5 words that are more frequent than their parts let expect.

N-grams of word ids are counted in counting quotient filters (``quotient_filter``), one per shard
of the texts; shards' filters are cut at equal slot ranges and merged range by range. The ranges are
even whatever the texts, since the ids are permuted first, so no frequent phrase and no language
makes a hot group. Phrases are counted length by length: an n-gram is only looked at where the two shorter
ones in it are frequent. Which are, a bitmap of fixed size tells; where it errs, more n-grams are
counted than needed, and the counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rainloom.llm import quotient_filter as qf
from rainloom.llm.textblocks import BASE, FOLD, blocks, flat, mixed, powers
from rainloom.session import materialize

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Frequent words that are numbered densely, at most (their hashes are broadcast); with more, an
#: id is the word's 64-bit hash in two lanes and only ``BITS`` tell which words are frequent.
WORDS = 1 << 22
#: Size of the broadcast bitmap of frequent n-grams: 2^BITS bits.
BITS = 26
#: Text of a block, and n-grams that are held in a task before they are packed.
BLOCK, SHARD = 1 << 20, 1 << 20
#: Words of all texts per bucket of the merge.
BUCKET_WORDS = 1 << 20

CUT = np.zeros(256, bool)
CUT[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
BLANK = np.zeros(256, bool)
BLANK[[32, 9]] = True


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, text of each word, whether a piece starts with it)."""
    data = FOLD[data]
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = CUT[data] | BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], gap[:-1]))
    starts = np.flatnonzero(~gap & (before | edge))
    ends = np.flatnonzero(~before & (gap | edge))
    breaks = np.concatenate(([0], np.cumsum(CUT[data])))
    new = np.ones(len(starts), bool)
    text = np.searchsorted(offsets, starts, "right") - 1
    new[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (text[1:] != text[:-1])
    return data, starts, ends, text, new


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of (language, word); which words meet changes with the seed. None is 0."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    found = mixed((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(BASE) ^ lang)
    return np.where(found == 0, np.uint64(1), found)


def lang_hash(lang: str) -> int:
    """A 64-bit number of a language's name."""
    value = np.frombuffer(lang.encode() + b"\0" * (-len(lang.encode()) % 8 + 8), np.uint64)
    out = np.array([len(lang.encode())], np.uint64)
    for v in value:
        out = mixed(out ^ v) * np.uint64(BASE)
    return int(out[0])


def words_of(part: pa.RecordBatch, seed: int) -> tuple:
    data, offsets = flat(part.column("text"))
    data, starts, ends, text, new = lower_words(data, offsets)
    coded = part.column("lang").dictionary_encode()
    names = [lang_hash(x) for x in coded.dictionary.to_pylist()]
    lang = np.array(names or [0], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)][text] if len(starts) else np.zeros(0, np.uint64)
    return data, starts, ends, text, new, word_hashes(data, starts, ends, lang, seed)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, hash, n): every different word of every language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=BLOCK):
            data, starts, ends, text, _, hashes = words_of(part, seed)
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            at = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
            n = np.diff(np.concatenate((at, [len(order)])))
            one = order[at]
            sizes = ends[one] - starts[one]
            into = np.concatenate(([0], np.cumsum(sizes)))
            take = np.repeat(starts[one] - into[:-1], sizes) + np.arange(into[-1])
            words = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(into.astype(np.int64)), pa.py_buffer(data[take]))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(pa.array(text[one])), words.cast(pa.string()), pa.array(hashes[one].view(np.int64)), pa.array(n.astype(np.int64))],
                names=["lang", "word", "hash", "n"],
            )

    return docs.mapInArrow(run, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def injective_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Word counts under a seed with which no two words share a hash."""
    for seed in range(16):
        counts = materialize(word_counts(docs, seed), "phrase-words")
        if counts.groupBy("hash").count().where("count > 1").limit(1).count() == 0:
            return counts, seed
    raise RuntimeError("no seed tells all words apart")


class Bitmap:
    """A set of permuted n-grams as bits at hashed places; it holds all that were put in, and a few others."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def place(lanes: np.ndarray, size: int) -> np.ndarray:
        return (((lanes[:, 0].astype(np.uint64) << np.uint64(32)) | lanes[:, -1]) * np.uint64(BASE) >> np.uint64(64 - size)).astype(np.int64)

    def has(self, lanes: np.ndarray) -> np.ndarray:
        at = self.place(lanes, self.size)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, places: DataFrame, size: int) -> Bitmap:
        """From a column ``place``; partial bitmaps are joined by Spark, and no more than 2^size bits reach the driver."""
        at = F.col("place") + 1  # Spark's bitmaps count from 1
        parts = places.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
        bits = np.zeros(max((1 << size) // 8, 4096), np.uint8)
        for r in parts:
            start = (r["part"] - 1) * 4096
            bits[start : start + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
        return cls(bits, size)


class Ids:
    """Word ids from hashes: dense ranks of the frequent hashes, or the hashes themselves as two lanes."""

    def __init__(self, frequent: np.ndarray | None, known: Bitmap | None = None):
        self.frequent, self.known = frequent, known
        self.lanes = 1 if frequent is not None else 2

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """One uint64 per word; 0 where it isn't frequent."""
        if self.frequent is None:
            return np.where(self.known.has(self.split(hashes)), hashes, np.uint64(0))
        if not len(self.frequent):
            return np.zeros(len(hashes), np.uint64)
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, at + 1, 0).astype(np.uint64)

    def split(self, ids: np.ndarray) -> np.ndarray:
        """Ids as 32-bit lanes."""
        low = (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return low[:, None] if self.lanes == 1 else np.column_stack([(ids >> np.uint64(32)).astype(np.uint32), low])

    def hashes(self, lanes: np.ndarray) -> np.ndarray:
        """Hashes of the words of n-grams, one column per word."""
        if self.lanes == 1:
            return self.frequent[lanes.astype(np.int64) - 1]
        wide = lanes.astype(np.uint64)
        return (wide[:, ::2] << np.uint64(32)) | wide[:, 1::2]


def word_ids(frequent: DataFrame, words: int) -> Ids:
    if frequent.limit(words + 1).count() <= words:
        got = frequent.select("hash").toArrow().column("hash").to_numpy()
        return Ids(np.sort(np.ascontiguousarray(got).view(np.uint64)))

    bits = BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lanes = Ids(None).split(np.ascontiguousarray(b.column("hash").to_numpy()).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(Bitmap.place(lanes, bits))], names=["place"])

    return Ids(None, Bitmap.of(frequent.select("hash").mapInArrow(places, "place long"), bits))


def encoded(docs: DataFrame, ids: Ids, seed: int) -> DataFrame:
    """One row per block of texts: the ids of its words in order, 0 between pieces and for words that aren't frequent."""
    held = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=BLOCK):
            *_, new, hashes = words_of(part, seed)
            found = held.value(hashes)
            # a 0 before every piece; only one of several zeros in a row is needed
            spaced = np.insert(found, np.flatnonzero(new), 0)
            keep = np.ones(len(spaced), bool)
            keep[1:] = (spaced[1:] != 0) | (spaced[:-1] != 0)
            spaced = spaced[keep]
            kind = np.uint32 if held.value.lanes == 1 else np.uint64
            yield pa.RecordBatch.from_arrays([pa.array([spaced.astype(kind).tobytes()], pa.binary())], names=["ids"])

    return docs.mapInArrow(run, "ids binary")


def windows(spaced: np.ndarray, n: int, ids: Ids, shorter: Bitmap | None) -> np.ndarray:
    """Permuted lanes of all n-grams without a 0 whose two shorter ones may be frequent."""
    size = len(spaced) - n + 1
    if size <= 0:
        return np.zeros((0, n * ids.lanes), np.uint32)
    whole = np.ones(size, bool)
    for k in range(n):
        whole &= spaced[k : k + size] != 0
    at = np.flatnonzero(whole)
    lanes = lambda where, m: np.column_stack([ids.split(spaced[where + k]) for k in range(m)])
    if shorter is not None and len(at):
        either = np.unique(np.concatenate((at, at + 1)))
        good = shorter.has(qf.permuted(lanes(either, n - 1)))
        at = at[good[np.searchsorted(either, at)] & good[np.searchsorted(either, at + 1)]]
    return qf.permuted(lanes(at, n)) if len(at) else np.zeros((0, n * ids.lanes), np.uint32)


def frequent_grams(blocks_of_ids: DataFrame, n: int, ids: Ids, shorter: Bitmap | None, buckets: int, least: int) -> DataFrame:
    """(hashes of the words, f, place in the bitmap) of every n-gram that occurs ``least`` times or more."""
    held = blocks_of_ids.sparkSession.sparkContext.broadcast((ids, shorter))
    bits, shard = BITS, SHARD

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shorter = held.value
        kind = np.uint32 if ids.lanes == 1 else np.uint64
        rows, counts, waiting = [], [], 0

        def packed() -> pa.RecordBatch:
            cut = qf.pieces(*qf.summed(np.concatenate(rows), np.concatenate(counts)), buckets)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int32()), pa.array([f for _, f in cut], pa.binary())], names=["bucket", "filter"])

        for batch in batches:
            for one in batch.column("ids"):
                lanes = windows(np.frombuffer(one.as_buffer(), kind).astype(np.uint64), n, ids, shorter)
                lanes, count = qf.summed(lanes, np.ones(len(lanes), np.int64))
                rows.append(lanes)
                counts.append(count)
                waiting += len(lanes)
                if waiting >= shard:
                    yield packed()
                    rows, counts, waiting = [], [], 0
        if waiting:
            yield packed()

    def merged(table: pa.Table) -> pa.Table:
        lanes, counts = qf.merge(table.column("filter").to_pylist())
        often = counts >= least
        lanes, counts = lanes[often], counts[often]
        hashes = held.value[0].hashes(qf.restored(lanes)).view(np.int64) if len(lanes) else np.zeros((0, n), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lanes) + 1, dtype=np.int32) * n), pa.array(np.ascontiguousarray(hashes).ravel()))
        return pa.table([lists, pa.array(counts), pa.array(Bitmap.place(lanes, bits) if len(lanes) else np.zeros(0, np.int64))], names=["hashes", "f", "place"])

    return blocks_of_ids.mapInArrow(shards, "bucket int, filter binary").groupBy("bucket").applyInArrow(merged, "hashes array<long>, f long, place long")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, phrase, size, f): all words, and all phrases that occur ``least`` times or more.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: empty).
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts, seed = injective_counts(docs)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = materialize(counts.where(F.col("n") >= least), "phrase-vocabulary")
    ids = word_ids(frequent, WORDS if words is None else words)
    every = counts.agg(F.sum("n")).first()[0] or 0
    buckets = min(1 << max(0, (every // BUCKET_WORDS)).bit_length(), qf.SLOTS)
    table = materialize(encoded(docs, ids, seed), "phrase-ids")
    found, shorter = [frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))], None
    for n in range(2, longest + 1):
        grams = materialize(frequent_grams(table, n, ids, shorter, buckets, least), "phrase-grams")
        found.append(spelled(grams, frequent, n))
        if n < longest:
            shorter = Bitmap.of(grams.select("place"), BITS)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return totals, materialize(out, "phrase-counts")


def spelled(grams: DataFrame, frequent: DataFrame, n: int) -> DataFrame:
    """Phrases of n-grams given as hashes of their words."""
    out = grams.select("hashes", "f")
    for k in range(n):
        word = frequent.select(F.col("hash").alias(f"_h{k}"), F.col("word").alias(f"_w{k}"), *([F.col("lang")] if k == 0 else []))
        out = out.join(word, F.col("hashes")[k] == F.col(f"_h{k}"))
    return out.select("lang", F.concat_ws(" ", *[F.col(f"_w{k}") for k in range(n)]).alias("phrase"), F.lit(n).alias("size"), "f")


def _part(start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def scored(totals: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrases of two or more words with the parts and the score of their weakest cut.

    A product of three counts may pass 64 bits, so it is formed in decimals of 38 digits.
    """
    whole = "decimal(16,0)"
    candidates = counts.where("size >= 2").withColumn("words", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select("lang", "phrase", "size", F.col("f").alias("a"), "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    cuts = cuts.withColumn("score", F.expr(f"(CAST(a * 1000 AS DECIMAL(21,0)) * CAST(n AS {whole})) div (CAST(l AS {whole}) * CAST(r AS {whole}))"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    weakest = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(best)
    return weakest.select("lang", "phrase", "size", "a", "n", "best.l", "best.r", "best.score")


def covered(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer phrase with the words of this one in it."""
    longer = counts.where("size >= 3").withColumn("words", F.split("phrase", " "))
    spans = longer.withColumn("m", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("s", F.explode(F.expr("sequence(1, size - m + 1)")))
    return spans.groupBy("lang", _part(F.col("s"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, words: int | None = None) -> DataFrame:
    """The ``first`` collocations of every language, by score, count and spelling.

    A text's language is its ``lang``, ``und`` where that is null; a null text is empty. Repeated
    rows count as often as they stand there. Equal scores after rounding down are told apart by
    the count, then by the bytes of the phrase. An empty table gives an empty result. Other columns
    of ``docs`` are left out, whatever their names.
    """
    totals, counts = phrase_counts(docs, least, words=words)
    ranked = scored(totals, counts).join(covered(counts), ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
    )
