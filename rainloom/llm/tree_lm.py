"""Language-model scores by context-tree weighting over bytes, learned from the whole corpus.

A text is its bytes with A-Z lowered, closed by a byte that UTF-8 never has. A byte is binary
decisions: those of a Huffman code for its class (the most frequent bytes have a class each, the
rest share one) and, in the shared class, eight for the byte itself. Every decision has a context tree of its
own over the classes of the bytes before it, ``DEPTH`` deep (two for the last eight), and mixes
Krichevsky-Trofimov estimates of all depths by their weighted probabilities. Where a decision
wasn't met in a context, the next shorter context decides.

The counts of all training texts are added up by Spark, and the trees are worked out in tasks
that each hold all contexts ending in the same ``TOP`` classes; the sums at shorter contexts are
added up by Spark. All counted contexts take part in the scores: the mixed predictions of the
``CONTEXTS`` most frequent contexts, at most 67 MB when opened, are broadcast and decide where a
whole context of ``DEPTH`` classes is among them. Of what follows other contexts, the at most
``FREQUENT`` grams met most often are broadcast with their log10 probabilities, 25 MB when opened.
Any other gram is put together per block of texts and goes to the tasks that work out the trees of
its bucket of endings. The tables are the same whatever the order of the texts.

The word baseline beside it is exact: the counts of the ``COMMON`` most frequent words are
broadcast, every other word of a document is matched with its count by a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.llm.textblocks import BASE, FOLD, blocks, flat, owners, span_hashes, sums, word_bounds
from rainloom.session import materialize

CLASSES, DEPTH = 64, 6
#: Contexts of so many last classes are worked out together; those of fewer on the driver.
TOP = 3
#: Steps a unit in which ln probabilities are added up, exactly whatever their order.
UNIT = 1 << 24
NODES = CLASSES - 1
CONTEXTS = 1 << 17
#: Grams whose log10 probabilities are broadcast, beside the contexts.
FREQUENT = 3 << 19
#: Least frequency that a class's code is built for, as a share of all bytes.
RAREST = 1 / 4096
#: The class of the end and of what is before a text, and the class that rare bytes share.
EDGE, SHARED = 0, CLASSES - 1
END = 255
COMMON = 1 << 20
END_WORD = np.uint64(1)
WORDS, GRAMS, BYTES = 0, 1, 2
#: A task adds its partial counts up beyond so many, and hands them on beyond so many different ones.
HELD, DIFFERENT = 2_500_000, 1_500_000
#: Bytes of training text for each bucket of codes that a task adds up.
COUNTED = 1 << 22
#: Partial scores of rows that a task holds before it hands them on, by blocks of texts.
FOUND = 500_000
#: Bytes of text worked on at once.
TEXT = 1 << 20
#: Grams whose trees are worked out at once, beyond which a group of contexts ends a step.
STEP = 100_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive numbers."""
    shift = np.zeros_like(x)
    for k in range(7):
        shift += np.log(x + k)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def decisions(counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 2^bits - 1 binary decisions, from counts of 2^bits symbols (last axis)."""
    zeros, ones = [], []
    for level in range(bits):
        halves = counts.reshape(*counts.shape[:-1], 1 << level, 2, -1).sum(axis=-1)
        zeros.append(halves[..., 0])
        ones.append(halves[..., 1])
    return np.concatenate(zeros, axis=-1).astype(float), np.concatenate(ones, axis=-1).astype(float)


def symbol_logs(ones: np.ndarray, bits: int) -> np.ndarray:
    """log10 probability of each symbol from the probabilities of a one at its decisions."""
    symbols = np.arange(1 << bits)
    out = np.zeros((*ones.shape[:-1], 1 << bits))
    for level in range(bits):
        p = ones[..., (1 << level) - 1 + (symbols >> (bits - level))]
        out += np.log10(np.where(symbols >> (bits - level - 1) & 1, p, 1 - p))
    return out


class ClassCode:
    """The class of every byte and its decisions: ``length`` pairs of a node (1 to 63) and a bit."""

    def __init__(self, frequency: np.ndarray):
        """Classes by frequency of the byte; ties go to the smaller byte."""
        self.total = int(frequency.sum())
        self.class_of = np.full(256, SHARED, np.int32)
        order = np.lexsort((np.arange(256), -frequency))
        order = order[order != END]
        self.class_of[order[: SHARED - 1]] = 1 + np.arange(SHARED - 1)
        self.class_of[END] = EDGE
        weight = np.bincount(self.class_of, frequency, CLASSES) + max(frequency.sum(), 1) * RAREST
        heap = [(w, k, k) for k, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        while len(heap) > 1:
            low, high = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (low[0] + high[0], CLASSES + len(heap), (low[2], high[2])))
        paths, number, level = {}, 0, [(heap[0][2], ())]
        while level:
            deeper = []
            for tree, path in level:
                if isinstance(tree, int):
                    paths[tree] = path
                else:
                    number += 1
                    deeper += [(child, (*path, (number, bit))) for bit, child in enumerate(tree)]
            level = deeper
        self.length = np.array([len(paths[k]) for k in range(CLASSES)])
        self.node = np.zeros((CLASSES, int(self.length.max())), np.int64)
        self.bit = np.zeros_like(self.node)
        for k, path in paths.items():
            self.node[k, : len(path)], self.bit[k, : len(path)] = zip(*path)

    def logs(self, ones: np.ndarray) -> np.ndarray:
        """log10 probability of each class from the probabilities of a one at nodes 1 to 63."""
        one, zero = np.log10(ones), np.log10(1 - ones)
        out = np.zeros((*ones.shape[:-1], CLASSES))
        for level in range(self.node.shape[1]):
            some = np.flatnonzero(self.length > level)
            at = self.node[some, level] - 1
            out[..., some] += np.where(self.bit[some, level] == 1, one[..., at], zero[..., at])
        return out


class Node:
    """Nodes of one depth: KT estimate and ln of the probability, own and weighted."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None = None):
        """``below``: sum of the children's weighted ln probabilities; none at full depth."""
        self.estimate = (ones + 0.5) / (zeros + ones + 1)
        own = log_kt(zeros, ones)
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.ones_like(own) if below is None else np.exp(own - np.log(2) - self.weighted)

    def mix(self, deeper: np.ndarray) -> np.ndarray:
        return self.stop * self.estimate + (1 - self.stop) * deeper


def grown(code: ClassCode, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> tuple[dict, dict, list]:
    """Of depths ``DEPTH`` to ``TOP``: keys of context and node in order, counts and ``Node``; the place of
    each node's parent; and per decision of a symbol (grams that have it, bit, place at full depth)."""
    keys, zeros, ones, taken = [], [], [], []
    for level in range(code.node.shape[1]):
        some = np.flatnonzero(code.length[symbol] > level)
        bit = code.bit[symbol[some], level]
        taken.append((some, bit))
        keys.append(context[some] * CLASSES + code.node[symbol[some], level])
        zeros.append(np.where(bit, 0, n[some]))
        ones.append(np.where(bit, n[some], 0))
    key, zeros, ones = np.concatenate(keys), np.concatenate(zeros).astype(float), np.concatenate(ones).astype(float)
    weighted, levels, above = None, {}, {}
    for depth in range(DEPTH, TOP - 1, -1):
        key = key // CLASSES % CLASSES**depth * CLASSES + key % CLASSES
        key, into = np.unique(key, return_inverse=True)
        zeros, ones = np.bincount(into, zeros), np.bincount(into, ones)
        node = Node(zeros, ones, None if weighted is None else np.bincount(into, weighted))
        if depth < DEPTH:
            above[depth + 1] = into
        else:
            places = np.split(into, np.cumsum([len(some) for some, _ in taken])[:-1])
        weighted = node.weighted
        levels[depth] = key, zeros, ones, node
    return levels, above, [(some, bit, place) for (some, bit), place in zip(taken, places)]


def seen_from_top(levels: dict, above: dict) -> Iterator[tuple[int, np.ndarray]]:
    """Depth, and the predictions of its nodes as seen from depth ``TOP``."""
    base, share = np.zeros(len(levels[TOP][0])), np.ones(len(levels[TOP][0]))
    for depth in range(TOP, DEPTH + 1):
        node = levels[depth][3]
        if depth > TOP:
            parent, into = levels[depth - 1][3], above[depth]
            base = (base + share * parent.stop * parent.estimate)[into]
            share = (share * (1 - parent.stop))[into]
        yield depth, base + share * node.estimate


def subtrees(code: ClassCode, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Trees of all decisions from depth ``TOP`` down, for contexts that are complete in the input.

    Yields every context seen ``least`` times or more: its decisions with their predictions as
    seen from depth ``TOP``; and for decisions of the next shorter context (rows of depth
    ``TOP`` - 1, with context and node as code) the sums of counts and weighted ln probabilities.
    """
    levels, above, _ = grown(code, context, symbol, n)
    key, zeros, ones, node = levels[TOP]
    weighted = node.weighted
    short, into = np.unique(key // CLASSES % CLASSES ** (TOP - 1) * CLASSES + key % CLASSES, return_inverse=True)
    none = lambda kind: pa.nulls(len(short), kind)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(short), TOP - 1, np.int32)), pa.array(short), none(pa.int64()), none(pa.list_(pa.int32())), none(pa.list_(pa.float32())),
         *[pa.array(np.bincount(into, x).astype(np.int64)) for x in (zeros, ones)], pa.array(np.bincount(into, np.round(weighted * UNIT)).astype(np.int64))],
        names=NAMES,
    )
    for depth, p in seen_from_top(levels, above):
        key, zeros, ones, _ = levels[depth]
        heads = np.flatnonzero(key % CLASSES == 1)
        total = (zeros + ones)[heads]
        sizes = np.diff(np.concatenate((heads, [len(key)])))
        wide = np.repeat(total >= least, sizes)
        firsts = np.concatenate(([0], np.cumsum(sizes[total >= least]))).astype(np.int32)
        heads = heads[total >= least]
        lists = lambda x: pa.ListArray.from_arrays(pa.array(firsts), pa.array(x[wide]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(heads), depth, np.int32)), pa.array(key[heads] // CLASSES), pa.array((zeros + ones)[heads].astype(np.int64)),
             lists((key % CLASSES).astype(np.int32)), lists(p.astype(np.float32)), *[pa.nulls(len(heads), pa.int64())] * 3],
            names=NAMES,
        )


NAMES = ["depth", "code", "n", "nodes", "p", "zeros", "ones", "weighted"]
TREES = "depth int, code long, n long, nodes array<int>, p array<float>, zeros long, ones long, weighted long"


def context_trees(classes: ClassCode, grams: DataFrame, least: int) -> DataFrame:
    """``grams``: (code, n). The rows of ``subtrees``, contexts with the same ``TOP`` last classes in one task."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, size, group = [], 0, -1
            for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
                code, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
                low = code // CLASSES % CLASSES**TOP
                cut = int(np.searchsorted(low, group, "right"))
                if size and size + cut > STEP and cut < len(code):
                    yield tuple(map(np.concatenate, zip(*held, (code[:cut], n[:cut]))))
                    held, size, code, n = [], 0, code[cut:], n[cut:]
                if len(code):
                    held.append((code, n))
                    size, group = size + len(code), low[-1]
            if held:
                yield tuple(map(np.concatenate, zip(*held)))

        for code, n in steps():
            yield from subtrees(classes, code // CLASSES, code % CLASSES, n, least)

    low = F.pmod(F.shiftright("code", CLASSES.bit_length() - 1), F.lit(CLASSES**TOP))
    return grams.select("code", "n", low.alias("low")).repartition("low").sortWithinPartitions("low").select("code", "n").mapInArrow(grow, TREES)


def framed(data: np.ndarray, offsets: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ``DEPTH`` ends before each text and one after it; classes; places that count."""
    n = len(offsets) - 1
    symbols = np.full(len(data) + n * (DEPTH + 1), END, np.uint8)
    text = owners(offsets)
    symbols[np.arange(len(data)) + text * (DEPTH + 1) + DEPTH] = FOLD[data]
    counts = np.ones(len(symbols), bool)
    heads = offsets[:-1] + np.arange(n) * (DEPTH + 1)
    counts[(heads[:, None] + np.arange(DEPTH)).ravel()] = False
    return symbols, class_of[symbols], counts


def context_codes(classes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The ``DEPTH`` classes before each place: the nearest is the lowest digit."""
    code = np.zeros(len(where), np.int64)
    for back in range(DEPTH, 0, -1):
        code = code * CLASSES + classes[where - back]
    return code


def class_code(docs: DataFrame) -> ClassCode:
    """Classes and code by the frequency of every byte in all of ``docs``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for part in blocks(batches):
            data, offsets = flat(part.column("text"))
            total += np.bincount(FOLD[data], minlength=256)
            total[END] += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    total = np.zeros(256)
    for row in docs.select("text").mapInArrow(count, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        total[row["byte"]] = row["n"]
    return ClassCode(total)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lowered words of each text and its end, and n + 1 offsets."""
    folded = FOLD[data]
    starts, ends, firsts = word_bounds(folded, offsets)
    hashes = np.full(len(starts) + len(firsts) - 1, END_WORD, np.uint64)
    hashes[np.arange(len(starts)) + owners(firsts)] = span_hashes(folded, starts, ends)
    return hashes, firsts + np.arange(len(firsts))


def added_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in ascending order and the sums of their counts."""
    codes, n = map(np.concatenate, zip(*held))
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(n[order], first) if len(first) else n


def squeezed(*numbers: np.ndarray) -> bytes:
    """Arrays of as many 64-bit numbers, compressed; their bytes are laid out by significance."""
    data = b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in numbers)
    return np.array([len(data)], np.int64).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes, arrays: int) -> list[np.ndarray]:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64).ravel() for x in np.split(planes, arrays)]


def training_counts(docs: DataFrame, class_of: np.ndarray, buckets: int = 1) -> DataFrame:
    """(kind, code, n) over all of ``docs``: words, class grams, and bytes of the shared class.

    A task adds up what it counts and hands it on packed, by buckets of codes.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORDS: [], GRAMS: [], BYTES: []}

        def add(kind: int, codes: np.ndarray) -> None:
            codes = np.sort(codes)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
            held[kind].append((codes[first], np.diff(np.concatenate((first, [len(codes)])))))

        def handed_on(kind: int) -> Iterator[pa.RecordBatch]:
            if not held[kind]:
                return
            codes, n = added_up(held[kind]) if len(held[kind]) > 1 else held[kind][0]
            held[kind] = []
            bucket = (codes.view(np.uint64) * np.uint64(BASE) >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            codes, n = codes[order], n[order]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            some = np.flatnonzero(np.diff(ends, prepend=0))
            packs = [squeezed(np.diff(codes[low:high], prepend=0), n[low:high]) for low, high in zip(np.concatenate(([0], ends))[some], ends[some])]
            for low in range(0, len(some), 256):
                part = some[low : low + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(len(part), kind, np.int32)), pa.array(packs[low : low + 256], pa.binary())], names=["bucket", "kind", "data"]
                )

        for part in blocks(batches, limit=TEXT):
            data, offsets = flat(part.column("text"))
            add(WORDS, word_hashes(data, offsets)[0].view(np.int64))
            symbols, classes, here = framed(data, offsets, class_of)
            where = np.flatnonzero(here)
            codes = context_codes(classes, where)
            add(GRAMS, codes * CLASSES + classes[where])
            rare = np.flatnonzero(classes[where] == SHARED)
            add(BYTES, codes[rare] % CLASSES**2 * 256 + symbols[where[rare]])
            for kind in held:
                if sum(len(k) for k, _ in held[kind]) > HELD:
                    held[kind] = [added_up(held[kind])]
                    if len(held[kind][0][0]) > DIFFERENT:
                        yield from handed_on(kind)
        for kind in held:
            yield from handed_on(kind)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None

        def totals() -> Iterator[pa.RecordBatch]:
            codes, n = added_up(held)
            for low in range(0, len(codes), 1 << 16):
                some = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes[some]), at[1], np.int32)), pa.array(codes[some]), pa.array(n[some])], names=["kind", "code", "n"])

        for batch in batches:
            for bucket, kind, data in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if (bucket, kind) != at:
                    if held:
                        yield from totals()
                    held, size, at = [], 0, (bucket, kind)
                steps, n = unsqueezed(data.as_py(), 2)
                held.append((np.cumsum(steps), n))
                size += len(n)
                if size > HELD and len(held) > 1:
                    held = [added_up(held)]
                    size = 0
        if held:
            yield from totals()

    packs = docs.select("text").mapInArrow(count, "bucket long, kind int, data binary")
    return packs.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(add_up, "kind int, code long, n long")


class Short:
    """Predictions of contexts of fewer than ``TOP`` classes, and what longer ones take from them."""

    def __init__(self, code: ClassCode, two: np.ndarray, base: np.ndarray, share: np.ndarray):
        self.code, self.two, self.base, self.share = code, two, base, share


class GramLogs:
    """log10 probabilities of grams after their longest counted endings, from all counts of their bucket."""

    def __init__(self, short: Short, grams: np.ndarray, n: np.ndarray):
        order = np.argsort(grams)
        self.short, self.grams, self.n, self.levels = short, grams[order], n[order], {}
        self.logs = np.zeros(len(grams))
        if not len(grams):
            return
        levels, above, taken = grown(short.code, self.grams // CLASSES, self.grams % CLASSES, self.n)
        for depth, p in seen_from_top(levels, above):
            key = levels[depth][0]
            at, node = key // CLASSES % CLASSES**2, key % CLASSES - 1
            self.levels[depth] = key, short.base[at, node] + short.share[at, node] * p
        for some, bit, place in taken:
            p = self.levels[DEPTH][1][place]
            self.logs[some] += np.log10(np.where(bit, p, 1 - p))

    def of(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return self.unmet(grams)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        out, other = self.logs[at], np.flatnonzero(self.grams[at] != grams)
        out[other] = self.unmet(grams[other])
        return out

    def unmet(self, grams: np.ndarray) -> np.ndarray:
        """Every decision after the longest ending that it was met in."""
        code, context, symbol, out = self.short.code, grams // CLASSES, grams % CLASSES, np.zeros(len(grams))
        for level in range(code.node.shape[1]):
            some = np.flatnonzero(code.length[symbol] > level)
            node, bit, near = code.node[symbol[some], level], code.bit[symbol[some], level], context[some]
            p, left = self.short.two[near % CLASSES**2, node - 1], np.arange(len(some))
            for depth, (keys, known) in self.levels.items():
                wanted = near[left] % CLASSES**depth * CLASSES + node[left]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                left = left[hit]
                p[left] = known[at[hit]]
            out[some] += np.log10(np.where(bit, p, 1 - p))
        return out


SCATTER = 0x9E3779B1


def bucket_of(context: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of endings that a context belongs to; ``gram_bucket`` is the same in Spark."""
    return (context % CLASSES**TOP * SCATTER >> 12 & 0xFFFFF) % buckets


def gram_bucket(buckets: int) -> Column:
    low = F.pmod(F.shiftright("code", CLASSES.bit_length() - 1), F.lit(CLASSES**TOP))
    return F.shiftright(low * F.lit(SCATTER).cast("long"), 12).bitwiseAND(F.lit(0xFFFFF)) % F.lit(buckets)


def packed(grams: np.ndarray, text: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Buckets, and for each its different grams, how often each is in a row, and the texts of all of them."""
    key = bucket_of(grams // CLASSES, buckets)
    order = np.lexsort((grams, key))
    key, grams, text = key[order], grams[order], text[order].astype(np.uint32)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    out = []
    for low, high in zip(first, [*first[1:], len(key)]):
        part = grams[low:high]
        head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sizes = np.diff(np.concatenate((head, [len(part)]))).astype(np.uint32)
        data = np.array([len(head)], np.int64).tobytes() + np.diff(part[head], prepend=0).tobytes() + sizes.tobytes() + text[low:high].tobytes()
        out.append(np.array([len(data)], np.int64).tobytes() + pa.compress(data, codec="zstd", asbytes=True))
    return key[first], out


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    data = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return (np.cumsum(np.frombuffer(data, np.int64, n, 8)), np.frombuffer(data, np.uint32, n, 8 + 8 * n), np.frombuffer(data, np.uint32, -1, 8 + 12 * n))


def open_scores(spark: SparkSession, short: Short, grams: DataFrame, open_: DataFrame, buckets: int) -> DataFrame:
    """(_row, _deep): what the grams of each row add to its score. ``open_``: (_row, bucket, data), the
    first row of a block of texts and what ``packed`` made of it; ``grams``: (code, n)."""
    held = spark.sparkContext.broadcast(short)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, counts, logs, found, size = -1, [], None, {}, 0

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*found]), pa.array([x.tobytes() for x in found.values()])], names=["_row", "data"])

        for batch in batches:
            keys, row = batch.column("bucket").to_numpy(), batch.column("_row").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | ((row[1:] < 0) != (row[:-1] < 0)))))
            for low, high in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[low] != bucket:
                    bucket, counts, logs = keys[low], [], None
                part = batch.slice(low, high - low)
                if row[low] < 0:
                    counts.append((part.column("code").to_numpy(), part.column("n").to_numpy()))
                    continue
                if logs is None:
                    none = np.zeros(0, np.int64)
                    logs, counts = GramLogs(held.value, *map(np.concatenate, zip((none, none), *counts))), []
                for first, data in zip(row[low:high].tolist(), part.column("data")):
                    codes, sizes, text = unpacked(data.as_py())
                    add = np.bincount(text, np.repeat(logs.of(codes), sizes))
                    had = found.get(first, np.zeros(0))
                    if len(had) < len(add):
                        had, size = np.concatenate((had, np.zeros(len(add) - len(had)))), size + len(add) - len(had)
                    had[: len(add)] += add
                    found[first] = had
                if size > FOUND:
                    yield handed_on()
                    found, size = {}, 0
        if found:
            yield handed_on()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0)
        of_block = lambda: pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(total))), pa.array(total)], names=["_row", "_deep"])
        for batch in batches:
            for first, data in zip(batch.column("_row").to_pylist(), batch.column("data")):
                if first != at:
                    if at is not None:
                        yield of_block()
                    at, total = first, np.zeros(0)
                add = np.frombuffer(data.as_py())
                if len(total) < len(add):
                    total = np.concatenate((total, np.zeros(len(add) - len(total))))
                total[: len(add)] += add
        if at is not None:
            yield of_block()

    both = grams.select(gram_bucket(buckets).alias("bucket"), F.lit(-1).cast("long").alias("_row"), "code", "n", F.lit(None).cast("binary").alias("data")).unionByName(
        open_.select("bucket", "_row", "data"), allowMissingColumns=True
    )
    return (
        both.repartition("bucket").sortWithinPartitions("bucket", "_row").mapInArrow(score, "_row long, data binary")
        .repartition("_row").sortWithinPartitions("_row").mapInArrow(add_up, "_row long, _deep double")
    )


def frequent_grams(spark: SparkSession, short: Short, grams: DataFrame, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams met most often, ascending, and their log10 probabilities: all of those met so many times or
    more that they are ``most`` at most. ``grams``: (code, n)."""
    times = grams.groupBy("n").agg(F.count(F.lit(1)).alias("grams")).orderBy(F.desc("n")).toArrow()
    fit = int(np.searchsorted(np.cumsum(times.column("grams").to_numpy()), most, "right"))
    none = np.zeros(0, np.int64)
    if not fit:
        return none, none.astype(float)
    least, held = times.column("n")[fit - 1].as_py(), spark.sparkContext.broadcast(short)

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known(counts: list) -> pa.RecordBatch:
            found = GramLogs(held.value, *map(np.concatenate, zip(*counts)))
            often = np.flatnonzero(found.n >= least)
            return pa.RecordBatch.from_arrays([pa.array([found.grams[often].tobytes()]), pa.array([found.logs[often].tobytes()])], names=["grams", "logs"])

        at, counts = -1, []
        for batch in batches:
            keys = batch.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            for low, high in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[low] != at and counts:
                    yield known(counts)
                    counts = []
                at, part = keys[low], batch.slice(low, high - low)
                counts.append((part.column("code").to_numpy(), part.column("n").to_numpy()))
        if counts:
            yield known(counts)

    dealt = grams.select(gram_bucket(buckets).alias("bucket"), "code", "n").repartition("bucket").sortWithinPartitions("bucket")
    got = dealt.mapInArrow(logs, "grams binary, logs binary").toArrow()
    found = [np.concatenate([np.frombuffer(x.as_py(), kind) for x in got.column(c)] or [none.astype(kind)]) for c, kind in (("grams", np.int64), ("logs", float))]
    del got
    order = np.argsort(found[0])
    return found[0][order], found[1][order]


class TreeModel:
    """The kept contexts with their predictions, as they are broadcast; ``open`` makes the tables.

    ``logs``: log10 probability of every class per context, ``bytes``: of every byte in the
    shared class, ``longer``: the row of a context's extension by one class, -1 for none.
    """

    def __init__(self, code: ClassCode, counts: DataFrame, contexts: int = CONTEXTS):
        self.code, self.class_of = code, code.class_of
        grams = counts.where(F.col("kind") == GRAMS)
        total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        trees = materialize(context_trees(code, grams, -(-total // (8 * contexts))), "trees")
        sums_of = [np.zeros((CLASSES**2, CLASSES)) for _ in range(3)]
        got = trees.where(F.col("depth") == TOP - 1).groupBy("code").agg(*[F.sum(c).alias(c) for c in NAMES[-3:]]).toArrow()
        for grid, name in zip(sums_of, NAMES[-3:]):
            grid.ravel()[got.column("code").to_numpy()] = got.column(name).to_numpy()
        zeros, ones, below = (grid[:, 1:] for grid in sums_of)
        second = Node(zeros, ones, below / UNIT)
        fold = lambda x: x.reshape(CLASSES, CLASSES, NODES).sum(axis=0)
        seen = zeros + ones > 0
        first = Node(fold(zeros), fold(ones), fold(np.where(seen, second.weighted, 0)))
        met = fold(seen) > 0
        root = Node(zeros.sum(axis=0), ones.sum(axis=0), np.where(met, first.weighted, 0).sum(axis=0))
        base = root.stop * root.estimate
        near = np.where(met, base + (1 - root.stop) * first.estimate, root.estimate)
        self.root, self.near = root.estimate, near
        last = np.arange(CLASSES**2) % CLASSES
        base, share = (base + (1 - root.stop) * first.stop * first.estimate)[last], ((1 - root.stop) * (1 - first.stop))[last]
        self.two = np.where(seen, base + share * second.estimate, near[last])
        self.base, self.share = base + share * second.stop * second.estimate, share * (1 - second.stop)
        kept = trees.where(F.col("depth") >= TOP).select("depth", "code", "n", "nodes", "p").orderBy(F.desc("n"), "depth", "code").limit(contexts).toArrow()
        pairs = np.flatnonzero(seen[:, 0])
        kept = pa.concat_tables([
            pa.table([
                pa.array(np.full(len(pairs), 2, np.int32)), pa.array(pairs), pa.array((zeros + ones)[pairs, 0].astype(np.int64)),
                *[pa.array([[]] * len(pairs), kept.schema.field(c).type) for c in ("nodes", "p")],
            ], schema=kept.schema), kept,
        ]).combine_chunks()
        self.whole = kept.num_rows < contexts and total <= 8 * contexts
        order = np.lexsort((kept.column("code").to_numpy(), kept.column("depth").to_numpy(), -kept.column("n").to_numpy()))
        kept = kept.take(pa.array(order[:contexts])).combine_chunks()
        self.depth, self.codes = kept.column("depth").to_numpy(), kept.column("code").to_numpy()
        some = len(self.codes) > 0
        self.lengths = pa.compute.list_value_length(kept.column("nodes")).to_numpy() if some else np.zeros(0, np.int64)
        self.nodes = (kept.column("nodes").combine_chunks().flatten().to_numpy() - 1 if some else np.zeros(0)).astype(np.uint8)
        self.below = kept.column("p").combine_chunks().flatten().to_numpy() if some else np.zeros(0, np.float32)
        self.bytes = self.byte_table(counts)
        self.short = Short(code, self.two, self.base, self.share)
        self.logs, self.often = None, None

    def keep(self, grams: np.ndarray, logs: np.ndarray) -> None:
        """Hold ``frequent_grams``, compressed as they are broadcast."""
        self.often = squeezed(np.diff(grams, prepend=0)), logs

    def open(self) -> TreeModel:
        """Make the tables, once per worker: a context starts as its ending and takes what it knows itself."""
        if self.logs is not None:
            return self
        self.grams, self.gram_logs = (np.cumsum(unsqueezed(self.often[0], 1)[0]), self.often[1]) if self.often else (np.zeros(0, np.int64), np.zeros(0))
        self.often = None
        size = len(self.codes)
        longer = np.full((1 + CLASSES + size, CLASSES), -1, np.int32)
        longer[0] = 1 + np.arange(CLASSES)
        p = np.concatenate((self.root[None], self.near, np.zeros((size, NODES)))).astype(np.float32)
        starts = np.cumsum(self.lengths) - self.lengths
        known, rows = np.arange(CLASSES), 1 + np.arange(CLASSES)
        for d in range(2, DEPTH + 1):
            here = np.flatnonzero(self.depth == d)
            here = here[np.argsort(self.codes[here])]
            if not len(here):
                break
            parent = rows[np.searchsorted(known, self.codes[here] % CLASSES ** (d - 1))]
            row, lengths = 1 + CLASSES + here, self.lengths[here]
            longer[parent, self.codes[here] // CLASSES ** (d - 1)] = row
            p[row] = self.two[self.codes[here]] if d == 2 else p[parent]
            entry = np.repeat(starts[here] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            last, node = np.repeat(self.codes[here] % CLASSES**2, lengths), self.nodes[entry]
            p[np.repeat(row, lengths), node] = self.base[last, node] + self.share[last, node] * self.below[entry]
            known, rows = self.codes[here], row
        self.full = np.concatenate((np.zeros(1 + CLASSES, bool), self.depth == DEPTH))
        self.longer, self.logs = longer, np.empty((len(p), CLASSES), np.float32)
        for low in range(0, len(p), 4096):
            self.logs[low : low + 4096] = self.code.logs(p[low : low + 4096].astype(float))
        return self

    def rows(self, classes: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Row of the longest kept context before each place."""
        row, alive, table = np.zeros(len(where), np.int64), np.ones(len(where), bool), self.longer.ravel()
        for back in range(1, DEPTH + 1):
            longer = table.take(row * CLASSES + classes[where - back])
            alive &= longer >= 0
            row = np.where(alive, longer, row)
        return row

    def byte_table(self, counts: DataFrame) -> np.ndarray:
        """log10 probability of each byte of the shared class after two classes."""
        dense = np.zeros((CLASSES**2, 256), np.int64)
        got = counts.where(F.col("kind") == BYTES).select("code", "n").toArrow()
        dense.ravel()[got.column("code").to_numpy()] = got.column("n").to_numpy()
        zeros, ones = decisions(dense, 8)
        second = Node(zeros, ones)
        fold = lambda x: x.reshape(CLASSES, CLASSES, -1).sum(axis=0)
        first = Node(fold(zeros), fold(ones), fold(second.weighted))
        root = Node(zeros.sum(axis=0), ones.sum(axis=0), first.weighted.sum(axis=0))
        near = np.arange(CLASSES**2) % CLASSES
        seen, met = dense.sum(axis=1) > 0, dense.reshape(CLASSES, CLASSES, 256).sum(axis=(0, 2)) > 0
        deeper = np.where(seen[:, None], first.mix(second.estimate.reshape(CLASSES, CLASSES, -1)).reshape(CLASSES**2, -1), first.estimate[near])
        return symbol_logs(root.mix(np.where(met[near][:, None], deeper, root.estimate)), 8).astype(np.float32)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of every text, its end included, but for the grams of contexts that
        aren't kept at full depth and that aren't frequent themselves; these grams, and their texts."""
        symbols, classes, here = framed(data, offsets, self.class_of)
        where = np.flatnonzero(here)
        row = self.rows(classes, where)
        each = self.logs.ravel().take(row * CLASSES + classes[where]).astype(np.float64)
        left = np.zeros(0, np.int64) if self.whole else np.flatnonzero(~self.full[row])
        grams = context_codes(classes, where[left]) * CLASSES + classes[where[left]]
        order = np.argsort(grams)
        left, grams = left[order], grams[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1])))
        hit, logs = np.zeros(len(head), bool), np.zeros(len(head))
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams[head]), len(self.grams) - 1)
            hit = self.grams[at] == grams[head]
            logs[hit] = self.gram_logs[at[hit]]
        times = np.diff(np.concatenate((head, [len(grams)])))
        each[left] = np.repeat(logs, times)
        open_ = np.flatnonzero(~np.repeat(hit, times))
        rare = where[classes[where] == SHARED]
        each[classes[where] == SHARED] += self.bytes[classes[rare - 2] * CLASSES + classes[rare - 1], symbols[rare]]
        firsts = offsets + np.arange(len(offsets))
        return sums(each, firsts), grams[open_], np.searchsorted(firsts, left[open_], "right") - 1


def language_scores(docs: DataFrame, training: DataFrame, common: int = COMMON, contexts: int = CONTEXTS, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` without its text, with word and model scores; learned from ``training``.

    Adds ``n_tokens`` (words and one end), ``n_known`` (of them, met in training),
    ``train_tokens``, ``base_score`` (log10 by word counts), ``score`` (log10 probability of the
    whole text by the model) and ``bits_per_byte``. A null or empty text is one end. Without
    training texts every decision is even. Repeated rows are scored alike; columns of
    ``docs`` with the name of a result are replaced, all others are kept under any name.
    """
    code = class_code(training)
    counts = materialize(training_counts(training, code.class_of, max(1, -(-code.total // COUNTED))), "counts")
    words = counts.where(F.col("kind") == WORDS).select(F.col("code").alias("word"), "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = words.orderBy(F.desc("n"), "word").limit(common).toArrow()
    keys, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    model = TreeModel(code, counts, contexts)
    grams = counts.where(F.col("kind") == GRAMS).select("code", "n")
    buckets = 1 if model.whole else max(1, -(-grams.count() // STEP))
    if not model.whole:
        model.keep(*frequent_grams(docs.sparkSession, model.short, grams, frequent, buckets))
    held = docs.sparkSession.sparkContext.broadcast((model, keys[order], n[order]))
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "text"]
    names = [c for c in docs.columns if c.lower() not in results]
    carried = [f"kept_{i}" for i in range(len(names))]
    whole = distinct <= common

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, n = held.value
        row = TaskContext.get().partitionId() << 33
        for part in blocks(batches, limit=TEXT):
            data, offsets = flat(part.column("text"))
            hashes, firsts = word_hashes(data, offsets)
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
            c = np.where(hit, n[at], 0) if len(keys) else np.zeros(len(hashes), np.int64)
            missed = ~hit & (not whole)
            log_c = np.where(missed, 0.0, np.log10(c + 0.5))
            rare = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(sums(missed.astype(np.int64), firsts)))).astype(np.int32)), pa.array(hashes[missed].view(np.int64))
            )
            rows = row + np.arange(part.num_rows)
            row += part.num_rows
            scored, left, text = model.open().scores(data, offsets)
            bucket, packs = packed(left, text, buckets)
            open_ = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.full(part.num_rows, len(packs)))).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(bucket, pa.int64()), pa.array(packs, pa.binary())], names=["bucket", "data"]),
            )
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k) for k in carried], pa.array(rows), pa.array(np.diff(firsts)), pa.array(sums(hit.astype(np.int64), firsts)),
                 pa.array(sums(log_c, firsts)), pa.array(scored), pa.array(np.diff(offsets)), rare, open_],
                names=[*carried, "_row", "n_tokens", "_known", "_log", "score", "_bytes", "_rare", "_open"],
            )

    from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType
    schema = StructType([
        *[StructField(k, docs.select(f"`{c}`").schema[0].dataType) for k, c in zip(carried, names)],
        *[StructField(c, DoubleType() if c in ("_log", "score") else LongType()) for c in ("_row", "n_tokens", "_known", "_log", "score", "_bytes")],
        StructField("_rare", ArrayType(LongType())),
        StructField("_open", ArrayType(StructType([StructField("bucket", LongType()), StructField("data", BinaryType())]))),
    ])
    scored = materialize(docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(carried, names)], "text").mapInArrow(score, schema), "scored")
    rest = (
        scored.where(F.size("_rare") > 0).select("_row", F.explode("_rare").alias("word"))
        .groupBy("_row", "word").agg(F.count(F.lit(1)).alias("times"))
        .join(words, "word", "left")
        .groupBy("_row").agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_more"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("_log_more"),
        )
    )
    joined = scored.join(rest, "_row", "left")
    if not model.whole:
        open_ = scored.where(F.size("_open") > 0).select("_row", F.inline("_open"))
        joined = joined.join(open_scores(docs.sparkSession, model.short, grams, open_, buckets), "_row", "left")
    score_of = F.col("score") if model.whole else F.col("score") + F.coalesce("_deep", F.lit(0.0))
    floor = F.log10(F.lit(float(total) + 0.5 * (distinct + 1)))
    return joined.withColumn("score", score_of).select(
        *[F.col(k).alias(c) for k, c in zip(carried, names)], "n_tokens",
        (F.col("_known") + F.coalesce("_more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("_log") + F.coalesce("_log_more", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        "score", (-F.col("score") * float(np.log2(10)) / (F.col("_bytes") + 1)).alias("bits_per_byte"),
    )
