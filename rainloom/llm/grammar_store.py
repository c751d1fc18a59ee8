"""Token ids in files compressed by a Re-Pair grammar per shard.

A shard is a run of whole documents in ascending doc_id order. Its ids are reduced by rounds:
the most frequent neighbouring pairs become rules, all their occurrences from the left are
replaced at once, and rounds go on until no pair is frequent. A pair never spans two
documents. A shard's row holds the rules, the length that each rule expands to, the reduced
sequence and, per document, where it starts among ids and symbols; so any range of ids is
decoded from the symbols that cover it alone.

Ids come from the tokenizers library. A text is cut at single spaces between other characters,
where that tokenizer always cuts, and each different piece is encoded once per worker. Words of
letters go to the library in the characters that its model knows, cut already.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rainloom.llm.textblocks import blocks, flat
from rainloom.session import scratch_path

END = 0
#: Ids after which a shard is closed at the next end of a document.
SHARD_IDS = 1 << 20
#: Rules per round, and occurrences that make a rule worth its place.
RULES, FREQUENT = 4096, 8
HASH_BITS = 21
#: Bytes of text encoded at once.
TEXT = 3 << 20
#: Pairs that are counted without buckets.
FEW = 1 << 17
#: Ids of a rule that is opened once for all its places.
SHORT = 64
MOST_WORDS, MOST_CHARS = 1_200_000, 24_000_000
#: Spaces that could belong to a longer run: such texts are cut with care.
RUN = re.compile(r"\s (\s|$)")
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes that may end or begin a character of white space.
BLANK_ENDS = np.array([b <= 32 or 0x80 <= b <= 0x8A or b in (0xA0, 0xA8, 0xA9, 0xAF, 0x9F) or b == 0x85 for b in range(256)])
BLANK_HEADS = np.array([b <= 32 or b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
#: Words and marks, which the tokenizer cuts from each other, as it does a single line feed before a word.
PUNCTUATION = frozenset(".,;:!?")
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-&(-/:-@\[-`{-~]+"
SPELT = re.compile(f" ?{LETTERS}|{MARKS}|\n")
WORDS = re.compile(f" ?{LETTERS}(?:{MARKS})?(?:\n{LETTERS}(?:{MARKS})?)*")
TAIL = "".join(chr(c) for c in range(33, 127) if re.match(MARKS, chr(c)))


class Pieces:
    """Ids of the pieces of texts; ``known`` numbers them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        blank = [self.tokenizer.id_to_token(i).startswith("Ġ") for i in range(self.tokenizer.get_vocab_size())]
        self.blank = np.array(blank)
        # the same model, for words that are cut and spelt in its own characters already
        self.speller = Tokenizer.from_file(path)
        self.speller.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelling = np.zeros(256, np.uint32)
        self.spelling[own] = own
        rest = np.flatnonzero(self.spelling == 0)
        self.spelling[rest] = 256 + np.arange(len(rest))
        self.spelling[1] = ord(" ")
        self.forget()

    def forget(self) -> None:
        # a dict of its own: of plain values, it isn't looked through by the garbage collector
        self.known: dict[str, int] = {}
        self.new: list[str] = []
        self.words, self.chars, self.used = 0, 0, 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part; one that wasn't met before gets the next and waits for ``fill``."""
        codes = [*map(self.known.get, parts)]
        unmet = [k for k, code in enumerate(codes) if code is None]
        new = dict.fromkeys([parts[k] for k in unmet])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.new += new
        for k in unmet:
            codes[k] = self.known[parts[k]]
        return np.array(codes, np.int64)

    def cut(self, text: str) -> list[str]:
        """Pieces: the first as it is, the others with the space before them."""
        if any(s in text for s in self.special):
            return [text]
        parts = SAFE_CUT.split(text) if RUN.search(text) else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]

    def library(self, pieces: list[str], words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece's begin and how many they are. Pieces go to the library in one string and are
        parted at the ids that begin with a space, where there are such; others go one by one. The first
        ``words`` pieces are known to be a space and letters."""
        starts, sizes = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1, np.int64)
        spelt, plain, bare = [*range(words)], [], []
        for k, p in enumerate(pieces[words:], words):
            if SPELT.fullmatch(p):
                (spelt if p[0] == " " else bare).append(k)
            elif p[:1] == " " and p[1:] and not p[1:2].isspace() and not p[-1:].isspace() and " " not in p[1:]:
                plain.append(k)
        # a lone space parts the words without one
        text = "".join(pieces[:words] + [pieces[k] for k in spelt[words:]]) + "".join([" \x01" + pieces[k] for k in bare])
        text = self.spelling[np.frombuffer(text.replace(" ", "\x01 ").encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.zeros(0, np.uint32)
        for tokenizer, led, rest, text in ((self.speller, spelt, bare, text), (self.tokenizer, plain, [], "".join([pieces[k] for k in plain]))):
            if not text:
                continue
            found = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.blank[found])
            if len(cuts) == len(led) + len(rest):
                ends = np.append(cuts[1:], len(found))
                cuts[len(led) :] += 1
                starts[led + rest], sizes[led + rest] = len(ids) + cuts, ends - cuts
                ids = np.concatenate((ids, found))
        rest = np.flatnonzero(sizes < 0)
        if len(rest):
            found = [f.ids for f in self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)]
            sizes[rest] = [len(f) for f in found]
            starts[rest] = len(ids) + np.cumsum(sizes[rest]) - sizes[rest]
            ids = np.concatenate((ids, np.fromiter(chain.from_iterable(found), np.uint32)))
        return ids, starts, sizes

    def fill(self) -> None:
        """Encode the new pieces."""
        pieces, self.new = self.new, []
        ids, starts, sizes = self.library(pieces, self.words)
        n = len(self.known)
        self.ids = longer(self.ids, self.used + len(ids))
        self.starts, self.sizes = longer(self.starts, n), longer(self.sizes, n)
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n - len(pieces) : n], self.sizes[n - len(pieces) : n] = self.used + starts, sizes
        self.used += len(ids)
        self.words, self.chars = 0, self.chars + sum(map(len, pieces))

    @staticmethod
    def parts(piece: str) -> list[str]:
        """What is encoded by itself: the tokenizer cuts a piece there too."""
        if WORDS.fullmatch(piece):
            return SPELT.findall(piece)
        if piece[-1:] in PUNCTUATION and piece[0] == " " and piece[1:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return [piece]

    def careful(self, column: pa.Array) -> np.ndarray:
        """Texts that aren't just split at every space: all that hold a special token, or a space beside other blanks."""
        data, offsets = flat(column)
        odd = np.zeros(len(column), bool)
        at = np.flatnonzero(data == 32)
        after = np.append(data, 32)[at + 1]
        last = np.zeros(len(data) + 1, bool)
        last[offsets[1:]] = True
        at = at[(at > 0) & BLANK_ENDS[data[at - 1]] & (BLANK_HEADS[after] | last[at + 1])]
        odd[np.searchsorted(offsets, at, "right") - 1] = True
        for special in self.special:
            odd |= pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        return odd

    def split(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of texts that are split at every space, and how many each text has."""
        lists = pc.split_pattern(column, " ")
        words = lists.flatten().dictionary_encode()
        place, sizes = words.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        first = np.cumsum(sizes) - sizes
        words, stems = words.dictionary, pc.utf8_rtrim(words.dictionary, TAIL)
        simple = pc.match_substring_regex(stems, f"^{LETTERS}$").to_numpy(zero_copy_only=False)
        tail = np.where(simple, pc.binary_length(words).to_numpy().astype(np.int64) - pc.binary_length(stems).to_numpy(), 0)
        stems = stems.filter(pa.array(simple)).dictionary_encode()
        # the first word of a text has no space before it, so it stands for itself
        other = [self.parts(" " + w) for w in strings(words.filter(pa.array(~simple)))]
        other += [self.parts(w) if w else [] for w in strings(words.take(pa.array(place[first])))]
        n = len(words)
        rest = np.concatenate((np.flatnonzero(~simple), n + np.arange(len(first))))
        place = place.astype(np.int64)
        place[first] = rest[len(rest) - len(first) :]
        many = np.ones(n + len(first), np.int64)
        many[:n] += tail > 0
        many[rest] = [len(p) for p in other]
        starts = np.cumsum(many) - many
        codes = np.zeros(int(many.sum()), np.int64)
        codes[starts[:n][simple]] = self.numbers([" " + w for w in strings(stems.dictionary)])[stems.indices.to_numpy()]
        self.words = len(self.new)
        data, ends = flat(words)
        marks, which = np.unique(data[ends[1:][tail == 1] - 1], return_inverse=True)
        codes[starts[:n][tail == 1] + 1] = self.numbers([chr(m) for m in marks])[which]
        codes[starts[:n][tail > 1] + 1] = self.numbers([w[len(w.rstrip(TAIL)) :] for w in strings(words.filter(pa.array(tail > 1)))])
        codes[spread(starts[rest], many[rest])] = self.numbers([*chain.from_iterable(other)])
        each = many[place]
        return codes[spread(starts[place], each)], np.diff(np.concatenate(([0], np.cumsum(each)))[np.append(first, len(place))])

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by ``END``, and n + 1 offsets."""
        if len(self.known) > MOST_WORDS or self.chars > MOST_CHARS:
            self.forget()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = pc.fill_null(column.cast(pa.large_string()), "")
        odd = self.careful(column)
        many = np.zeros(len(column), np.int64)
        cut = [[*chain.from_iterable(map(self.parts, self.cut(t)))] for t in column.filter(pa.array(odd)).to_pylist()]
        many[odd] = [len(c) for c in cut]
        plain = column.filter(pa.array(~odd))
        codes = np.zeros(0, np.int64)
        if len(plain):
            codes, many[~odd] = self.split(plain)
        if cut:
            whose, both = np.repeat(odd, many), np.zeros(int(many.sum()), np.int64)
            both[whose] = self.numbers([*chain.from_iterable(cut)])
            both[~whose] = codes
            codes = both
        if self.new:
            self.fill()
        count = self.sizes[codes]
        ids = self.ids[spread(self.starts[codes], count)]
        ends = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(many)))]
        out = np.full(len(ids) + len(column), END, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(column)), np.diff(ends))] = ids
        return out, ends + np.arange(len(column) + 1)


def strings(column: pa.Array) -> list[str]:
    """The values of a column of which none is null or holds a space."""
    one = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
    return pc.binary_join(one, pa.scalar(" ", column.type))[0].as_py().split(" ") if len(column) else []


def longer(values: np.ndarray, size: int) -> np.ndarray:
    """The same values with room for ``size``, and for as many again where there was none."""
    return values if size <= len(values) else np.concatenate((values, np.zeros(2 * size - len(values), values.dtype)))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the spans one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def reduce_ids(ids: np.ndarray, offsets: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair rounds over one shard until no pair is frequent: (symbols, offsets of documents among them, rules, expansion lengths).

    Symbols from ``first`` on are rules, in the order of ``rules`` (pairs of earlier symbols).
    """
    symbols = ids.astype(np.uint32)
    filled = np.diff(offsets) > 0
    last = np.zeros(len(symbols), bool)
    last[offsets[1:][filled] - 1] = True
    # starts of pairs that may be frequent: no other pair becomes so unless it holds a new symbol
    open_ = ~last
    rules, lengths = [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64)
    number = first
    hashed = lambda key: (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    while len(symbols) > 1:
        likely = np.flatnonzero(open_)
        key = symbols[likely].astype(np.int64) << 32 | symbols[likely + 1]
        if len(key) > FEW:
            # only pairs of buckets that hold FREQUENT pairs in all are sorted and counted
            bucket = hashed(key)
            full = np.bincount(bucket, minlength=1 << HASH_BITS) >= FREQUENT
            here = np.flatnonzero(full[bucket])
            likely, key, bucket = likely[here], key[here], bucket[here]
        ordered = np.sort(key)
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
        count = np.diff(np.concatenate((heads, [len(ordered)])))
        often = np.flatnonzero(count >= FREQUENT)
        if not len(often):
            break
        if len(key) <= FEW:
            frequent = ordered[heads[often]]
            here = np.flatnonzero(frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key)
            likely, key = likely[here], key[here]
        if len(often) > RULES:
            often = often[np.argsort(-count[often], kind="stable")[:RULES]]
        chosen = np.sort(ordered[heads[often]])
        if len(key) > FEW:
            slot = np.full(1 << HASH_BITS, -1, np.int32)
            slot[hashed(chosen)] = np.arange(len(chosen))
            at = slot[bucket]
            here = np.flatnonzero(at >= 0)
            place, key, at = likely[here], key[here], at[here]
            other = np.flatnonzero(chosen[at] != key)
            at[other] = np.minimum(np.searchsorted(chosen, key[other]), len(chosen) - 1)
        else:
            place, at = likely, np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
        hit = np.flatnonzero(chosen[at] == key)
        place, at = place[hit], at[hit]
        run = np.concatenate(([True], place[1:] != place[:-1] + 1))
        first_of = (np.arange(len(place)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0
        place, at = place[first_of], at[first_of]
        times = np.bincount(at, minlength=len(chosen))
        used = np.flatnonzero(times)
        rule = (np.cumsum(times > 0) - 1)[at]
        pairs = np.column_stack((chosen[used] >> 32, chosen[used] & 0xFFFFFFFF))
        size = lambda s: np.where(s < first, 1, lengths[np.maximum(s - first, 0)]) if len(lengths) else np.ones(len(s), np.int64)
        lengths = np.concatenate((lengths, size(pairs[:, 0]) + size(pairs[:, 1])))
        rules.append(pairs)
        symbols[place] = number + rule
        number += len(pairs)
        left = np.ones(len(symbols), bool)
        left[place + 1] = False
        last[place] = last[place + 1]
        open_ = np.zeros(len(symbols), bool)
        open_[likely] = open_[place] = True
        # the symbol before a new one: two before it, where the one before was taken into another
        before = place - 1
        before = before - ~left[before]
        open_[before[before >= 0]] = True
        symbols, last, open_ = symbols[left], last[left], open_[left]
        open_ &= ~last
    starts = np.concatenate(([0], np.flatnonzero(last) + 1))[np.concatenate(([0], np.cumsum(filled)))]
    return symbols.astype(np.int64), starts, np.concatenate(rules), lengths


def expanded_sizes(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    sizes = np.ones(first + len(rules), np.int64)
    while True:
        known = sizes[rules[:, 0]] + sizes[rules[:, 1]]
        if (known == sizes[first:]).all():
            return sizes
        sizes[first:] = known


def opened(symbols: np.ndarray, rules: np.ndarray, first: int, wide: np.ndarray | None = None) -> np.ndarray:
    """Symbols without rules, or without those that ``wide`` marks: they are opened round by round, all at once."""
    while True:
        open_ = symbols >= first if wide is None else wide[symbols]
        if not open_.any():
            return symbols
        more = np.repeat(symbols, 1 + open_)
        at = np.flatnonzero(open_) + np.arange(int(open_.sum()))
        pair = rules[symbols[open_] - first]
        more[at], more[at + 1] = pair[:, 0], pair[:, 1]
        symbols = more


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids of a run of symbols. In a long run, each rule of up to ``SHORT`` ids is opened once."""
    symbols = symbols.astype(np.int64)
    if len(symbols) < len(rules) or not len(rules):
        return opened(symbols, rules, first).astype(np.uint32)
    sizes = expanded_sizes(rules, first)
    wide = sizes > SHORT
    short = first + np.flatnonzero(~wide[first:])
    ids = np.concatenate((np.arange(first), opened(short, rules, first))).astype(np.uint32)
    starts = np.arange(first + len(rules))
    starts[short] = first + np.cumsum(sizes[short]) - sizes[short]
    symbols = opened(symbols, rules, first, wide)
    return ids[spread(starts[symbols], sizes[symbols])]


def decode_range(shard: dict, low: int, high: int) -> np.ndarray:
    """Ids ``low`` to ``high`` of a shard row, from the symbols that cover them alone."""
    first, symbols = shard["first_rule"], np.frombuffer(shard["symbols"], np.uint32).astype(np.int64)
    lengths = np.frombuffer(shard["lengths"], np.uint32).astype(np.int64)
    each = np.where(symbols < first, 1, lengths[np.maximum(symbols - first, 0)]) if len(lengths) else np.ones(len(symbols), np.int64)
    ends = np.cumsum(each)
    a, b = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left")) + 1
    ids = expand(symbols[a:b], np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2).astype(np.int64), first)
    skip = low - (int(ends[a - 1]) if a else 0)
    return ids[skip : skip + high - low]


SHARD = "part int, shard long, first_rule long, n_docs long, n_ids long, doc_ids array<long>, doc_starts array<long>, doc_symbols array<long>, rules binary, lengths binary, symbols binary"


def write_ids(docs: DataFrame, path: str, folder: str) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write shards below ``folder``.

    Documents are dealt over tasks by ranges of doc_id, so shards by (part, shard) are in
    ascending order. A null text is empty; rows of one doc_id come in the order of their texts,
    a null doc_id comes first. An empty table writes no shard.
    """
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encoder = pieces(path)
        first = encoder.tokenizer.get_vocab_size()
        keys, held, sizes = [], [], []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            symbols, starts, rules, lengths = reduce_ids(ids, offsets, first)
            row = {"part": part, "shard": shard, "first_rule": first, "n_docs": len(offsets) - 1, "n_ids": len(ids),
                   "doc_ids": list(chain.from_iterable(keys)), "doc_starts": offsets, "doc_symbols": starts,
                   "rules": rules.astype(np.uint32).tobytes(), "lengths": lengths.astype(np.uint32).tobytes(), "symbols": symbols.astype(np.uint32).tobytes()}
            types = [pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=[*row])

        for piece in blocks(batches, limit=TEXT):
            ids, offsets = encoder.encode(piece.column("text"))
            keys.append(piece.column("doc_id").to_pylist())
            held.append(ids)
            sizes.append(np.diff(offsets))
            if sum(map(len, held)) >= SHARD_IDS:
                yield close()
                shard += 1
                keys, held, sizes = [], [], []
        if held:
            yield close()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    ranged.sortWithinPartitions("doc_id", "text").mapInArrow(shards, SHARD).write.parquet(folder)


def read_ids(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if wanted, ``ids``.

    ``start`` counts the ids of all documents before it, over all shards.
    """
    shards = spark.read.parquet(folder)
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard of a million ids, without its contents
    firsts = shards.select("part", "shard", "n_ids").withColumn("first", F.coalesce(F.sum("n_ids").over(order), F.lit(0).cast("long"))).drop("n_ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {c: batch.column(c)[i].as_py() for c in ("part", "shard", "first_rule", "rules", "symbols")}
                offsets = np.array(batch.column("doc_starts")[i].values)
                rules = np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2).astype(np.int64)
                ids = expand(np.frombuffer(shard["symbols"], np.uint32), rules, shard["first_rule"]).astype("<u4")
                for low in range(0, len(offsets) - 1, 1024):
                    some = offsets[low : low + 1025]
                    n = len(some) - 1
                    crc = [zlib.crc32(ids[a:b].data) for a, b in zip(some[:-1], some[1:])]
                    out = {
                        "part": pa.array([shard["part"]] * n, pa.int32()), "shard": pa.array([shard["shard"]] * n, pa.int64()), "doc_id": batch.column("doc_ids")[i].values.slice(low, n),
                        "place": pa.array(some[:-1]), "n_tokens": pa.array(np.diff(some)), "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(ids[some[0] : some[-1]].astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(out)

    documents = shards.select("part", "shard", "first_rule", "rules", "symbols", "doc_starts", "doc_ids").mapInArrow(
        read, "part int, shard long, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    )
    return documents.join(firsts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def stored_ids(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Write ``docs`` to a new folder of the shared store and read it back."""
    folder = scratch_path(docs.sparkSession, "grammar-ids")
    write_ids(docs, path, folder)
    return read_ids(docs.sparkSession, folder, with_ids)
