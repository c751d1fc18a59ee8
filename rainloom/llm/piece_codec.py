"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words (a run of spaces and what follows it up to the next space) never share a piece, which
is checked when the model is read. All new words of a block are flat symbol arrays; each round
takes the smallest pair rank of every word and merges its occurrences from the left at once,
as far as that equals merging them one by one, until no pair remains. The ids of words met
before come from a table of bounded size.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from rainloom.llm.textblocks import blocks, unused

SPACE = "▁"
NO_PAIR = np.int32(np.iinfo(np.int32).max)
#: Words of more symbols are merged with a heap, as rounds over one long run could be many.
LONG = 4096
#: The table of known words starts anew beyond so many words or characters.
MOST_WORDS, MOST_CHARS = 250_000, 5_000_000
WORD = re.compile(r" *[^ ]+| +")

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """Symbols, pair ranks and byte forms of one model.

    Symbols are piece ids, then single characters that occur only inside pieces, then one
    symbol for every other character.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in normal) or model.normalize(" ﬁ  x") != f"{SPACE * 2}ﬁ{SPACE * 2}x":
            raise ValueError("only models that keep the text as it is, with pieces inside words, can be used")
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if any(not model.is_byte(int(i)) for i in self.byte_id):
            raise ValueError("the model has no byte fallback")
        symbol = {pieces[i]: i for i in normal}
        inner = sorted({c for p in symbol for c in p} - symbol.keys())
        symbol |= {c: size + k for k, c in enumerate(inner)}
        self.size, self.other = size, size + len(inner)
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for text, number in symbol.items():
            if len(text) == 1:
                self.symbol_of[ord(text)] = number
        self.symbol_of[32] = self.symbol_of[ord(SPACE)]
        scores = np.array([model.get_score(i) for i in range(size)])
        order = np.unique(-scores[normal], return_inverse=True)[1]
        rank_of = dict(zip(normal, order.tolist()))
        pairs = {}
        for i in normal:
            text = pieces[i]
            for cut in range(1, len(text)):
                left, right = symbol.get(text[:cut]), symbol.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank_of[i], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        forms = [b"" if model.is_control(i) else bytes([int(pieces[i][3:5], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i) else pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        self.form_size = np.array([len(f) for f in forms], np.int64)
        self.form_start = np.concatenate(([0], np.cumsum(self.form_size)[:-1]))
        self.forms = np.frombuffer(b"".join(forms), np.uint8)
        self.starts_blank = np.array([f.startswith(b" ") and not model.is_unknown(i) for i, f in enumerate(forms)])
        self.known = KnownWords(self)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``NO_PAIR`` where it merges to nothing."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_PAIR), self.merged[at]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols and code points of all words in a row, and the length of each."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.symbol_of[points], points, np.fromiter(map(len, words), np.int64, len(words))

    def merge(self, symbol: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge all words to the end: symbols, their word, and the place of their first character."""
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(symbol))
        last = np.ones(len(symbol), bool)
        last[:-1] = word[1:] != word[:-1]
        rank, merged = self.look_up(symbol, np.roll(symbol, -1))
        rank = np.where(last, NO_PAIR, rank)
        done = []
        while len(symbol):
            first = np.concatenate(([True], word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, np.flatnonzero(first))
            of = np.cumsum(first) - 1
            open_ = least[of] != NO_PAIR
            if not open_.all():
                done.append((symbol[~open_], word[~open_], place[~open_]))
                symbol, word, place, rank, merged, of = (x[open_] for x in (symbol, word, place, rank, merged, of))
                if not len(symbol):
                    break
            chosen = self.leftmost(symbol, word, rank, merged, rank == least[of])
            symbol = symbol.copy()
            symbol[chosen] = merged[chosen]
            gone = np.zeros(len(symbol), bool)
            gone[chosen + 1] = True
            touched = np.zeros(len(symbol), bool)
            touched[chosen] = True
            symbol, word, place, rank, merged, touched = (x[~gone] for x in (symbol, word, place, rank, merged, touched))
            touched[:-1] |= touched[1:]
            at = np.flatnonzero(touched)
            after = np.minimum(at + 1, len(symbol) - 1)
            new_rank, new_merged = self.look_up(symbol[at], symbol[after])
            inside = (after > at) & (word[after] == word[at])
            rank[at] = np.where(inside, new_rank, NO_PAIR)
            merged[at] = new_merged
        symbol, word, place = (np.concatenate(x) for x in zip(*done)) if done else (symbol, word, place)
        order = np.argsort(place, kind="stable")
        return symbol[order], word[order], place[order]

    def leftmost(self, symbol, word, rank, merged, candidate) -> np.ndarray:
        """Pairs to merge in this round, all of the smallest rank of their word.

        From the left and without overlap; a word stops after a merge whose new neighbours
        would be merged before the next of these.
        """
        at = np.flatnonzero(candidate)
        run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])))
        offset = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        at = at[offset % 2 == 0]
        joined = np.concatenate(([False], at[1:] == at[:-1] + 2))
        left = np.where(joined, np.concatenate(([0], merged[at[:-1]])), symbol[np.maximum(at - 1, 0)])
        has_left = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
        right_at = np.minimum(at + 2, len(symbol) - 1)
        has_right = (at + 2 < len(symbol)) & (word[right_at] == word[at])
        low = np.where(has_left, self.look_up(left, merged[at])[0], NO_PAIR)
        low = np.minimum(low, np.where(has_right, self.look_up(merged[at], symbol[right_at])[0], NO_PAIR))
        stop = (low <= rank[at]).astype(np.int64)
        before = np.cumsum(stop) - stop
        head = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
        return at[before == before[np.flatnonzero(head)[np.cumsum(head) - 1]]]

    def merge_long(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one word with a heap of pairs: symbols and places."""
        value = symbol.tolist()
        after, before = [*range(1, len(value)), -1], [-1, *range(len(value) - 1)]
        rank, merged = self.look_up(symbol[:-1], symbol[1:])
        heap = [(r, i, value[i], value[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), merged.tolist())) if r != NO_PAIR]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, whole = heapq.heappop(heap)
            j = after[i]
            if j < 0 or value[i] != left or value[j] != right:
                continue
            value[i], value[j], after[i] = whole, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0:
                    r, m = self.look_up(np.array([value[k]]), np.array([value[after[k]]]))
                    if r[0] != NO_PAIR:
                        heapq.heappush(heap, (int(r[0]), k, value[k], value[after[k]], int(m[0])))
        kept = [i for i, v in enumerate(value) if v >= 0]
        return np.array([value[i] for i in kept], np.int32), np.array(kept)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each."""
        symbol, points, size = self.symbols(words)
        start = np.concatenate(([0], np.cumsum(size)))
        short = size <= LONG
        here = np.repeat(short, size)
        where = np.flatnonzero(here)
        ids, word, place = self.merge(symbol[here], size[short])
        found = [(ids, np.flatnonzero(short)[word], where[place])]
        for k in np.flatnonzero(~short):
            ids, place = self.merge_long(symbol[start[k] : start[k + 1]])
            found.append((ids, np.full(len(ids), k), place + start[k]))
        ids, word, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(place, kind="stable")
        ids, word, place = ids[order], word[order], place[order]
        bare = np.flatnonzero(ids >= self.size)
        if len(bare):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[place[bare]]]
            times = np.ones(len(ids), np.int64)
            times[bare] = [len(b) for b in raw]
            first = np.concatenate(([0], np.cumsum(times)[:-1]))
            ids, word = np.repeat(ids, times), np.repeat(word, times)
            into = np.repeat(first[bare], times[bare]) + np.concatenate([np.arange(len(b)) for b in raw])
            ids[into] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n + 1 offsets."""
        split = [WORD.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        codes, starts, sizes, ids = self.known.look_up(chain.from_iterable(split))
        count = sizes[codes]
        out = ids[spread(starts[codes], count)]
        words = np.cumsum([0, *map(len, split)])
        return out, np.concatenate(([0], np.cumsum(count)))[words]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id rows; the blank of the start is left out, broken bytes become U+FFFD.

        Control ids give nothing.
        """
        some = np.flatnonzero(np.diff(offsets))
        skip = np.zeros(len(ids), np.int64)
        heads = offsets[some]
        skip[heads] = self.starts_blank[ids[heads]]
        size = self.form_size[ids] - skip
        data = self.forms[spread(self.form_start[ids] + skip, size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[offsets].tolist()
        return [data[a:b].decode("utf-8", "each_byte") for a, b in zip(ends[:-1], ends[1:])]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the spans one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class KnownWords(dict):
    """Number of each word met so far, and its ids in one growing array."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.chars, self.used = 0, 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number

    def look_up(self, words: Iterator[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words; start, size and ids by number."""
        if len(self) > MOST_WORDS or self.chars > MOST_CHARS:
            self.forget()
        codes = np.fromiter(map(self.__getitem__, words), np.int64)
        if self.new:
            ids, sizes = self.pieces.encode_words(self.new)
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids[: self.used], np.zeros(2 * (self.used + len(ids)), np.int32)))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.used += len(ids)
            self.chars += sum(map(len, self.new))
            self.new = []
        return codes, self.starts, self.sizes, self.ids


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """The tables of a model file, read once per worker."""
    return Pieces(path)


def _with(docs: DataFrame, source: str, result: StructField, work) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name != result.name]
    names = [f.name for f in kept]
    (inner,) = unused(names, "_source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (pa.RecordBatch.from_arrays([*[part.column(n) for n in names], work(part.column(inner))], names=[*names, result.name]) for part in cut(batches))

    cut = (lambda batches: blocks(batches, inner)) if result.name != "decoded" else (lambda batches: (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)))
    return docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{source}`").alias(inner)).mapInArrow(run, StructType([*kept, result]))


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int): every whole text, without begin or end ids.

    A null or empty text has no ids. Repeated rows are encoded alike, an empty table gives an
    empty one. Other columns pass through under any name; one named ``ids`` is replaced.
    """
    def work(column: pa.Array) -> pa.Array:
        ids, offsets = pieces(path).encode(column.to_pylist())
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return _with(docs, text, StructField("ids", ArrayType(IntegerType())), work)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of each id row; null ids give an empty text."""
    def work(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(pieces(path).decode(values, np.concatenate(([0], np.cumsum(sizes)))), pa.string())

    return _with(rows, ids, StructField("decoded", StringType()), work)


def id_digest(ids: str = "ids") -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
