"""Texts of an Arrow batch as flat numpy arrays, in blocks of bounded size.

A block holds whole texts and about ``BLOCK_BYTES`` of UTF-8; a longer text is a block of
its own. A null text counts as an empty one. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 1 << 20


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def unused(taken: list[str], *names: str) -> list[str]:
    """Names for inner columns that none of the caller's columns has, whatever the case of its letters."""
    held, free = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        free.append(name)
    return free


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (n + 1 entries)."""
    inside = np.ones(len(data) + 1, bool)
    inside[:-1] = (data != 32) & ((data < 9) | (data > 13))
    inside[-1] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
FOLD = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


_POWERS: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least ``size`` of each; the longest are held."""
    if not _POWERS or len(_POWERS[0]) < size:
        n = 1 << int(size).bit_length()
        steps = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)
        _POWERS[:] = steps(BASE), steps(pow(BASE, -1, 1 << 64))
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span; equal bytes give equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(BASE))


def owners(firsts: np.ndarray) -> np.ndarray:
    """Text index of every item, from the index of each text's first item."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of each text's items; 0 where it has none."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[firsts[1:]] - total[firsts[:-1]]


def distinct_per_text(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count), sorted by text and hash, each hash once per text."""
    text = owners(firsts)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return text[at], hashes[at], np.diff(np.concatenate((at, [len(text)])))
