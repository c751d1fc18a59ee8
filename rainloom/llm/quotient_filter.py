"""A counting quotient filter that loses nothing: an exact counter of packed n-grams.

An n-gram is a row of 32-bit lanes (the ids of its words). The lanes are permuted by a Feistel
network, which can be undone, so that their bits are spread evenly. The upper 16 bits of the first lane are
the quotient: they are not stored, but given by the slot that an entry lies in. All other bits are
the remainder and are stored in full, next to a counter of one byte (large counts follow apart).
Entries are sorted, so filters of several shards are merged like sorted runs.
"""

from __future__ import annotations

import numpy as np

QUOTIENT_BITS = 16
SLOTS = 1 << QUOTIENT_BITS
LARGE = 255


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _rounds(width: int) -> list[tuple[int, int, np.uint32]]:
    """(read lane, changed lane, key) of every round."""
    return [(r % width, (r + 1) % width, np.uint32((0x9E3779B9 * (r + 1)) & 0xFFFFFFFF)) for r in range(3 * width)]


def permuted(lanes: np.ndarray) -> np.ndarray:
    """Rows of two or more 32-bit lanes, permuted; equal rows and only those get equal results."""
    out = lanes.astype(np.uint32)
    for read, change, key in _rounds(lanes.shape[1]):
        out[:, change] ^= _spread(out[:, read] + key)
    return out


def restored(lanes: np.ndarray) -> np.ndarray:
    """The inverse of ``permuted``."""
    out = lanes.astype(np.uint32)
    for read, change, key in reversed(_rounds(lanes.shape[1])):
        out[:, change] ^= _spread(out[:, read] + key)
    return out


def _keys(lanes: np.ndarray) -> list[np.ndarray]:
    """Sort keys, two lanes each, the most important first."""
    lanes = lanes.astype(np.uint64)
    if lanes.shape[1] % 2:
        lanes = np.column_stack([lanes, np.zeros(len(lanes), np.uint64)])
    return [(lanes[:, k] << np.uint64(32)) | lanes[:, k + 1] for k in range(0, lanes.shape[1], 2)]


def summed(lanes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows with the sums of their counts."""
    if not len(lanes):
        return lanes, counts
    keys = _keys(lanes)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = False
    for k in keys:
        k = k[order]
        first[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(first)
    return lanes[order[at]], np.add.reduceat(counts[order], at)


def pack(lanes: np.ndarray, counts: np.ndarray, first_slot: int, slots: int) -> bytes:
    """Sorted permuted rows of the slots from ``first_slot`` on as one filter."""
    used = np.bincount((lanes[:, 0] >> np.uint32(32 - QUOTIENT_BITS)).astype(np.int64) - first_slot, minlength=slots)
    small = np.minimum(counts, LARGE).astype(np.uint8)
    head = np.array([lanes.shape[1], len(lanes), first_slot, slots], np.uint32)
    return b"".join([
        head.tobytes(), used.astype(np.uint32).tobytes(), (lanes[:, 0] & np.uint32(SLOTS - 1)).astype(np.uint16).tobytes(),
        np.ascontiguousarray(lanes[:, 1:]).tobytes(), small.tobytes(), counts[counts >= LARGE].astype(np.int64).tobytes(),
    ])


def unpack(filter_bytes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Permuted rows, sorted, and their counts."""
    width, size, first_slot, slots = (int(x) for x in np.frombuffer(filter_bytes, np.uint32, 4))
    at = 16

    def take(kind: type, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(filter_bytes, kind, n, at)
        at += got.nbytes
        return got

    used, low, rest, small = take(np.uint32, slots), take(np.uint16, size), take(np.uint32, size * (width - 1)), take(np.uint8, size)
    slot = np.repeat(np.arange(first_slot, first_slot + slots, dtype=np.uint32), used)
    counts = small.astype(np.int64)
    large = counts == LARGE
    counts[large] = take(np.int64, int(large.sum()))
    return np.column_stack([(slot << np.uint32(32 - QUOTIENT_BITS)) | low, rest.reshape(size, width - 1)]), counts


def pieces(lanes: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """The filter of sorted rows, cut at ``buckets`` (a power of 2) equal ranges of slots; empty ones are left out."""
    slots = SLOTS // buckets
    shift = np.uint32(32 - (buckets - 1).bit_length())
    bucket = (lanes[:, 0] >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(lanes), np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(b, pack(lanes[i:j], counts[i:j], b * slots, slots)) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]


def merge(filters: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """All entries of several filters over the same slots with the sums of their counts, a run at a time."""
    rows, counts, waiting = [], [], 0
    for one in filters:
        lanes, n = unpack(one)
        rows.append(lanes)
        counts.append(n)
        waiting += len(n)
        if waiting > max(most, 2 * len(counts[0])):
            lanes, n = summed(np.concatenate(rows), np.concatenate(counts))
            rows, counts, waiting = [lanes], [n], len(n)
    return summed(np.concatenate(rows), np.concatenate(counts))
