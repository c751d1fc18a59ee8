"""Hashed terms of whole texts, and soft-binned measures of their shape, as matrix rows."""

from __future__ import annotations

import numpy as np

from rainloom.llm.textblocks import distinct_per_text, owners, span_hashes, sums, word_bounds

CLASSES = np.zeros(256, np.int64)  # 0 lower-case letters and other bytes
CLASSES[65:91] = 1
CLASSES[48:58] = 2
CLASSES[[35, 42, 36, 37, 38, 124, 60, 62]] = 3
CLASSES[[33, 44, 46, 58, 59, 63]] = 4
CLASSES[10] = 5
CLASSES[32] = 6
CLASSES[128:] = 7
N_CLASSES = 8
BINS = 8
MEASURES = N_CLASSES + 5


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text of values in 0 to 1: shares of byte classes, length, repetition, marks."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = owners(offsets)
    shares = np.bincount(text * N_CLASSES + CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, firsts = word_bounds(data, offsets)
    words = np.diff(firsts)
    each = np.maximum(words, 1)
    hashes = span_hashes(data, starts, ends)
    once = np.bincount(distinct_per_text(hashes, firsts)[0], minlength=n)
    fours = np.zeros(len(hashes), bool)
    if len(hashes):
        key = hashes.copy()
        for k in range(1, 4):
            key[:-k] ^= (hashes[k:] << np.uint64(k)) | (hashes[k:] >> np.uint64(64 - k))
        at, _, count = distinct_per_text(key, firsts)
        fours = np.bincount(at, weights=count - 1, minlength=n) / each
    else:
        fours = np.zeros(n)
    mean = sums(ends - starts, firsts) / each
    rest = [np.log1p(words) / np.log(1e6), 1 - once / each, fours, mean / 16, sums((CLASSES[data] == 3).astype(np.int64), offsets) / each / 2]
    return np.clip(np.column_stack([np.sqrt(shares), *rest]), 0, 1)


def binned(values: np.ndarray) -> np.ndarray:
    """Each value in 0 to 1 spread over its two nearest of ``BINS`` bins."""
    at = np.clip(values, 0, 1) * (BINS - 1)
    low = np.minimum(at.astype(np.int64), BINS - 2)
    out = np.zeros((*values.shape, BINS), np.float32)
    np.put_along_axis(out, low[..., None], (1 - (at - low))[..., None].astype(np.float32), -1)
    np.put_along_axis(out, low[..., None] + 1, (at - low)[..., None].astype(np.float32), -1)
    return out.reshape(len(values), -1)


def trigram_counts(data: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
    """Counts of hashed byte trigrams; a trigram never spans two texts."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, buckets), np.float32)
    wide = data.astype(np.uint32)
    key = (wide[:-2] * np.uint32(0x01000193) ^ wide[1:-1] * np.uint32(0x85EBCA6B) ^ wide[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x9E3779B1)
    key = (key >> np.uint32(32 - (buckets - 1).bit_length())).astype(np.int64)
    text = owners(offsets)
    inside = text[:-2] == text[2:]
    return np.bincount((text[:-2] * buckets + key)[inside], minlength=n * buckets).reshape(n, buckets).astype(np.float32)
