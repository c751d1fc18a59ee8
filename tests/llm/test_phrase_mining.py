import re
from collections import Counter

import numpy as np
import pytest

from rainloom.llm import phrase_mining, quotient_filter as qf
from tests.llm.helpers import documents, odd_documents

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least, first=2000):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in often.items():
        spans = lambda w: any(w[s : s + len(words)] == words for s in range(len(w) - len(words) + 1))
        if any(g == lang and len(w) > len(words) and f >= a and spans(w) for (g, w), f in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, ranked = Counter(), []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= first:
            ranked.append((r[0], rank[r[0]], *r[1:]))
    return ranked


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("words", [None, 0])
def test_equal_to_counting_everything(spark, words):
    table = documents(spark)
    rows = [(r["lang"], r["text"]) for r in table.collect()]
    want = brute(rows, 12, 40)
    assert len(want) > 30 and rows_of(phrase_mining.collocations(table, 12, 40, words)) == sorted(want)


def test_odd_rows_overlaps_and_pieces(spark):
    texts = [("en", "A a a A a. a b"), (None, "A b,a b;A B\ta  b\na b"), ("en", None), ("fr", ""), ("fr", "été été\x0bété été été"), (None, "x" * 300_000 + " a b"), ("en", "a a")]
    table = spark.createDataFrame([(None, t, g, "p", "q", 1, 2) for g, t in texts * 2], "doc_id long, text string, lang string, phrase string, words string, f int, size int")
    for words in (None, 0):
        assert rows_of(phrase_mining.collocations(table, 2, words=words)) == sorted(brute([(g, t) for g, t in texts * 2], 2))
    assert rows_of(phrase_mining.collocations(table.limit(0), 2)) == []
    odd = odd_documents(spark)
    assert rows_of(phrase_mining.collocations(odd, 3)) == sorted(brute([(r["lang"], r["text"]) for r in odd.collect()], 3))


def test_a_full_bitmap_changes_no_count(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "BITS", 4)
    monkeypatch.setattr(phrase_mining, "SHARD", 5_000)
    monkeypatch.setattr(phrase_mining, "BUCKET_WORDS", 4_000)
    table = documents(spark).limit(60)
    rows = [(r["lang"], r["text"]) for r in table.collect()]
    assert rows_of(phrase_mining.collocations(table, 5)) == sorted(brute(rows, 5))


def test_scores_past_64_bits(spark):
    totals = spark.createDataFrame([("en", 9_000_000_000_000)], "lang string, n long")
    counts = spark.createDataFrame([("en", "a b", 2, 3_000_000_001), ("en", "a", 1, 4_000_000_007), ("en", "b", 1, 5_000_000_011)], "lang string, phrase string, size int, f long")
    got = phrase_mining.scored(totals, counts).first()
    assert got["score"] == 1000 * 3_000_000_001 * 9_000_000_000_000 // (4_000_000_007 * 5_000_000_011)


@pytest.mark.parametrize("width", [2, 3, 5, 10])
def test_filters_lose_nothing(width):
    rng = np.random.default_rng(width)
    lanes = rng.integers(0, 9, size=(20_000, width)).astype(np.uint32)
    lanes[:100] = np.uint32(0xFFFFFFFF)
    assert (qf.restored(qf.permuted(lanes)) == lanes).all()
    want = Counter(map(tuple, lanes.tolist()))
    shards = [qf.summed(qf.permuted(part), np.ones(len(part), np.int64)) for part in np.array_split(lanes, 7)]
    for buckets in (1, 8):
        cut = [qf.pieces(*s, buckets) for s in shards]
        got = Counter()
        for b in range(buckets):
            mine = [f for c in cut for k, f in c if k == b]
            if mine:
                found, counts = qf.merge(mine, most=3_000)
                got.update(dict(zip(map(tuple, qf.restored(found).tolist()), counts.tolist())))
        assert got == want


def test_permuted_ids_fill_the_slots_evenly():
    ids = np.column_stack([np.arange(1, 100_001), np.ones(100_000)]).astype(np.uint32)
    slots = np.bincount(qf.permuted(ids)[:, 0] >> 28, minlength=16)
    assert slots.min() > 5_500 and slots.max() < 7_000
