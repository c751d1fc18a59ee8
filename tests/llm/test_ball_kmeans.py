import hashlib

import numpy as np
import pytest

from rainloom.llm import ball_kmeans, vector_queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, whole string, _of string"


def brute(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and entries by comparing everything with everything in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1])
    cut = [slice(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    books = [[list(v[s]) for _, v in rows[:entries]] for s in cut]
    away = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    nearest = lambda x, book: min(range(len(book)), key=lambda j: (away(x, book[j]), j))
    for _ in range(rounds):
        for p, s in enumerate(cut):
            own = [nearest(v[s], books[p]) for _, v in rows]
            for j in range(len(books[p])):
                members = [v[s] for (_, v), o in zip(rows, own) if o == j]
                if members:
                    books[p][j] = [sum(c) // len(members) for c in zip(*members)]
    found = []
    for key, v in rows:
        code = [nearest(v[s], books[p]) for p, s in enumerate(cut)]
        found.append((key, "".join(f"{c:02x}" for c in code), sum(away(v[s], books[p][c]) for p, (s, c) in enumerate(zip(cut, code)))))
    return found, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def whole(v):
    return [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]


def coded(spark, rows):
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    return ball_kmeans.code_table(table).collect()


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_equal_to_comparing_all_with_all(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    rows = [(i, (middles[i % 12] + 0.1 * rng.normal(size=8)).tolist(), i % 3 or None) for i in range(280)]
    rows += [(i, rows[0][1], 1) for i in range(280, 420)]  # a third of one vector
    got = coded(spark, rows)
    found, digest = brute([(i, whole(v)) for i, v, _ in rows])
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted(found)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    label, totals = dict((i, y) for i, _, y in rows), {}
    for i, _, error in found:
        totals[label[i]] = totals.get(label[i], 0) + error
    assert all(r["label_error"] == totals[label[r["vec_id"]]] for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [], 1), (3, [1.0, nan, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [None, 0.0, 0.0, 0.0], 1), (6, [1.0, 2.0], None)]
    fine = [(9, [0.0, 0.0, 0.0, 0.0], None), (7, [0.5, -0.5, 0.0004, -0.0004], 2), (7, [0.5, -0.5, 0.0004, -0.0004], 2), (None, [3.0, 1.0, 1.0, -9.0], None)]
    got = coded(spark, odd + fine)
    found, digest = brute([(i, whole(v)) for i, v, _ in fine])
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in got], key=key) == sorted(found, key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert coded(spark, odd[:5]) == [] and coded(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)])[0]["error"] == 0


def test_rings_leave_out_only_entries_that_cannot_be_nearer():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.integers(-4, 4, size=(500, 3)), rng.integers(1 << 24, (1 << 24) + 9, size=(100, 3))])
    book = ball_kmeans.Balls(rows[:60].copy())
    code = book.assign(rows, np.zeros(len(rows), np.int64))
    for _ in range(5):
        far = np.zeros(60, np.int64)
        np.maximum.at(far, code, ball_kmeans.own_distance(rows, book.entries, code))
        entries = book.entries.copy()
        for j in np.unique(code):
            entries[j] = rows[code == j].sum(axis=0) // (code == j).sum()
        book = ball_kmeans.Balls(entries, far, book)
        code = book.assign(rows, code)
        away = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (code == np.argmin(away, axis=1)).all()
    assert min(len(n) for n in book.neighbours) < 60 and book.skip.any()


def test_query_has_every_vector(spark):
    sf = "/root/testdata/sf0.1"
    got = vector_queries.op12_ball_codes(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got.selectExpr("sum(error)").first()[0] == pytest.approx(got.dropDuplicates(["label_error"]).selectExpr("sum(label_error)").first()[0])
