import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.llm import kmeans_tree, vector_queries


def brute(rows, asks, k=5):
    ids = np.array([i for i, _ in rows])
    found = {}
    for i, v in rows:
        if asks(i):
            score = kmeans_tree.cosines(np.array([v], float), np.array([w for _, w in rows], float))[0]
            order = np.lexsort((ids, -score))
            found[i] = [(int(ids[o]), float(score[o])) for o in order if ids[o] != i][:k]
    return found


def search(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, leaf string")
    return kmeans_tree.nearest_vectors(table, F.col("vec_id") % 10 == 0, **options)


def test_recall_and_scores_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    got = vector_queries.op6_kmeans_tree(spark, sf).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    true = brute(rows, lambda i: i % 50 == 0)
    hit = total = 0
    for query, nearest in true.items():
        own = got[got["query_id"] == query].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 6))
        pairs = list(zip(own["vec_id"], own["score"]))
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
        hit += len({i for i, _ in nearest} & set(own["vec_id"]))
        total += len(nearest)
        exact = dict(rows)
        for i, s in pairs:
            a, b = np.array(exact[query], float), np.array(exact[i], float)
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    assert hit / total >= 0.93


def test_ties_and_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "CELL", 16)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else rng.normal(size=3).tolist(), "x", "y") for i in range(300)]
    got = search(spark, rows, recall=1.0, calibration=1000).toPandas()
    true = brute([(i, np.array(v, np.float32).tolist()) for i, v, *_ in rows], lambda i: i % 10 == 0)
    for query, nearest in true.items():
        own = got[got["query_id"] == query].sort_values("rank")
        assert list(zip(own["vec_id"], own["score"])) == nearest


def test_odd_vectors_take_no_part(spark):
    good = [(i, [float(i), 1.0], None, None) for i in range(1, 4)]
    odd = [(10, None, None, None), (20, [0.0, 0.0], None, None), (30, [1.0, float("nan")], None, None), (40, [1.0, None], None, None),
           (50, [float("inf"), 1.0], None, None), (60, [], None, None), (None, [1.0, 1.0], None, None), (70, [2.0, 1.0], None, None), (70, [2.0, 1.0], None, None)]
    got = search(spark, good + odd).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(70, 1, 2), (70, 2, 3), (70, 3, 1)]
    assert got[0]["score"] == pytest.approx(1)
    assert search(spark, odd[:6]).count() == 0


def test_vectors_of_another_length_and_repeated_ids(spark):
    rows = [(i, [float(i), 1.0], None, None) for i in range(1, 4)] + [(8, [1.0], None, None), (9, [1.0, 2.0, 3.0], None, None), (70, [3.0], None, None)]
    repeated = [(70, [2.0, 1.0], None, None), (70, [9.0, 1.0], None, None)]
    for order in (rows + repeated, (rows + repeated)[::-1]):
        got = search(spark, order).orderBy("rank").collect()
        assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(70, 1, 2), (70, 2, 3), (70, 3, 1)]
        assert got[0]["score"] == pytest.approx(1)


def test_best_first_visits_every_leaf_once():
    sample = kmeans_tree.unit(np.random.default_rng(0).normal(size=(500, 4)))
    tree = kmeans_tree.Tree(sample, 4, 3)
    leaves = list(tree.best_first(sample[0]))
    assert len(leaves) == len(set(leaves)) == tree.leaves and leaves[0] == tree.leaf(sample[:1])[0]
