import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rainloom.llm import byte_cnn, host_rules, quality_knn, text_queries, textblocks, tree_lm
from tests.llm.helpers import ROWS, SF, documents, fold, odd_documents, words


def brute_rules(text):
    found = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    n = len(found)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_rules_equal_brute_force(spark, table):
    docs = odd_documents(spark) if table == "odd" else documents(spark)
    rows = host_rules.host_rules(docs).collect()
    assert len(rows) == docs.count()
    for row in rows:
        got = tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == brute_rules(row["text"])
        assert not (row["kept"] and row["base_failed"])


def test_a_host_of_failures_takes_its_clean_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "spam " * 40, "bad") for i in range(60)] + [(100, good, "bad")] + [(200 + i, f"{good} {i}", f"h{i % 7}") for i in range(140)]
    got = {r["doc_id"]: r for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[100]["host_failed"] and not got[100]["kept"] and not got[100]["base_failed"]
    assert all(got[200 + i]["kept"] for i in range(140))
    assert 0.5 < got[0]["host_rate"] < 1


def test_rules_of_an_empty_table(spark):
    assert host_rules.host_rules(odd_documents(spark).limit(0)).count() == 0


def test_rules_run_without_python(spark):
    plan = text_queries.op7_host_rules(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = text_queries.op1_quality_knn(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = scored.join(labels, "doc_id").toPandas()
    order = got["score"].rank()
    good = got["quality"] == 1
    auc = (order[good].mean() - (good.sum() + 1) / 2) / (~good).sum()
    assert auc > 0.98
    assert ((got["predicted"] == 1) == good).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (1, None), (77, 1), (None, 1)], "doc_id long, quality int")
    docs = odd_documents(spark)
    model = quality_knn.fit(quality_knn.labelled_sample(docs, labels, "quality", F.lit(True)))
    assert len(model.labels) == 4  # a repeated row counts twice
    rows = quality_knn.quality_scores(docs, model, ["doc_id", "text", "score"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    empty = quality_knn.fit(quality_knn.labelled_sample(docs, labels.limit(0), "quality", F.lit(True)))
    assert {r["score"] for r in quality_knn.quality_scores(docs, empty, ["doc_id"]).collect()} == {0.5}
    assert quality_knn.quality_scores(docs.limit(0), model, ["doc_id"]).count() == 0


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    terms = rng.random((120, quality_knn.BUCKETS + quality_knn.MEASURES * quality_knn.BINS)).astype(np.float32)
    model = quality_knn.Model(terms[:80], rng.integers(0, 2, 80).astype(float))
    for row, got in zip(model.project(terms), model.scores(terms)):
        cosines = model.vectors @ row
        near = np.argsort(-cosines)[: quality_knn.NEIGHBOURS]
        weight = np.clip(cosines[near], 1e-6, None).astype(float) ** quality_knn.POWER
        yes, no = weight @ model.labels[near], weight @ (1 - model.labels[near]) * model.against
        assert got == pytest.approx(yes / (yes + no), abs=1e-4)


def brute_base(rows, held):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tokens = {k: [*words((t or "").translate(low)), None] for k, t in rows}
    count = Counter(w for k, ws in tokens.items() if k not in held for w in ws)
    n, v = sum(count.values()), len(count)
    return n, {k: (len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for k, ws in tokens.items()}


@pytest.mark.parametrize("common", [50, tree_lm.COMMON])
def test_word_scores_equal_brute_force(spark, common):
    docs = documents(spark).select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {k for k, _ in rows if fold(k, 5) == 1}
    total, expected = brute_base(rows, held)
    got = tree_lm.language_scores(docs, docs.where(textblocks.crc_fold("doc_id", 5) != 1), common).collect()
    for row in got:
        n, known, base = expected[row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, total)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)


def brute_tree(code, texts):
    """Recursive context-tree weighting of one text's every decision, straight from its definition."""
    frame = lambda t: [tree_lm.END] * tree_lm.DEPTH + [int(tree_lm.FOLD[b]) for b in t.encode()] + [tree_lm.END]
    counts = {}
    for text in texts:
        f = frame(text)
        for i in range(tree_lm.DEPTH, len(f)):
            near = tuple(int(code.class_of[b]) for b in f[i - tree_lm.DEPTH : i])[::-1]
            s = int(code.class_of[f[i]])
            for level in range(code.length[s]):
                for d in range(tree_lm.DEPTH + 1):
                    at = counts.setdefault((near[:d], int(code.node[s, level])), [0, 0])
                    at[code.bit[s, level]] += 1
    own = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[:-1], node), []).append(context)

    def weighted(context, node):
        e = own(*counts[context, node])
        if len(context) == tree_lm.DEPTH:
            return e
        return float(np.logaddexp(e, sum(weighted(c, node) for c in children.get((context, node), [])))) - math.log(2)

    def one(near, node, d=0):
        a, b = counts.get((near[:d], node), (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == tree_lm.DEPTH or (near[: d + 1], node) not in counts:
            return estimate
        stop = math.exp(own(a, b) - math.log(2) - weighted(near[:d], node))
        return stop * estimate + (1 - stop) * one(near, node, d + 1)

    def score(text):
        f, total = frame(text), 0.0
        for i in range(tree_lm.DEPTH, len(f)):
            near = tuple(int(code.class_of[b]) for b in f[i - tree_lm.DEPTH : i])[::-1]
            s = int(code.class_of[f[i]])
            for level in range(code.length[s]):
                p = one(near, int(code.node[s, level]))
                total += math.log10(p if code.bit[s, level] else 1 - p)
        return total

    return score


def test_tree_scores_equal_the_definition(spark):
    texts = ["abracadabra abra", "banana band", "the cat\nthe hat", ""]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    score = brute_tree(tree_lm.class_code(train), texts)
    asked = ["abra banana", "the band", "", "cat"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    for row in tree_lm.language_scores(rows, train).collect():
        assert row["score"] == pytest.approx(score(asked[row["doc_id"]]), abs=1e-3)


@pytest.mark.parametrize("contexts", [1, 300])
def test_contexts_beyond_the_broadcast_count_in_full(spark, contexts, monkeypatch):
    """Scores are those of all counted contexts, however few of them are broadcast."""
    monkeypatch.setattr(tree_lm, "STEP", 400)
    docs = documents(spark).limit(40)
    train = docs.where(textblocks.crc_fold("doc_id", 5) != 1)
    rows = docs.unionByName(odd_documents(spark).select(docs.columns))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["bits_per_byte"])
    expected = sorted(tree_lm.language_scores(rows, train, contexts=1 << 20).collect(), key=key)
    got = sorted(tree_lm.language_scores(rows, train, contexts=contexts).collect(), key=key)
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in expected]
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in expected], rel=1e-6)


@pytest.mark.parametrize("frequent", [0, 500, 1 << 20])
def test_grams_beyond_the_broadcast_count_in_full(spark, frequent):
    """Scores are those of all counted grams, however few of them are broadcast."""
    docs = documents(spark).limit(40)
    train = docs.where(textblocks.crc_fold("doc_id", 5) != 1)
    rows = docs.unionByName(odd_documents(spark).select(docs.columns))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["bits_per_byte"])
    expected = sorted(tree_lm.language_scores(rows, train, contexts=1 << 20).collect(), key=key)
    got = sorted(tree_lm.language_scores(rows, train, contexts=50, frequent=frequent).collect(), key=key)
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in expected]
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in expected], rel=1e-6)


def test_scored_rows_take_a_fraction_of_the_text(spark, monkeypatch):
    """What follows contexts that aren't broadcast isn't written down for every place it is met at."""
    written = {}

    def materialize(df, label, keep=tree_lm.materialize):
        kept = keep(df, label)
        written[label] = sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in kept.inputFiles())
        return kept

    monkeypatch.setattr(tree_lm, "materialize", materialize)
    docs = documents(spark).select("doc_id", "text")
    tree_lm.language_scores(docs, docs.where(textblocks.crc_fold("doc_id", 5) != 1), contexts=300).count()
    assert written["scored"] < 0.4 * docs.agg(F.sum(F.octet_length("text"))).first()[0]


@pytest.mark.parametrize("buckets", [1, 7])
def test_training_counts_equal_brute_force(spark, buckets, monkeypatch):
    monkeypatch.setattr(tree_lm, "HELD", 3000)
    monkeypatch.setattr(tree_lm, "DIFFERENT", 1000)
    monkeypatch.setattr(tree_lm, "TEXT", 4096)
    docs = documents(spark).select("text").limit(30).unionByName(odd_documents(spark).select("text"))
    class_of, expected = tree_lm.class_code(docs).class_of, Counter()
    for (text,) in docs.collect():
        f = [tree_lm.END] * tree_lm.DEPTH + [int(tree_lm.FOLD[b]) for b in (text or "").encode()] + [tree_lm.END]
        for i in range(tree_lm.DEPTH, len(f)):
            code = sum(int(class_of[f[i - k]]) * tree_lm.CLASSES**k for k in range(tree_lm.DEPTH + 1))
            expected[tree_lm.GRAMS, code] += 1
            if class_of[f[i]] == tree_lm.SHARED:
                expected[tree_lm.BYTES, code // tree_lm.CLASSES % tree_lm.CLASSES**2 * 256 + f[i]] += 1
    rows = tree_lm.training_counts(docs, class_of, buckets).collect()
    assert len({(r["kind"], r["code"]) for r in rows}) == len(rows)
    assert {(r["kind"], r["code"]): r["n"] for r in rows if r["kind"] != tree_lm.WORDS} == expected
    n_words = sum(len(words(text)) + 1 for (text,) in docs.collect())
    assert sum(r["n"] for r in rows if r["kind"] == tree_lm.WORDS) == n_words


def test_tree_probabilities_add_up_to_one(spark):
    docs = documents(spark)
    code = tree_lm.class_code(docs)
    model = tree_lm.TreeModel(code, tree_lm.training_counts(docs, code.class_of), contexts=500).open()
    assert len(model.logs) <= 1 + tree_lm.CLASSES + 500
    assert np.allclose((10.0 ** model.logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert np.allclose((10.0 ** model.bytes.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_trees_of_one_ending_are_worked_out_in_several_steps(spark, monkeypatch):
    """A frequent ending of two classes isn't one group; the model is the same however the steps fall."""
    docs = documents(spark)
    code = tree_lm.class_code(docs)
    counts = tree_lm.training_counts(docs, code.class_of)
    whole = tree_lm.TreeModel(code, counts)
    monkeypatch.setattr(tree_lm, "STEP", 100)
    grams = counts.where(F.col("kind") == tree_lm.GRAMS).select("code", "n").toPandas()
    low = grams["code"] // tree_lm.CLASSES % tree_lm.CLASSES**2
    hot = grams[low == low.mode()[0]]
    steps = tree_lm.context_trees(code, spark.createDataFrame(hot, "code long, n long"), 1).where("depth = 2")
    assert steps.count() > steps.select("code").distinct().count()
    cut = tree_lm.TreeModel(code, counts)
    assert (cut.codes == whole.codes).all() and (cut.two == whole.two).all() and (cut.below == whole.below).all()


def test_language_scores_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = tree_lm.language_scores(docs, docs).collect()
    assert len(rows) == len(ROWS) and all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[2]["score"] == by[3]["score"]
    assert by[6]["bits_per_byte"] < 0.1
    assert tree_lm.language_scores(docs.limit(0), docs).count() == 0
    untrained = tree_lm.language_scores(docs, docs.limit(0)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in untrained)


def test_inner_names_may_be_those_of_columns(spark):
    names = ["_text", "_words", "_lines", "_hashes", "_windows", "_sorted", "_host", "_row", "_known", "_log", "_bytes", "_rare", "_open",
             "_more", "_log_more", "_deep", "_lettered", "word", "n", "Score"]
    plain = odd_documents(spark).select("doc_id", "text", "source")
    docs = plain.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in names])
    model = quality_knn.fit(plain.select(F.xxhash64("doc_id").alias("key"), F.lit(1).alias("label"), "text"))
    network = byte_cnn.fit(odd_documents(spark).selectExpr("doc_id key", "lang", "text"))
    results = [
        (lambda d: host_rules.host_rules(d), "kept"),
        (lambda d: quality_knn.quality_scores(d, model, [c for c in d.columns if c != "text"]), "predicted"),
        (lambda d: tree_lm.language_scores(d, plain), "n_known"),
        (lambda d: byte_cnn.predicted(d, network), "lang_pred"),
    ]
    for run, column in results:
        got, alone = run(docs), run(plain)
        kept = [c for c in names if c in got.columns]
        assert set(names) - set(kept) <= {"Score"}
        rows = got.collect()
        assert all(r[c] == (None if r["doc_id"] is None else f"{c} {r['doc_id']}") for r in rows for c in kept)
        assert sorted((r["doc_id"] or -1, str(r[column])) for r in rows) == sorted((r["doc_id"] or -1, str(r[column])) for r in alone.collect())


def test_languages_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = text_queries.op8_byte_cnn(spark, sf).where("held_out").join(documents(spark, sf).select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97


def test_languages_of_odd_rows(spark):
    network = byte_cnn.fit(odd_documents(spark).selectExpr("doc_id key", "lang", "text"))
    rows = {r["doc_id"]: r for r in byte_cnn.predicted(odd_documents(spark), network).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (2, 3, 4))
    assert all(rows[k]["lang_pred"] in ("en", "fr") and 0 <= rows[k]["score"] <= 1 for k in (1, 5, 6, 7, 8, 10))
    assert byte_cnn.predicted(odd_documents(spark).limit(0), network).count() == 0
    assert byte_cnn.fit(odd_documents(spark).selectExpr("doc_id key", "cast(null as string) lang", "text")) is None
    assert {r["lang_pred"] for r in byte_cnn.predicted(odd_documents(spark), None).collect()} == {"und"}


def test_windows_cover_whole_texts():
    text = "ab" * 700
    rows, firsts = byte_cnn.windows(*textblocks.flat(pa.array([text, "", None, "É"])))
    assert firsts.tolist() == [0, 6, 7, 8, 9]
    assert rows[:6].tobytes().decode().rstrip() == text and rows[8].tobytes().decode().rstrip() == "é"


def test_responses_equal_a_direct_convolution():
    network = byte_cnn.Network(["a", "b"])
    network.tabulate()
    rows = np.random.default_rng(1).integers(0, 256, (3, byte_cnn.WINDOW)).astype(np.uint8)
    vectors = network.weights["bytes"][rows]
    for width in byte_cnn.WIDTHS:
        direct = np.stack([vectors[:, i : i + width].reshape(3, -1) @ network.weights[f"filter{width}"] for i in range(byte_cnn.WINDOW - width + 1)], axis=1)
        assert np.allclose(network.responses(rows, width), direct, atol=1e-4)
