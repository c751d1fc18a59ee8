import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rainloom.llm import mining_queries, personal_patterns as pp, span_crf
from tests.llm.helpers import SF, documents, odd_documents

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def brute(text):
    found = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and checksum(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                found.append((m.start(), pp.KINDS.index(kind), kind, m.end()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@x.y", ".", "-", " ", "  ", "+", "1", "25", "256", "0300", "4111111111111111", "+1 (017) 555-7713", "(", ")", "é", "\n", "_", "%", "1.2.3.4"]), max_size=14))
def test_base_rules_equal_the_patterns(parts):
    text = "".join(parts)
    assert pp.joined(pp.base_spans(text)) == brute(text)


def test_base_rules_of_the_table(spark):
    rows = mining_queries.op11_span_crf(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    assert len(rows) == len(texts) and sum(r["n_email"] + r["n_card"] for r in rows) > 0
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in RULES] == [want.count(f"{k}:") for k in RULES]
        assert not set(filter(None, want.split(","))) - set(r["spans"].split(","))


def test_sums_and_best_cut_over_all_ways_to_cut():
    rng = np.random.default_rng(1)
    lattice = span_crf.Lattice([("+1 (017) 5-77,", "call")])
    n, kinds = len(lattice.tokens), 2
    start, end, columns = lattice.segments(0, n)
    weights = rng.normal(size=(span_crf.WIDTH, kinds))
    scores = weights[columns].sum(axis=1)
    pairs = list(zip(start.tolist(), end.tolist()))

    def ways(at):
        if at == n:
            yield ()
            return
        yield from ways(at + 1)
        for s, (i, j) in enumerate(pairs):
            if i == at:
                yield from (((s, k), *rest) for rest in ways(j) for k in range(kinds))

    every = list(ways(0))
    value = np.array([sum(scores[s, k] for s, k in w) for w in every])
    chance, total = span_crf.posteriors(n, start, end, scores)
    assert len(every) > 400 and total == pytest.approx(np.logaddexp.reduce(value))
    share = np.exp(value - total)
    for s, k in itertools.product((0, 3, len(pairs) - 1), range(kinds)):
        assert chance[s, k] == pytest.approx(sum(p for w, p in zip(every, share) if (s, k) in w), abs=1e-9)
    assert span_crf.best_cut(lattice, weights, margin=0.0) == [(*pairs[s], k) for s, k in every[int(value.argmax())]]


def test_finds_held_out_spans_and_leaves_numbers_alone(spark):
    table = documents(spark, "/root/testdata/sf0.1")
    model = span_crf.fit(table.where("doc_id % 5 != 0"))
    want, got, clean = set(), set(), 0
    for r in table.where("doc_id % 5 = 0").collect():
        known = {s for s in pp.base_spans(r["text"]) + pp.secrets(r["text"])}
        found = set(model.spans(r["text"]))
        want |= {(r["doc_id"], s) for s in known}
        got |= {(r["doc_id"], s) for s in found}
        clean += not known and bool(found)
    assert len(want & got) > 0.95 * len(want) and len(got - want) < 0.03 * len(got) and clean <= 2


def test_adds_what_the_rules_miss(spark):
    model = span_crf.fit(documents(spark, "/root/testdata/sf0.1"))
    base, added = span_crf.all_spans("52095301374 4550997810720808 and 2669109448945251 or 12 34", model)
    assert base == [] and added == [("card", 12, 28)]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert [k for k, *_ in span_crf.all_spans(f'a token = "{key}" b', model)[1]] == ["secret"]
    assert span_crf.all_spans("page 12 of 300, 3.14 and 1999-2003, 10:30", model) == ([], [])


def test_odd_rows(spark):
    odd = odd_documents(spark)
    got = span_crf.personal_spans(odd.withColumnRenamed("score", "personal"), span_crf.fit(odd))
    assert got.count() == odd.count() and set(got.columns) == {"doc_id", "lang", "source", "n_chars", "personal", "kept", "ids", "shard"}
    assert all(r["personal"] == [] for r in got.collect())
    assert span_crf.personal_spans(odd.limit(0), span_crf.fit(odd.limit(0))).collect() == []


def test_long_texts_take_linear_time():
    model = span_crf.SpanModel()
    model.weights[:] = 0.02
    began = time.time()
    for text in ("x" * 300_000, "1" * 300_000, "a@" * 100_000, "1 " * 60_000, "+1 " * 50_000, "1." * 50_000, "a.b-c" * 40_000 + "@x"):
        span_crf.all_spans(text, model)
    assert time.time() - began < 120
