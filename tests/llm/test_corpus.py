import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rainloom.llm import banded_join, components, corpus_queries, grammar_store, label_shards, piece_codec, soft_mix
from tests.llm.helpers import ROWS, documents, grams, odd_documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
PAIRS = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [
    "", None, " ", "  a  b \n\t x  ", "ﬁ①　x\x00y", "a▁b", "▁b", "a" * 9000, " " * 9000 + "b", "ab" * 3000 + " " * 37, "the" * 4000,
    "日本語 のテキスト 😀👍🏽", "<s> </s> <unk> <0x0A>", "a<|endoftext|> b  <|endoftext|>", "don't I'll 's x's 12.5 a1. b2,", "a \n b", "a\n b", "\n a", "x \x1c y",
]


def random_texts(n=1500):
    rng = random.Random(3)
    return ["".join(rng.choice("aabbeethn  ▁.\n\té😀中 　\x1d,1'") for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_piece_ids_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD_TEXTS + random_texts()
    ids, offsets = piece_codec.pieces(PIECES).encode(texts)
    decoded = piece_codec.pieces(PIECES).decode(ids, offsets)
    for k, text in enumerate(texts):
        expected = model.encode(text or "")
        assert ids[offsets[k] : offsets[k + 1]].tolist() == expected
        assert decoded[k] == model.decode(expected)


def test_piece_ids_after_the_table_starts_anew(monkeypatch):
    monkeypatch.setattr(piece_codec, "MOST_WORDS", 3)
    codec = piece_codec.Pieces(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("one two three four", "five six seven", "one two eight"):
        assert codec.encode([text])[0].tolist() == model.encode(text)


def test_long_and_short_words_merge_alike():
    codec = piece_codec.Pieces(PIECES)
    for text in (" " + "the" * 50, " abab" * 9, " " * 60, " mississippi"):
        symbol, _, size = codec.symbols([text])
        assert codec.merge(symbol, size)[0].tolist() == codec.merge_long(symbol)[0].tolist()


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_piece_query_equals_the_library(spark, table):
    docs = odd_documents(spark) if table == "odd" else documents(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = piece_codec.encode_texts(docs, PIECES)
    rows = piece_codec.decode_ids(encoded, PIECES).withColumn("digest", piece_codec.id_digest()).collect()
    assert len(rows) == docs.count()
    for row in rows:
        ids = model.encode(row["text"] or "")
        assert row["ids"] == ids and row["decoded"] == model.decode(ids)
        assert row["digest"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert piece_codec.decode_ids(piece_codec.encode_texts(docs.limit(0), PIECES), PIECES).count() == 0


def test_byte_pair_ids_equal_the_library():
    tokenizer = Tokenizer.from_file(PAIRS)
    texts = ODD_TEXTS + random_texts()
    ids, offsets = grammar_store.pieces(PAIRS).encode(texts)
    for k, expected in enumerate(tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*expected.ids, 0]


def test_each_word_goes_to_the_library_once(monkeypatch):
    given = []
    library = grammar_store.Pieces.library
    monkeypatch.setattr(grammar_store.Pieces, "library", lambda self, pieces, *more: given.extend(pieces) or library(self, pieces, *more))
    text = "so sonné sonné! sonné!!! sonné.\nRéa Réa; sonné.\nRéa,\nsonné"
    ids, _ = grammar_store.Pieces(PAIRS).encode([text, None, text])
    assert ids.tolist() == [*Tokenizer.from_file(PAIRS).encode(text, add_special_tokens=False).ids, 0, 0] + ids.tolist()[: len(ids) // 2]
    assert len(given) == len(set(given)) and set(given) - {" ", " so"} == {"so", " sonné", "sonné", " Réa", "Réa", "\n", "!", "!!!", ".", ";", ","}


def brute_rounds(texts, first):
    texts, rules = [list(t) for t in texts], []
    while True:
        pairs = Counter(pair for t in texts for pair in zip(t, t[1:]))
        often = sorted((p for p, n in pairs.items() if n >= grammar_store.FREQUENT), key=lambda p: (-pairs[p], p))[: grammar_store.RULES]
        if not often:
            return texts, rules
        cuts = []
        for t in texts:
            i, out = 0, []
            while i < len(t):
                hit = tuple(t[i : i + 2]) in often
                out.append(tuple(t[i : i + 2]) if hit else t[i])
                i += 1 + hit
            cuts.append(out)
        used = sorted({x for t in cuts for x in t if isinstance(x, tuple)})
        number = {pair: first + len(rules) + k for k, pair in enumerate(used)}
        texts, rules = [[number.get(x, x) for x in t] for t in cuts], rules + used


@pytest.mark.parametrize("few", [0, 40, 1 << 17])
def test_grammar_rounds_equal_counting_all_pairs(monkeypatch, few):
    monkeypatch.setattr(grammar_store, "FEW", few)
    monkeypatch.setattr(grammar_store, "SHORT", 3)
    monkeypatch.setattr(grammar_store, "RULES", 5)
    rng = random.Random(few)
    texts = [[rng.choice([1, 1, 1, 2, 3, 4, 5]) for _ in range(rng.choice([0, 1, 2, 60, 300]))] for _ in range(40)]
    offsets = np.cumsum([0, *map(len, texts)])
    ids = np.array([i for t in texts for i in t], np.uint32)
    symbols, starts, rules, lengths = grammar_store.reduce_ids(ids, offsets, 10)
    left, pairs = brute_rounds(texts, 10)
    assert [symbols[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == left and rules.tolist() == [list(p) for p in pairs]
    assert (grammar_store.expand(np.tile(symbols, 9), rules, 10) == np.tile(ids, 9)).all()


@pytest.mark.parametrize("texts", [[[1, 2] * 300], [[5] * 1000, [5] * 7, []], [[]], [[1, 2, 3, 4] * 50, [2, 3] * 50, [0, 0, 0, 0] * 20]])
def test_grammar_round_trip_and_random_access(texts):
    ids = np.array([i for t in texts for i in [*t, 0]], np.uint32)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    symbols, starts, rules, lengths = grammar_store.reduce_ids(ids, offsets, 100)
    assert (grammar_store.expand(symbols, rules, 100) == ids).all()
    for k in range(len(texts)):
        assert (grammar_store.expand(symbols[starts[k] : starts[k + 1]], rules, 100) == ids[offsets[k] : offsets[k + 1]]).all()
    assert len(ids) < 60 or len(symbols) < len(ids) / 3
    assert all(lengths[k] == len(grammar_store.expand(np.array([100 + k]), rules, 100)) for k in range(len(rules)))
    shard = {"first_rule": 100, "symbols": symbols.astype(np.uint32).tobytes(), "rules": rules.astype(np.uint32).tobytes(), "lengths": lengths.astype(np.uint32).tobytes()}
    for low, high in [(0, len(ids)), (len(ids) // 3, len(ids) // 2 + 1), (len(ids) - 1, len(ids))]:
        assert (grammar_store.decode_range(shard, low, high) == ids[low:high]).all()


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    passage = rng.permutation(5000)[:700] + 1
    noise = rng.integers(1, 50_000, 200_000)
    parts = [x for k in range(12) for x in (noise[k * 9000 : (k + 1) * 9000], passage)] + [np.full(3000, 7), noise[108_000:]]
    texts = [np.concatenate((x, [0])) for x in parts]
    ids, offsets = np.concatenate(texts).astype(np.uint32), np.cumsum([0, *map(len, texts)])
    symbols, starts, rules, lengths = grammar_store.reduce_ids(ids, offsets, 50_000)
    assert (grammar_store.expand(symbols, rules, 50_000) == ids).all()
    assert lengths.max() > 64
    pairs = Counter()
    for low, high in zip(starts[:-1], starts[1:]):
        pairs.update(zip(symbols[low : high - 1].tolist(), symbols[low + 1 : high].tolist()))
    assert max(pairs.values()) < grammar_store.FREQUENT


@pytest.mark.parametrize("table", ["odd", "documents"])
@pytest.mark.parametrize("shard_ids", [500, grammar_store.SHARD_IDS])
def test_stored_ids_equal_the_library(spark, table, shard_ids, monkeypatch):
    monkeypatch.setattr(grammar_store, "SHARD_IDS", shard_ids)
    docs = odd_documents(spark) if table == "odd" else documents(spark)
    tokenizer = Tokenizer.from_file(PAIRS)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    got = sorted(grammar_store.stored_ids(docs, PAIRS).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    start = 0
    for expected, row in zip(rows, got):
        ids = [*tokenizer.encode(expected["text"] or "", add_special_tokens=False).ids, 0]
        assert row["ids"] == ids and row["start"] == start and row["n_tokens"] == len(ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_stored_ids_of_an_empty_table(spark):
    assert grammar_store.stored_ids(odd_documents(spark).limit(0), PAIRS).count() == 0


def brute_links(rows):
    sets = [(k, grams(t)) for k, t in rows if k is not None]
    links = {k: set() for k, _ in sets}
    for i, (a, p) in enumerate(sets):
        for b, q in sets[:i]:
            if p and q and 5 * len(p & q) >= 4 * len(p | q):
                links[a].add(b), links[b].add(a)
    label = {}
    for k in sorted(links):
        if k not in label:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = k
                    todo += links[x]
    return links, label


def near_copies(n, seed, changes=3, length=200):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            text[rng.randrange(length)] = f"v{rng.randrange(5000)}"
        out.append(" ".join(text))
    return out


def check_links(spark, rows, **options):
    got = {r["doc_id"]: r for r in banded_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    links, label = brute_links(rows)
    assert {k: r["n_links"] for k, r in got.items() if k is not None} == {k: len(v) for k, v in links.items()}
    assert {k: r["class_id"] for k, r in got.items() if k is not None} == label


def test_links_equal_brute_force_on_the_documents(spark):
    check_links(spark, [(r["doc_id"], r["text"]) for r in documents(spark, "/root/testdata/sf0.001").collect()])


def test_links_of_large_groups_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(banded_join, "BLOCK", 8)
    monkeypatch.setattr(banded_join, "COLUMNS", 64)
    texts = near_copies(40, 1) + near_copies(30, 2, changes=9) + near_copies(1, 1) * 20 + ["", "a b", "a b", None]
    check_links(spark, list(enumerate(texts)))


def test_links_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = banded_join.similar_documents(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert by[9]["class_id"] == 5 and by[5]["n_links"] == by[9]["n_links"] == 1
    assert all(by[k]["n_links"] == 0 for k in (2, 3, 4, 6, 7, 8, None)) and by[None]["class_id"] is None
    kept = banded_join.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert banded_join.similar_documents(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = banded_join.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= banded_join.MOST_HASHES
    with pytest.raises(ValueError):
        banded_join.bands_for(0.01, 0.9999)


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("table", ["odd", "documents", "copies"])
def test_shards_are_even_and_gapless(spark, table):
    copies = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i % 40}") for i in range(2000)], "doc_id long, text string")
    docs = {"odd": odd_documents(spark), "documents": documents(spark, "/root/testdata/sf0.01"), "copies": copies}[table]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = label_shards.sharded_documents(docs).toPandas()
    assert len(got) == docs.count()
    for _, rows in got.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    for key, size, crc in zip(got["doc_id"], got["size"], got["text_crc32"]):
        if key == key:
            raw = (texts[int(key)] or "").encode()
            assert (size, crc) == (len(raw) + 1, zlib.crc32(raw))
    if table != "odd":
        sizes = got.groupby("shard")["size"].sum()
        assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2 * got["size"].max()
    if table == "copies":
        split = got.groupby("text_crc32")["shard"].nunique()
        hot = zlib.crc32(b"same text")
        assert split.drop(hot).mean() < 1.5


def test_cells_join_where_most_of_their_group_is(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([i + 10_000, i % 70, 5, 5]), rng.randint(1, 30)) for i in range(3_000)]
    table = spark.createDataFrame(items, "row long, group long, size long").repartition(5)
    start = dict(table.selectExpr("row", "cast(pmod(xxhash64(row, 3), 16) as int)").collect())
    total, group, of = sum(s for *_, s in items), {r: g for r, g, _ in items}, {}
    for r, g, s in items:
        of.setdefault(g, []).append(r)
    giants = {g for g, rows in of.items() if sum(s for r, h, s in items if h == g) > total / 16}
    assert giants == {5}
    # without a bound every group that isn't a giant goes where most of its rows were
    free = dict(label_shards.propagated(table, slack=1e9).select("row", "shard").collect())
    tight = dict(label_shards.propagated(table).select("row", "shard").collect())
    assert len(free) == len(tight) == len(items)
    for g, rows in of.items():
        counts = [sum(start[r] == k for r in rows) for k in range(16)]
        if g in giants:
            continue
        ends = {free[r] for r in rows}
        assert len(ends) == 1 and counts[ends.pop()] == max(counts)
        assert len({tight[r] for r in rows}) == 1


def test_few_groups_of_equal_texts_are_parted(spark):
    got = corpus_queries.op9_label_shards(spark, "/root/testdata/sf0.1").toPandas()
    parted = got.groupby("text_crc32")["shard"].nunique()
    assert (parted > 1).sum() <= 15
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()


def test_shards_of_an_empty_table(spark):
    assert label_shards.sharded_documents(odd_documents(spark).limit(0)).count() == 0


def test_quotas_are_kept():
    shares = label_shards.accepted_shares([100.0, 100.0, 40.0], {(0, 2): 80.0, (1, 2): 40.0, (2, 0): 30.0}, 90.0)
    into = lambda k, f: sum(v * shares[t] for (s, t), v in f.items() if t == k)
    flows = {(0, 2): 80.0, (1, 2): 40.0, (2, 0): 30.0}
    out = lambda k: sum(v * shares[t] for (s, t), v in flows.items() if s == k)
    assert 40 + into(2, flows) - out(2) <= 90 + 1e-6 and all(0 <= s <= 1 for s in shares)


def test_rates_meet_the_targets(spark):
    got = corpus_queries.op10_soft_mix(spark, "/root/testdata/sf0.01").toPandas()
    tokens = got["n_tokens"] * got["rate"]
    for name, share in soft_mix.TARGETS.items():
        assert (tokens * got[f"p_{name}"]).sum() / got["n_tokens"].sum() == pytest.approx(share, abs=1e-5)
    assert (got["rate"] >= 0).all()
    assert np.allclose(got["reached"][0], got["targets"][0], rtol=1e-4)
    assert (got["copies"] >= np.floor(got["rate"])).all() and (got["copies"] <= np.ceil(got["rate"])).all()


def test_posteriors_on_rows_that_were_not_learned(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = documents(spark, sf).select("doc_id", "text")
    learned = labels.where("doc_id % 2 = 0")
    model = soft_mix.fit(soft_mix.labelled_domains(docs, learned), [*soft_mix.TARGETS])
    names = list(soft_mix.TARGETS)
    got = soft_mix.posteriors(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("posterior", "quality", "toxic").toPandas()
    truth = np.where(got["toxic"] == 1, "toxic", np.where(got["quality"] == 0, "poor", "clean"))
    p = np.array(got["posterior"].tolist())
    assert np.allclose(p.sum(axis=1), 1)
    assert (np.array(names)[p.argmax(axis=1)] == truth).mean() > 0.93


def test_steps_equal_a_direct_solution(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 300)
    tokens = rng.integers(1, 500, 300)
    rows = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p)], "n_tokens long, posterior array<double>")
    targets = np.array([0.6, 0.25, 0.15]) * tokens.sum()
    slopes, reached = soft_mix.solve(rows, targets)
    rate = soft_mix.replayed(p, slopes)
    assert np.allclose((p * (rate * tokens)[:, None]).sum(axis=0), targets, rtol=1e-3) and np.allclose(reached, targets, rtol=1e-3)
    assert (rate >= 0).all() and (rate == 0).any()


def test_a_rare_domain_reaches_its_target(spark):
    """A tenth of the tokens made half of them: a limit on the rates stops short, and shows it."""
    p = np.repeat([[0.99, 0.01], [0.1, 0.9]], [190, 10], axis=0)
    rows = spark.createDataFrame([(100, [float(x) for x in q]) for q in p], "n_tokens long, posterior array<double>")
    targets = np.array([0.5, 0.5]) * 100 * len(p)
    slopes, reached = soft_mix.solve(rows, targets)
    rate = soft_mix.replayed(p, slopes)
    assert np.allclose(reached, targets, rtol=1e-3) and rate.max() > 4 and (rate >= 0).all()
    _, short = soft_mix.solve(rows, targets, most=4.0)
    assert short[1] < 0.5 * targets[1]


def test_all_columns_survive_mixing_and_encoding(spark):
    names = ["rate", "copies", "copy", "_copy", "Reached", "posterior", "_source", "n_tokens"]
    docs = odd_documents(spark).select("doc_id", "text", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in names])
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = soft_mix.fit(soft_mix.labelled_domains(docs, labels), [*soft_mix.TARGETS])
    for got in (soft_mix.mixed(docs, model), piece_codec.encode_texts(docs, PIECES)):
        assert set(docs.columns) <= set(got.columns)
        assert all(r[c] == (None if r["doc_id"] is None else f"{c} {r['doc_id']}") for r in got.collect() for c in names)


def test_mixing_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")
    model = soft_mix.fit(soft_mix.labelled_domains(docs, labels), [*soft_mix.TARGETS])
    rates = soft_mix.mixed_rates(docs, model).collect()
    assert len(rates) == len(ROWS) and all(0 <= r["rate"] < math.inf for r in rates)
    assert soft_mix.mixed(docs, model).columns == docs.columns
    assert soft_mix.mixed(docs.limit(0), model).count() == 0
    untrained = soft_mix.fit(soft_mix.labelled_domains(docs, labels.limit(0)), [*soft_mix.TARGETS])
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in soft_mix.mixed_rates(docs, untrained).collect())
