import public_tokenizers
import sentencepiece

import corpus_pipeline
from rainloom.llm import host_rules
from rainloom.session import materialize
from tests.llm.helpers import documents, odd_documents
from tests.llm.test_corpus import brute_links
from tests.llm.test_text_scores import brute_rules

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs, seen = documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, SF), "stage")
        seen[name] = before, docs.collect()
        if stage is not corpus_pipeline.to_ids:
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = seen["quality rules"]
    good = {r["doc_id"] for r in before if not brute_rules(r["text"])[-1]}
    assert {r["doc_id"] for r in after} <= good and len(after) > 0.9 * len(good)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["quality classifier"]
    kept = {r["doc_id"] for r in after}
    clean = [r["doc_id"] for r in before if r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 1]
    assert sum(k in kept for k in clean) >= 0.97 * len(clean)
    before, after = seen["n-gram Jaccard join"]
    _, label = brute_links([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({v for v in label.values()})
    before, after = seen["mixing to target weights"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    share = sum(labels[r["doc_id"]]["toxic"] for r in after if r["doc_id"] in labels) / max(1, sum(r["doc_id"] in labels for r in after))
    assert share < 0.12
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in seen["piece encoding and decoding"][0]}
    for row in seen["piece encoding and decoding"][1]:
        assert row["ids"] == model.encode(texts[row["doc_id"]])


def test_stages_take_odd_rows_and_empty_tables(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SF).collect()
            assert len(got) <= 4 * docs.count()


def test_rules_stage_keeps_what_the_operator_keeps(spark):
    docs = documents(spark, SF)
    kept = {r["doc_id"] for r in host_rules.host_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.pass_rules(spark, docs, SF).collect()} == kept
