"""Queries that relate, encode, place and weigh the documents of a corpus."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.llm import banded_join, grammar_store, label_shards, piece_codec, soft_mix
from rainloom.llm.registry import query
from rainloom.llm.text_queries import table

PIECES, BYTE_PAIRS = "piece_bpe_32k.model", "byte_bpe_50k.json"


@query()
def op2_grammar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grammar_store.stored_ids(docs, public_tokenizers.path(BYTE_PAIRS), with_ids=False)


@query()
def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    encoded = piece_codec.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return piece_codec.decode_ids(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), piece_codec.id_digest().alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op5_banded_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op9_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards.sharded_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op10_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    examples = soft_mix.labelled_domains(docs, table(spark, sf_dir, "labels"))
    model = soft_mix.fit(examples, [*soft_mix.TARGETS])
    # the text is read again and dropped at once: only lengths and posteriors are kept
    rates = soft_mix.mixed_rates(docs, model, keep_text=False)
    each = [F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(soft_mix.TARGETS)]
    return rates.select("doc_id", "n_tokens", *each, "rate", "copies", "targets", "reached")
