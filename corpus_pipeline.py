"""The corpus pipeline: rules, quality, near duplicates, mixing and encoding, one stage after another.

Only the five columns of ``documents`` are read, whatever else a table carries. A null text counts
as an empty one, which the rules reject; a null source is one host. Rows repeated with one doc_id
are near duplicates of each other, so one of them stays. Texts of any length are read whole. Each
stage gives an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.llm import banded_join, host_rules, piece_codec, quality_knn, soft_mix
from rainloom.llm.textblocks import crc_fold
from rainloom.session import materialize

#: The stages before leave hardly any text of the third domain, so two have a target here.
TARGETS = {"clean": 0.95, "toxic": 0.05}
#: A limit on repetition: without one, a few short documents are repeated hundreds of times for a domain that has hardly any text.
MOST_RATE = 4.0
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule and whose host isn't rejected."""
    return host_rules.host_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def pass_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote calls good.

    The labelled texts come from the whole ``documents`` table: examples of poor texts are
    mostly gone from the stage's input.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_knn.fit(quality_knn.labelled_sample(every, labels, "quality", crc_fold("doc_id", 5) != 0))
    scored = quality_knn.quality_scores(docs, model, COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return banded_join.one_per_group(docs.select(*COLUMNS))


def to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates for the target weights say, ``MOST_RATE`` times on average at most.

    Examples come from the whole ``documents`` table, as in ``pass_quality``.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = soft_mix.fit(soft_mix.labelled_domains(every, labels), [*TARGETS])
    return soft_mix.mixed(docs.select(*COLUMNS), model, TARGETS, MOST_RATE)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_codec.encode_texts(docs.select(*COLUMNS), path).drop("text")
    decoded = piece_codec.decode_ids(encoded, path)
    return decoded.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
        piece_codec.id_digest().alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", pass_rules),
    ("quality classifier", pass_quality),
    ("n-gram Jaccard join", one_of_each),
    ("mixing to target weights", to_targets),
    ("piece encoding and decoding", to_ids),
]

#: No SQL states the fitted models or the encoding; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
