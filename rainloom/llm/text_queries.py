"""Queries over the texts of ``documents``: quality, language and language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.llm import byte_cnn, host_rules, quality_knn, tree_lm
from rainloom.llm.registry import query
from rainloom.llm.textblocks import crc_fold

SPACES = r"[\x20\x09-\x0D]+"

OP7_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs WHERE len(words) >= 5)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(0, 5) AS steps(k) GROUP BY doc_id
), facts AS (
  SELECT d.doc_id, d.source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN covered c USING (doc_id)
), ruled AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
     OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS failed
  FROM facts
), hosts AS (
  SELECT source, count(*) AS n, sum(failed::INT) AS k FROM ruled GROUP BY source
), prior AS (
  SELECT sum(k) / sum(n) AS m, var_pop(k / n) AS v FROM hosts
), strength AS (
  SELECT m, CASE WHEN v > 0 THEN greatest({host_rules.WEAKEST}, least({host_rules.STRONGEST}, m * (1 - m) / v - 1)) ELSE {host_rules.STRONGEST} END AS s FROM prior
), verdicts AS (
  SELECT source, round((k + m * s) / (n + s), 9) AS host_rate FROM hosts, strength
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT failed AND host_rate <= {host_rules.HOST_LIMIT} AS kept, host_rate, host_rate > {host_rules.HOST_LIMIT} AS host_failed
FROM ruled r JOIN verdicts v ON r.source IS NOT DISTINCT FROM v.source
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(OP7_SQL)
def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    facts = host_rules.measured(docs).drop("text")
    judged = host_rules.judged(facts, "source")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "host_failed")


@query()
def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_knn.fit(quality_knn.labelled_sample(docs, labels, "quality", crc_fold("doc_id", 5) != 0))
    held = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return quality_knn.quality_scores(docs, model, ["doc_id"]).select("doc_id", held, "score", "predicted")


@query()
def op3_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_fold("doc_id", 5) == 1, F.lit(False))
    scored = tree_lm.language_scores(docs.withColumn("held_out", held), docs.where(crc_fold("doc_id", 5) != 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query()
def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = byte_cnn.fit(docs.where(crc_fold("doc_id", 4) != 2).select(F.col("doc_id").alias("key"), "lang", "text"))
    held = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    return byte_cnn.predicted(docs.select("doc_id", held.alias("held_out"), "text"), network)
