"""Queries that find something in the texts of ``documents``: phrases and personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.llm import personal_patterns, phrase_mining, span_crf
from rainloom.llm.registry import query
from rainloom.llm.text_queries import table

OP13_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM worded, range(1, {phrase_mining.LONGEST + 1}) AS t(size) WHERE len(words) >= size)
), counts AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= {phrase_mining.LEAST}
), cuts AS (
  SELECT lang, size, phrase, f AS a, w, unnest(range(1, size)) AS k FROM counts WHERE size >= 2
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), spans AS (
  SELECT lang, size, f, w, m, unnest(range(1, size - m + 2)) AS s FROM counts, range(2, {phrase_mining.LONGEST}) AS t(m) WHERE m < size
), covered AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(f) AS longer FROM spans GROUP BY ALL
), left_over AS (
  SELECT w.* FROM weakest w LEFT JOIN covered c ON w.lang = c.lang AND w.phrase = c.phrase WHERE c.longer IS NULL OR 100 * c.longer < 100 * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM left_over QUALIFY rank <= {phrase_mining.FIRST}
"""


@query(OP13_SQL)
def op13_quotient_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query()
def op11_span_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = span_crf.personal_spans(docs, span_crf.fit(docs))
    base = F.filter("personal", lambda s: s["base"])
    of = lambda kind, spans: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[of(kind, base).alias(f"n_{kind}") for kind in personal_patterns.BASE_KINDS],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("personal")).alias("spans"),
        F.size(F.filter("personal", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
