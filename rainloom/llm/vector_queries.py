"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.llm import ball_kmeans, kmeans_tree
from rainloom.llm.registry import query


@query()
def op6_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return kmeans_tree.nearest_vectors(vectors, F.col("vec_id") % 50 == 0)


def _ball_sql() -> str:
    """Plain k-means over all entries, one set of CTEs per round."""
    parts, entries, scale = ball_kmeans.PARTS, ball_kmeans.ENTRIES, ball_kmeans.SCALE
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(p)
), book0 AS MATERIALIZED (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cut) WHERE e < {entries}
)"""]
    for r in range(ball_kmeans.ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT c.vec_id, c.label, c.p, c.x, b.e, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM cut c JOIN book{r} b ON c.p = b.p) GROUP BY ALL
)""")
        if r < ball_kmeans.ROUNDS:
            steps.append(f"""means{r} AS (
  SELECT p, e, i, sum(y) AS total, count(*) AS n FROM (
    SELECT p, best.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM near{r}) GROUP BY p, e, i
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT p, e, list(CASE WHEN total >= 0 THEN total // n ELSE -((-total + n - 1) // n) END::BIGINT ORDER BY i) AS x FROM means{r} GROUP BY p, e
  ) m ON b.p = m.p AND b.e = m.e
)""")
    last = ball_kmeans.ROUNDS
    return ", ".join(steps) + f""", digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last}
), coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{last} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""


@query(_ball_sql())
def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.code_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
