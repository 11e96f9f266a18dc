"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.llm import ann, embedding_dedup
from deskmill.llm.registry import query


@query("op5_ann")
def op5(t):
    return ann.nearest(t.embeddings, F.col("vec_id") % 20 == 0, top=20)


OP10_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), counts AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
), roots AS (
  SELECT a, min(b) AS root FROM reach GROUP BY a
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.root AS component_id, e.vec_id = r.root AS kept
FROM embeddings e JOIN roots r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""


@query("op10_embedding_dedup", OP10_SQL)
def op10(t):
    return embedding_dedup.near_vectors(t.embeddings).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
