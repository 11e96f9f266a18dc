"""Several formulations of a question and several kinds of search, put together by places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.operators.ordered import newest

# Fusion constant, weights, depths.
RRF_K, VARIANT_WEIGHT, SEMANTIC_WEIGHT, DEPTH, MAX_FORMULATIONS = 60, 0.7, 0.6, 50, 8


def distinct_formulations(texts: Column, most: int = MAX_FORMULATIONS) -> Column:
    """Distinct non-blank texts in order, trimmed, at most eight."""
    return F.slice(F.filter(F.transform(F.array_distinct(texts), F.trim), lambda x: x != ""), 1, most)


def formulation_terms(terms: Column, others: Column) -> Column:
    """Terms with those of a later formulation put behind if they are new."""
    return F.concat(terms, F.array_except(others, terms))


def rrf_fuse(lists: DataFrame, key: list[str], limit: int) -> DataFrame:
    """lists: question_id, formulation (0 first), semantic, place, key…  → best ``limit`` keys per question."""
    weight = (F.when(F.col("formulation") == 0, 1.0).otherwise(VARIANT_WEIGHT)
              * F.when(F.col("semantic"), SEMANTIC_WEIGHT).otherwise(1.0))
    fused = lists.groupBy("question_id", *key).agg(
        F.round(F.sum(weight / (RRF_K + F.col("place"))), 9).alias("score"),
        F.min(F.struct("formulation", "semantic", "place")).alias("seen"))
    return newest(fused, ["question_id"], limit, F.col("score").desc(), F.col("seen"), *[F.col(k) for k in key]).drop("seen")


def hybrid_lists(lexical: DataFrame, semantic: DataFrame | None, key: list[str]) -> tuple[DataFrame, str]:
    """Both kinds of lists in one table, and a note when there is no semantic one."""
    cols = ["question_id", "formulation", "semantic", "place", *key]
    words = lexical.filter(F.col("place") <= DEPTH).withColumn("semantic", F.lit(False)).select(*cols)
    if semantic is None:
        return words, "semantic search is not available: there are no vectors"
    return words.unionByName(semantic.filter(F.col("place") <= DEPTH).withColumn("semantic", F.lit(True)).select(*cols)), ""
