"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.session import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over rows (u, v) with u > v; both keep the components."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionAll(lowest.where("m < u").select("u", F.col("m").alias("v"))).distinct())
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    return (large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(lowest.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    Alternating stars: each round hangs neighbours on smaller nodes until every component is one star, which
    takes a number of rounds that grows with the logarithm of the longest path. Every round is written to the
    shared folder, so lineage stays short and a lost executor costs tasks of one round only. Loops and repeated
    edges are allowed; null ends are ignored; no edges give an empty table.
    """
    now = (edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
           .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    now, before = materialise(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == before:
            break
        before = mark
        now = materialise(_stars(now), "stars")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
