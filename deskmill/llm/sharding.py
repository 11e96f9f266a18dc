"""Sharding by a two-pass external shuffle: scatter into buckets that fit in memory, then Fisher-Yates in each.

Pass one counts rows and bytes and from them sets the number of buckets. Pass two scatters the rows by a seeded
hash, gathers each bucket, brings it into a fixed order and shuffles it with Spark's array shuffle (Fisher-Yates, seeded).
Buckets follow each other in the output; their sizes alone fix where each starts, so every row gets its place, and
shards are equal stretches of places. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 8 << 20
GROUP = 1024  # buckets whose sizes are summed by one task


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
               bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` in random order with bucket, place (gapless from 0 over all rows), shard and slot (gapless from 0 per shard).

    Row counts of shards differ by one at most. Rows are scattered by id and text, so equal texts of different ids
    part; rows equal in both share a bucket. Nulls are hashed like values; a null text counts as empty. An empty table
    stays empty. Other columns are kept; ones named like an added column are replaced.
    """
    added = ("bucket", "place", "shard", "slot")
    kept = [c for c in docs.columns if c not in added]
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1
    rows, total = docs.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(buckets))

    counts = docs.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("group", earlier(Window.orderBy("group")).alias("outer"))
    inner = counts.select("group", "bucket", earlier(Window.partitionBy("group").orderBy("bucket")).alias("inner"))
    starts = inner.join(groups, "group").select("bucket", (F.col("outer") + F.col("inner")).alias("start"))

    row = F.struct(F.col(id_col).alias("_a"), F.col(text_col).alias("_b"), F.struct(*kept).alias("row"))
    full = docs.select(bucket.alias("bucket"), row.alias("r")).groupBy("bucket").agg(F.collect_list("r").alias("rows"))
    # the fixed orders of buckets in a task and of rows in a bucket make the seeded shuffle the same when a lost task runs again
    full = full.sortWithinPartitions("bucket")
    ordered = F.array_sort("rows", lambda x, y: F.when(F.coalesce(x["_a"] < y["_a"], x["_a"].isNull() & y["_a"].isNotNull()), -1)
                           .when(F.coalesce(x["_a"] > y["_a"], x["_a"].isNotNull() & y["_a"].isNull()), 1)
                           .when(F.coalesce(x["_b"] < y["_b"], x["_b"].isNull() & y["_b"].isNotNull()), -1)
                           .when(F.coalesce(x["_b"] > y["_b"], x["_b"].isNotNull() & y["_b"].isNull()), 1).otherwise(0))
    mixed = full.select("bucket", F.posexplode(F.shuffle(ordered, seed)).alias("at", "r"))
    placed = mixed.join(starts, "bucket").select("r.row.*", "bucket", (F.col("start") + F.col("at")).alias("place"))
    shard = F.expr(f"(place * {shards} + {shards - 1}) div {max(rows, 1)}").cast("int")
    return placed.withColumn("shard", shard).withColumn(
        "slot", F.expr(f"place - (shard * {rows}L) div {shards}"))
