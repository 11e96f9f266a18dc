"""Ordered per-key computations that split a hot key over many tasks.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here a
key is cut into segments (a time bucket, say). Each segment is worked on by its
own task, one small summary row per segment is carried forward over the key, and
local result and carry are put together. Results are those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.session import materialise


def time_segment(ts: str | Column, seconds: int = 3600) -> Column:
    """Number of the time bucket a row lies in; the usual segment."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(col.cast("timestamp")) / seconds)


def running(df: DataFrame, keys: list[str], order: list[str], segment: Column, *,
            prev: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
            last: dict[str, Column] | None = None, earlier: dict[str, Column] | None = None,
            reverse: bool = False) -> DataFrame:
    """Add running columns in ``order`` within ``keys``; ``segment`` must grow with ``order``.

    prev: the value on the row before (null on the first row)
    sums: the total up to and including the row
    last: the newest non-null value up to and including the row
    earlier: the newest non-null value on the rows before
    reverse: walk from the last row to the first instead
    """
    prev, sums, last, earlier = prev or {}, sums or {}, last or {}, earlier or {}
    kept = {**last, **earlier}
    part = [*keys, "_seg"]
    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]

    src = df.withColumn("_seg", segment)
    for n, c in prev.items():
        src = src.withColumn(f"_v_{n}", F.struct(c.alias("v")))
    for n, c in {**sums, **kept}.items():
        src = src.withColumn(f"_v_{n}", c)

    here = Window.partitionBy(*part).orderBy(*ordering)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = here.rowsBetween(Window.unboundedPreceding, -1)
    local = src.select(
        *df.columns, "_seg", F.lead(F.lit(True)).over(here).isNull().alias("_end"), *[f"_v_{n}" for n in prev],
        *[F.lag(f"_v_{n}").over(here).alias(f"_l_{n}") for n in prev],
        *[F.sum(f"_v_{n}").over(upto).alias(f"_l_{n}") for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_u_{n}") for n in kept],
        *[F.last(f"_v_{n}", ignorenulls=True).over(above).alias(f"_l_{n}") for n in earlier])
    # sorted once and written; the last row of a segment holds what goes on to the next, so nothing is read from the source again
    local = materialise(local, "segments")
    summary = local.filter("_end").select(
        *part, *[F.col(f"_v_{n}").alias(f"_s_{n}") for n in prev], *[F.col(f"_l_{n}").alias(f"_s_{n}") for n in sums],
        *[F.col(f"_u_{n}").alias(f"_s_{n}") for n in kept])
    over = Window.partitionBy(*keys).orderBy(F.col("_seg").desc() if reverse else F.col("_seg").asc())
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *part,
        *[F.lag(f"_s_{n}").over(over).alias(f"_c_{n}") for n in prev],
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in kept])

    joined = local.join(carry, part).withColumns({f"_l_{n}": F.col(f"_u_{n}") for n in last})
    out = [F.col(c) for c in df.columns]
    out += [F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))["v"].alias(n) for n in prev]
    out += [(F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_c_{n}")).alias(n) for n in sums]
    out += [F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in kept]
    return joined.select(*out)


SALTS = 16


def newest(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key, cut three times: in each map task, per key and salt, then per key.

    However many rows a key has, the last step sees at most ``n`` rows of each salt.
    """
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    plain = [f.name for f in df.schema if f.name not in keys and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    first = (df.withColumn("_salt", F.pmod(F.xxhash64(F.lit(SALTS), *plain), F.lit(SALTS)))
             .withColumn(rank, F.row_number().over(salted)).filter(F.col(rank) <= n).drop("_salt", rank))
    whole = Window.partitionBy(*keys).orderBy(*order)
    return first.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def value_at(df: DataFrame, keys: list[str], value: str, position: Column, width: float) -> DataFrame:
    """The value at a 0-based place of the sorted values per key, without sorting a key in one task.

    Values are counted per bucket of ``width``; the bucket that holds the place is found
    on the counts alone, and only that bucket's distinct values are looked at.
    ``position`` is an expression over ``n``, the number of values of the key.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(value) / width))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    target = (counts.withColumn("n", F.sum("_n").over(whole))
              .withColumn("_below", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .withColumn("_pos", position)
              .filter((F.col("_below") <= F.col("_pos")) & (F.col("_pos") < F.col("_below") + F.col("_n")))
              .select(*keys, "_b", "n", "_below", "_pos"))
    inside = (rows.join(target, [*keys, "_b"])
              .groupBy(*keys, "n", "_below", "_pos", value).agg(F.count("*").alias("_n")))
    upto = Window.partitionBy(*keys).orderBy(value)
    return (inside.withColumn("_cum", F.col("_below") + F.sum("_n").over(upto))
            .filter(F.col("_cum") > F.col("_pos"))
            .groupBy(*keys).agg(F.min(value).alias(value), F.first("n").alias("n")))
