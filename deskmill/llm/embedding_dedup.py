"""Near-duplicate embeddings by Euclidean p-stable hashing.

A unit vector's quantised random projections, ``hashes`` at a time, are its bucket in each of ``tables`` tables. Vectors with a
cosine of 0.98 lie at a distance of 0.2, where the given numbers let a pair meet in some table with a chance of
0.9999, and more when they are nearer. Pairs that meet are checked by their cosine in double precision. Equal vectors are
one entry with a count. A crowded bucket is cut into blocks of ``block`` entries that are compared block by block, as matrix
products; a pair counts in the first table where it meets. Tasks return a count per vector and a spanning forest
of the links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.graph import components
from deskmill.llm.vector_rows import lists, matrix, usable
from deskmill.session import materialise

TABLES = 32
HASHES = 8
WIDTH = 1.0
SEED = 7
BLOCK = 512


def bucket_keys(units: np.ndarray, group: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit key per row and table; rows of different groups have different keys."""
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((units.shape[1], tables * hashes))
    shift = rng.uniform(0, width, tables * hashes)
    mix = rng.integers(0, 1 << 63, (tables, hashes + 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    cells = np.floor((units @ axes + shift) / width).astype(np.int64).view(np.uint64).reshape(-1, tables, hashes)
    with np.errstate(over="ignore"):
        keys = (cells * mix[:, :hashes]).sum(2, dtype=np.uint64) + group.view(np.uint64)[:, None] * mix[:, hashes]
        keys = (keys ^ (keys >> np.uint64(32))) * mix[:, hashes + 1]
        return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def compare(vectors: np.ndarray, group: np.ndarray, weight: np.ndarray, keys: np.ndarray, part: np.ndarray, table: int,
            cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """New links among rows that met in ``table``: linked weight per row, and the first row of its part of the forest.

    With two parts only pairs across them are looked at. Pairs that share an earlier table's bucket were counted there.
    """
    units = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    same = units @ units.T
    near = np.triu(same >= cosine - 1e-9, 1) & (group[:, None] == group[None, :])
    if part[0] != part[-1]:
        near &= part[:, None] != part[None, :]
    a, b = np.nonzero(near)
    if len(a):
        edge = np.abs(same[a, b] - cosine) <= 1e-9
        exact = (vectors[a[edge]] * vectors[b[edge]]).sum(1) / np.sqrt(
            (vectors[a[edge]] ** 2).sum(1) * (vectors[b[edge]] ** 2).sum(1))
        good = np.ones(len(a), bool)
        good[edge] = exact >= cosine
        good &= ~(keys[a, :table] == keys[b, :table]).any(1)
        a, b = a[good], b[good]
    count = np.bincount(a, weight[b], len(vectors)) + np.bincount(b, weight[a], len(vectors))
    first = np.arange(len(vectors))
    while len(a):
        new = first.copy()
        np.minimum.at(new, a, first[b])
        np.minimum.at(new, b, first[a])
        new = new[new]
        if (new == first).all():
            break
        first = new
    return count.astype(np.int64), first


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = 0.98, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH,
                 block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row: id, n_links, component, kept; only vectors of one label and one length are compared.

    A row without an id, label or usable vector (null, empty, zero, a null or non-finite component) has no links and is its
    own component. Equal vectors link; rows that repeat an id with other vectors are rows of their own. An empty table stays empty.
    """
    frame = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col).alias("g"), F.col(label_col).alias("label"),
                        F.col(vector_col).alias("v"))
    ready = frame.where(usable("v") & F.col("id").isNotNull() & F.col("label").isNotNull())
    # an entry has a number of its own, as an id may stand on rows of unequal vectors; it is fixed once the entries are written
    entries = ready.groupBy("g", "label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn(
        "e", F.monotonically_increasing_id())

    def hash_rows(batches):
        for batch in batches:
            g = batch.column(1).to_numpy().astype(np.int64)
            sizes = batch.column(2).value_lengths().to_numpy()
            keys = np.zeros((len(sizes), tables), np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                v = matrix(batch.column(2).take(pa.array(at)), size)
                top = np.abs(v).max(1)[:, None]
                units = v / top
                units /= np.sqrt((units * units).sum(1))[:, None]
                keys[at] = bucket_keys(units, g[at] * 31 + size, tables, hashes, width, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists(keys), *batch.columns[4:]], ["e", "g", "v", "n", "keys", "id", "label"])

    numbers = T.ArrayType(T.LongType())
    shape = T.StructType([T.StructField("e", T.LongType()), T.StructField("g", T.LongType()),
                          T.StructField("v", rows.schema[vector_col].dataType), T.StructField("n", T.LongType()),
                          T.StructField("keys", numbers), T.StructField("id", T.LongType()), T.StructField("label", rows.schema[label_col].dataType)])
    hashed = materialise(entries.select("e", "g", "v", "n", "id", "label").mapInArrow(hash_rows, shape), "hashed")
    met = hashed.select("e", F.posexplode("keys").alias("t", "key"))
    # buckets of one entry drop out while rows are still narrow
    crowds = met.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(
        "t", "key", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    members = met.hint("merge").join(crowds, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("e", "key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("t", "key", "e", F.col("own").alias("part"), F.least("own", "other").alias("i"),
                             F.greatest("own", "other").alias("j"))
    tiles = members.hint("merge").join(hashed, "e").select("t", "key", "i", "j", "part", "e", "g", "n", "v", "keys")
    tiles = tiles.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "part", "e")

    def link_rows(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            ends = _group_ends(table)
            last = ends[-2] if len(ends) > 1 else 0  # the last tile may go on in the next batch
            held = table.slice(last).to_batches()
            yield from _link_tiles(table.slice(0, last), [e for e in ends if e <= last], cosine)
        if held:
            table = pa.Table.from_batches(held)
            yield from _link_tiles(table, _group_ends(table), cosine)

    linked = materialise(tiles.mapInArrow(link_rows, "e long, links long, root long"), "links")
    counts = linked.groupBy("e").agg(F.sum("links").alias("links"))
    roots = components(linked.where("root is not null"), "e", "root")
    # a component is called by its smallest id
    names = roots.join(hashed.select(F.col("e").alias("node"), "id"), "node").groupBy("root").agg(F.min("id").alias("least"))
    told = hashed.join(counts, "e", "left").join(roots.withColumnRenamed("node", "e").join(names, "root"), "e", "left").select(
        "g", "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("least", "id").alias("component"))
    found = ready.join(told, ["g", "label", "v"]).select("id", "n_links", "component")
    others = frame.where(~(usable("v") & F.col("id").isNotNull() & F.col("label").isNotNull()))
    both = found.unionAll(others.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return both.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def _group_ends(table: pa.Table) -> list[int]:
    """Row numbers after which a new tile starts."""
    if not table.num_rows:
        return []
    change = np.zeros(table.num_rows, bool)
    change[-1] = True
    for name in ("t", "key", "i", "j"):
        x = table.column(name).to_numpy()
        change[:-1] |= x[1:] != x[:-1]
    return (np.flatnonzero(change) + 1).tolist()


def _link_tiles(table: pa.Table, ends: list[int], cosine: float):
    if not ends:
        return
    column = {n: table.column(n).to_numpy() for n in ("t", "part", "e", "g", "n")}
    vectors, keys = table.column("v").combine_chunks(), table.column("keys").combine_chunks()
    out: list[tuple] = []
    start = 0
    for end in ends:
        rows = slice(start, end)
        size, tables = len(vectors[start]), len(keys[start])
        v, k = vectors.slice(start, end - start), keys.slice(start, end - start)
        start = end
        if end - rows.start < 2 or len(v.flatten()) != size * len(v):
            same = np.flatnonzero(v.value_lengths().to_numpy() == size)
            if len(same) < 2:
                continue
        count, first = compare(matrix(v, size), column["g"][rows].astype(np.int64), column["n"][rows].astype(np.float64),
                               k.flatten().to_numpy().reshape(-1, tables), column["part"][rows], int(column["t"][rows.start]), cosine)
        hit = np.flatnonzero(count)
        ids = column["e"][rows]
        out += [(int(ids[x]), int(count[x]), int(ids[first[x]]) if first[x] != x else None) for x in hit]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                          pa.array([o[2] for o in out], pa.int64())], ["e", "links", "root"])
