"""Nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and is itself bounded, so every task has it. Its leaves are cut so that they hold about
``LEAF_ROWS`` rows of the table, as long as the sample allows it: the number of leaves grows with the table, not their size.
Every vector is put into its leaf. For a query a priority queue opens the most promising node first; the leaves come out in that
order, and the first ``visits`` of them are searched exactly, in rounds that widen fourfold; only what beats a query's scores so far goes on.
How many that has to be is measured: for a bounded set of queries the true neighbours among all rows are found by brute force, and
visits widen until the leaves visited hold the wanted share of them. A query that finds fewer than it asked for widens its own
visits until it has them or no leaf is left. Leaves and the queries that visit them are cut into blocks and met as matrix products,
so no leaf has to fit a task; a leaf is sent once per block of the queries that visit it, and not at all where none does.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.sampling import bounded_sample
from deskmill.llm.vector_rows import common_length, matrix, usable
from deskmill.session import materialise

SAMPLE, MOST_SAMPLED, ROWS_A_SAMPLE = 20_000, 200_000, 50  # vectors the tree is fitted on: one of 50 rows, within these bounds
BRANCHES = 6
LEAF, LEAST_LEAF = 400, 8  # sampled vectors in a leaf at most; LEAF_ROWS asks for fewer in large tables
LEAF_ROWS = 512  # rows of the table in a leaf
CALIBRATION = 256  # queries that the number of visits is measured on
RECALL = 0.97
FIRST_VISITS, WIDER = 6, 4  # leaves of the first round, and how many times as many in the next; the ``top`` scores found so far bound what later leaves may add
VECTOR_BLOCK = 4096
QUERY_BLOCK = 1024


class Tree:
    """Centres by node; ``children`` of a leaf are empty. Leaves are numbered in order of making."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 3):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(sample, sample.mean(0), branches, leaf, rng)
        self.centre = np.array(self.centres)
        self.half = (self.centre ** 2).sum(1) / 2
        self.below = [self.centre[kids] if kids else None for kids in self.children]

    def _grow(self, rows: np.ndarray, centre: np.ndarray, branches: int, leaf: int, rng) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(rows, branches, rng) if len(rows) > leaf else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(p, p.mean(0), branches, leaf, rng) for p in parts]
        return node

    @staticmethod
    def _split(rows: np.ndarray, branches: int, rng) -> list[np.ndarray]:
        """Lloyd's k-means; fewer parts where vectors coincide."""
        centres = rows[rng.choice(len(rows), min(branches, len(rows)), replace=False)]
        centres = np.unique(centres, axis=0)
        for _ in range(12):
            near = (rows @ centres.T - (centres ** 2).sum(1) / 2).argmax(1)
            centres = np.array([rows[near == i].mean(0) for i in range(len(centres)) if (near == i).any()])
        near = (rows @ centres.T - (centres ** 2).sum(1) / 2).argmax(1)
        return [rows[near == i] for i in range(len(centres)) if (near == i).any()]

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row: the nearest centre, level by level."""
        leaves = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, mine = todo.pop()
            kids = self.children[node]
            if not kids:
                leaves[mine] = self.leaf[node]
                continue
            near = (rows[mine] @ self.below[node].T - self.half[kids]).argmax(1)
            todo += [(kid, mine[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return leaves

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, most promising first: nodes wait in a priority queue by inner product with their centre."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
                continue
            for kid, promise in zip(self.children[node], (self.below[node] @ query).tolist()):
                heapq.heappush(queue, (-promise, kid))


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, top: int, floor: np.ndarray | None = None):
    """(query number, row number, score) of the ``top`` largest inner products per query, ties to smaller ids.

    Scores below a query's ``floor`` are not of interest.
    The matrix product proposes; scores are sums in one fixed order, so that equal vectors score equally.
    """
    rough = queries @ rows.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    keep = min(top, rows.shape[0])
    limit = np.partition(rough, rows.shape[0] - keep, axis=1)[:, rows.shape[0] - keep]
    limit = limit if floor is None else np.maximum(limit, floor)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(limit), limit, 0)))
    q, r = np.nonzero((rough >= (limit - slack)[:, None]) & np.isfinite(rough))
    score = np.empty(len(q))
    for at in range(0, len(q), 65536):
        score[at:at + 65536] = (queries[q[at:at + 65536]] * rows[r[at:at + 65536]]).sum(1)
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    good = rank < top
    return q[good], r[good], score[good]


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def nearest(rows: DataFrame, is_query, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            recall: float = RECALL, sample: int | None = None, leaf: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where ``is_query`` holds, the ``top`` found with the largest inner product.

    Scores are inner products of the original vectors in double precision; a row is not its own candidate. Rows without id
    and vectors that are null, empty, zero, not finite or not of the most common length take no part. With fewer candidates all
    are returned; repeated rows are candidates each; an empty table gives an empty result. ``sample`` and ``leaf`` are vectors
    to fit the tree on and sampled vectors in a leaf; both follow from the number of rows unless given.
    """
    spark = rows.sparkSession
    frame = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    frame = frame.where(usable("v") & F.col("id").isNotNull())
    width = common_length(frame, "v")
    shape = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], shape)
    frame = frame.where(F.size("v") == width)
    total = frame.count()
    sample = sample or min(MOST_SAMPLED, max(SAMPLE, total // ROWS_A_SAMPLE))
    leaf = leaf or max(LEAST_LEAF, min(LEAF, LEAF_ROWS * sample // max(total, sample)))
    drawn = bounded_sample(frame, "id", sample).select("id", "v").toArrow().sort_by("id")
    tree = Tree(matrix(drawn.column("v").combine_chunks(), width), leaf=leaf)
    kind = rows.schema[vector_col].dataType

    def place(batches):
        at = 0  # a row's number in its task: rows of one id have to spread over blocks too
        for batch in batches:
            numbers = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.place(matrix(batch.column(1), width))), numbers],
                                             ["id", "v", "asks", "leaf", "n"])

    placed = materialise(frame.mapInArrow(place, T.StructType([
        T.StructField("id", T.LongType()), T.StructField("v", kind), T.StructField("asks", T.BooleanType()),
        T.StructField("leaf", T.LongType()), T.StructField("n", T.LongType())])), "leaves")

    # how many leaves: the true neighbours of some queries, and where their leaves come in the order of visits
    tried = bounded_sample(placed.where("asks"), "id", CALIBRATION, seed=1).select("id", "v").toArrow()
    if not tried.num_rows:
        return spark.createDataFrame([], shape)
    tried_ids = tried.column("id").to_numpy()
    tried_rows = matrix(tried.column("v").combine_chunks(), width)

    def brute(batches):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                q, r, score = best(tried_rows, tried_ids, matrix(batch.column(1), width), ids, top)
                kept = [np.concatenate(c) for c in zip(kept, (q, ids[r], score, batch.column(2).to_numpy()[r]))]
                order = np.lexsort((kept[1], -kept[2], kept[0]))
                kept = [c[order] for c in kept]
                rank = np.arange(len(order)) - np.searchsorted(kept[0], kept[0], "left")
                kept = [c[rank < top] for c in kept]
        yield pa.RecordBatch.from_arrays([pa.array(tried_ids[kept[0]]), *map(pa.array, kept[1:])],
                                         ["query_id", "vec_id", "score", "leaf"])

    truth = _ranked(placed.select("id", "v", "leaf").mapInArrow(brute, "query_id long, vec_id long, score double, leaf long"), top)
    wanted: dict[int, list[int]] = {}
    for r in truth.select("query_id", "leaf").collect():  # CALIBRATION x top rows
        wanted.setdefault(r.query_id, []).append(r.leaf)
    needed: list[int] = []
    for i, v in zip(tried_ids.tolist(), tried_rows):
        missing = set(wanted.get(i, []))
        for n, found in enumerate(tree.visit(v), 1):
            if not missing:
                break
            if found in missing:
                needed += [n] * wanted[i].count(found)
                missing.remove(found)
    needed.sort()
    visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else tree.leaves

    def visited(queries: DataFrame, start: int, stop: int) -> DataFrame:
        """The queries with the leaves from place ``start`` to before ``stop`` in their order of visits."""

        def ask(batches):
            for batch in batches:
                leaves = [list(islice(tree.visit(v), start, stop)) for v in matrix(batch.column(1), width)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], ["id", "v", "n", "leaves"])

        return queries.select("id", "v", "n").mapInArrow(ask, T.StructType([
            T.StructField("id", T.LongType()), T.StructField("v", kind), T.StructField("n", T.LongType()),
            T.StructField("leaves", T.ArrayType(T.LongType()))]))

    # one row per leaf of the tree, which is bounded
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("int").alias("parts"))
    part = lambda n: F.pmod(F.xxhash64("id", "n"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def meet(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not vectors.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        own, ids = queries.column("id").to_numpy(), vectors.column("id").to_numpy()
        q, r, score = best(matrix(queries.column("v").combine_chunks(), width), own,
                           matrix(vectors.column("v").combine_chunks(), width), ids, top, queries.column("floor").to_numpy())
        return pa.table([pa.array(own[q]), pa.array(ids[r]), pa.array(score)], names)

    def search(queries: DataFrame) -> DataFrame:
        """What the queries find in their leaves; columns id, v, n, leaves, floor."""
        keys = ["leaf", "vb", "qb"]
        going = queries.withColumn("leaf", F.explode("leaves")).drop("leaves")
        askers = going.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("tiles"))
        blocks = F.broadcast(materialise(askers.join(sizes, "leaf"), "blocks"))
        left = going.join(blocks, "leaf").select("leaf", every("parts").alias("vb"), part("tiles").alias("qb"), "id", "v", "floor")
        right = placed.join(blocks, "leaf").select("leaf", part("parts").alias("vb"), every("tiles").alias("qb"), "id", "v")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")

    # rounds of ever more leaves: what a query has found by then is the floor of the next, so a round adds few rows
    asked, start, stop, found = placed.where("asks").select("id", "v", "n"), 0, min(FIRST_VISITS, visits), None
    while True:
        going = materialise(visited(asked, start, stop), "visits")
        if found is None:
            met = search(going.withColumn("floor", F.lit(float("-inf"))))
        else:
            floors = found.where(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
            more = search(going.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
            met = found.drop("rank").unionAll(more)
        found = materialise(_ranked(met, top), "found")
        if stop >= tree.leaves:
            break
        if stop >= visits:  # only those that are short go on
            full = found.where(F.col("rank") == top).select(F.col("query_id").alias("id"))
            asked = materialise(asked.join(full, "id", "left_anti"), "short")
            if asked.isEmpty():
                break
        start, stop = stop, WIDER * stop if stop >= visits else min(WIDER * stop, visits)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
