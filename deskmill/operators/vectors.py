"""Passage texts, embeddings and exact nearest neighbours."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions.text import camel_words
from deskmill.operators.ordered import newest
from deskmill.session import materialise

# Sizes of the embedded passage.
OBJECT_CHARS, MODULE_CHARS, DOC_CHARS, CODE_CHARS, SHORT_DOC = 1200, 600, 700, 400, 80
BATCH = 32
# rows of the blocks that meet in the search for neighbours
QUESTION_BLOCK, VECTOR_BLOCK = 512, 4096
DISTANCE_DIGITS = 6


def missing_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return chunks.join(vectors.select(key), key, "left_anti")


def orphan_vectors(vectors: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    return vectors.join(chunks.select(key), key, "left_anti")


def passage_text(kind: Column, object_type: Column, object_name: Column, module_kind: Column, sub_name: Column,
                 name: Column, doc: Column, body: Column) -> Column:
    """What of a block is embedded: owner, name in words, description; the start of the code only for short descriptions."""
    def spoken(c):
        return F.array_join(camel_words(c), " ")

    owner = F.trim(F.concat(object_type, F.lit(" "), spoken(object_name)))
    head = F.trim(F.concat(owner, F.lit(". "), module_kind, F.lit(" "), spoken(sub_name)))
    what = F.when(kind == "func", "функция").otherwise("процедура")
    code = F.array_join(F.filter(F.split(body, "\n"), lambda x: ~x.rlike(r"^\s*//")), "\n")
    extra = F.when(F.length(doc) < SHORT_DOC, F.concat(F.lit(" "), F.substring(code, 1, CODE_CHARS))).otherwise("")
    return (F.when(kind == "object", F.substring(F.concat(owner, F.lit(". "), body), 1, OBJECT_CHARS))
            .when(kind == "module", F.concat(head, F.lit(". "), F.substring(body, 1, MODULE_CHARS)))
            .otherwise(F.concat(head, F.lit(". "), what, F.lit(" "), spoken(name), F.lit(". "), F.substring(doc, 1, DOC_CHARS), extra)))


def length_sorted(rows: DataFrame, text: str, partitions: int) -> DataFrame:
    """Texts of like length next to each other, so that batches need little padding."""
    sized = rows.withColumn("_len", F.length(text))
    return sized.repartitionByRange(partitions, "_len").sortWithinPartitions("_len").drop("_len")


def embed(rows: DataFrame, key: list[str], text: str, embedder, batch: int = BATCH) -> DataFrame:
    """(key…, embedding). ``embedder()`` is called once per task and gives a function texts → matrix."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema) + ", embedding array<float>"

    def run(batches):
        model = embedder()
        for part in batches:
            for start in range(0, len(part), batch):
                some = part.iloc[start:start + batch]
                out = some[key].copy()
                out["embedding"] = list(np.asarray(model(list(some[text])), dtype=np.float32))
                yield out

    return rows.select(*key, text).mapInPandas(run, schema)


def letter_embedder():
    """Stand-in model: letter counts in 64 places, scaled to length one."""
    def model(texts):
        out = np.zeros((len(texts), 64), dtype=np.float64)
        for i, t in enumerate(texts):
            codes = np.frombuffer(t.lower().encode("utf-32-le"), dtype=np.uint32)
            out[i] = np.bincount(codes % 64, minlength=64)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return model


def embed_missing(chunks: DataFrame, vectors: DataFrame, key: str, text: str, embedder, partitions: int) -> DataFrame:
    """Vectors of the current chunks: known ones kept, orphans dropped, missing ones computed."""
    fresh = embed(length_sorted(missing_vectors(chunks, vectors, key), text, partitions), [key], text, embedder)
    kept = vectors.select(key, "embedding").join(chunks.select(key), key, "left_semi")
    return kept.withColumn("state", F.lit("kept")).unionByName(fresh.withColumn("state", F.lit("embedded")))


class VectorStore:
    """Vectors under a root that grow range by range of keys. A range counts once its row is in the list of finished ones, so a
    run that was stopped goes on with the ranges that are left; vectors of keys that are gone are struck out, not rewritten."""

    def __init__(self, spark: SparkSession, root: str, key: str, kind: str = "bigint"):
        self.spark, self.root, self.key, self.kind = spark, root.rstrip("/"), key, kind

    def _folders(self, what: str) -> list[str]:
        try:
            rows = self.spark.read.schema("what string, folder string, at int").parquet(f"{self.root}/finished")
            return [r.folder for r in rows.filter(F.col("what") == what).orderBy("at").collect()]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _add(self, what: str, rows: DataFrame) -> None:
        at = len(self._folders("vectors")) + len(self._folders("removed")) + 1
        folder = f"{self.root}/{what}-{uuid.uuid4().hex}"
        rows.withColumn("at", F.lit(at)).write.parquet(folder)
        (self.spark.range(1).select(F.lit(what).alias("what"), F.lit(folder).alias("folder"), F.lit(at).alias("at"))
         .write.mode("append").parquet(f"{self.root}/finished"))

    def read(self) -> DataFrame:
        """(key, embedding) of all finished ranges that were not struck out since."""
        found, struck = self._folders("vectors"), self._folders("removed")
        rows = self.spark.read.schema(f"{self.key} {self.kind}, embedding array<float>, at int").parquet(*found) if found else \
            self.spark.createDataFrame([], f"{self.key} {self.kind}, embedding array<float>, at int")
        if struck:
            last = self.spark.read.schema(f"{self.key} {self.kind}, at int").parquet(*struck).groupBy(self.key).agg(F.max("at").alias("_out"))
            rows = rows.join(last, self.key, "left").filter("_out is null or _out < at")
        return rows.select(self.key, "embedding")

    def refresh(self, chunks: DataFrame, text: str, embedder, ranges: int = 16, partitions: int = 8) -> dict[str, int]:
        """Bring the vectors to the chunks; counts of what was kept, embedded and removed. May be stopped and run again."""
        known = self.read()
        orphans = materialise(orphan_vectors(known, chunks, self.key).select(self.key), "orphans")
        removed = orphans.count()
        if removed:
            self._add("removed", orphans)
        kept = known.count() - removed
        missing = materialise(missing_vectors(chunks, known, self.key).select(self.key, text).withColumn(
            "_range", F.pmod(F.xxhash64(self.key), F.lit(ranges)).cast("int")), "missing")
        sizes = {r["_range"]: r["n"] for r in missing.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row per range
        for part in sorted(sizes):
            rows = length_sorted(missing.filter(F.col("_range") == part), text, partitions)
            self._add("vectors", embed(rows, [self.key], text, embedder))
        return {"kept": kept, "embedded": sum(sizes.values()), "removed": removed}


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector of each group at length one, averaged place by place."""
    means = vectors.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("m"))
    whole = means.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["m"] * x["m"]))
    return whole.select(group, F.transform("v", lambda x: x["m"] / F.greatest(norm, F.lit(1e-9))).alias("centroid"))


def _block_best(k: int, key: list[str]):
    """The k nearest vectors of one block for the questions of one block; rows as near as the k-th one stay in.

    Distances are rounded here once, so that equal means the same in every block and in the final order.
    """
    def run(questions: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        names = ["question_id", *key, "distance"]
        if questions.empty or vectors.empty:
            return pd.DataFrame({n: [] for n in names})
        q = np.stack(questions["embedding"].to_list()).astype(np.float64)
        m = np.stack(vectors["embedding"].to_list()).astype(np.float64)
        square = (q * q).sum(axis=1)[:, None] + (m * m).sum(axis=1)[None, :] - 2.0 * (q @ m.T)
        dist = np.round(np.sqrt(np.maximum(square, 0.0)), DISTANCE_DIGITS)
        last = min(k, dist.shape[1]) - 1
        rows, cols = np.nonzero(dist <= np.partition(dist, last, axis=1)[:, last:last + 1])
        out = vectors[key].iloc[cols].reset_index(drop=True)
        out.insert(0, "question_id", questions["question_id"].to_numpy()[rows])
        out["distance"] = dist[rows, cols]
        return out[names]

    return run


def knn(vectors: DataFrame, questions: DataFrame, key: list[str], k: int) -> DataFrame:
    """(question_id, key…, distance, place): the k nearest vectors of every question, exactly.

    Both tables are dealt into blocks of bounded size and every block of questions meets every block of vectors once, as
    a matrix product; only the k best rows of each meeting are shuffled on. Ties go by key.
    """
    blocks = [max(1, -(-frame.count() // size)) for frame, size in ((questions, QUESTION_BLOCK), (vectors, VECTOR_BLOCK))]
    number = lambda cols, n: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = questions.select("question_id", "embedding", number(["question_id"], blocks[0]).alias("_q"), every(blocks[1]).alias("_v"))
    right = vectors.select(*key, "embedding", number(key, blocks[1]).alias("_v"), every(blocks[0]).alias("_q"))
    fields = [*questions.select("question_id").schema, *vectors.select(*key).schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", distance double"
    met = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(_block_best(k, key), schema)
    return newest(met, ["question_id"], k, F.col("distance"), *[F.col(c) for c in key], rank="place")
