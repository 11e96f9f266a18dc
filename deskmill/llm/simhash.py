"""SimHash near-duplicates by multi-index hashing over Hamming balls.

Fingerprints are made in one Arrow pass over the texts; from there on only 64-bit numbers are shuffled. A
fingerprint is cut into segments. If two fingerprints differ in at most ``distance`` bits, then in at least one
segment they differ in few enough bits that the key of the one lies in the small ball around the key of the
other: the balls are enumerated, looked up in the table of segment keys, and the whole distance is checked
inside the join. Equal fingerprints are one row in this search, however many documents carry them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.graph import components
from deskmill.session import materialise

BITS = 64
CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``words`` words; a shorter text is one run, an empty one has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return []
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    return [digest(joined[s:e], 42) for s, e in zip(starts, (ends[words - 1:] - 1).tolist())]


def fingerprint(text: str | None, words: int) -> int:
    """The 64 majority bits of the shingle hashes, as a signed number; 0 for a text without words."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at:at + CHUNK], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of every row; null and blank texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            marks = [fingerprint(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def segment_plan(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, width, ball radius) per segment such that one of them must match."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    radius, rest = divmod(distance, segments)
    plan = [(edges[i], edges[i + 1] - edges[i], radius if i <= rest else radius - 1) for i in range(segments)]
    return [x for x in plan if x[2] >= 0]


def _masks(first: int, width: int, most: int, least: int = 0) -> list[int]:
    """Bit patterns of ``least`` to ``most`` flips inside one segment, as signed 64-bit numbers."""
    found = [sum(1 << (first + i) for i in bits) for n in range(least, most + 1) for bits in combinations(range(width), n)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _longs(values: list[int]):
    return F.array(*[F.lit(x).cast("long") for x in values])


def links(unique: DataFrame, distance: int = 2, segments: int = 2, crowded: int = 1000) -> DataFrame:
    """Pairs (a, b) of fingerprints, a < b, that differ in at most ``distance`` bits; ``unique`` has each fp once.

    A segment key that more than ``crowded`` fingerprints share is not paired up inside: each fingerprint that
    looks it up enumerates the rest of its ball over the other bits instead and looks up whole fingerprints. Both
    ways find the same pairs; the second costs a constant number of look-ups, however large the crowd.
    A pair may come more than once.
    """
    plan = segment_plan(distance, segments)
    # low bits of a key say where its segment starts, the others are the segment's bits in place
    table = unique.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), F.col("fp").bitwiseAND(F.lit(_whole(f, w)).cast("long")).alias("key"))
        for s, (f, w, _) in enumerate(plan)])).alias("x")).select("x.seg", "x.key", "fp")
    probes = unique.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), F.lit(_whole(f, w)).cast("long").alias("cut"), _longs(_masks(f, w, r)).alias("masks"))
        for s, (f, w, r) in enumerate(plan)])).alias("x")).select(
            "fp", "x.seg", F.col("fp").bitwiseAND(F.col("x.cut")).alias("own"), F.explode("x.masks").alias("mask"))
    probes = probes.select("fp", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("key"), F.bit_count("mask").alias("used"))
    hot = materialise(table.groupBy("seg", "key").count().where(F.col("count") > crowded).select("seg", "key"), "crowded")
    none_hot = hot.isEmpty()
    calm = probes if none_hot else probes.join(hot, ["seg", "key"], "left_anti")
    other = table.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    same = (calm["seg"] == other["seg"]) & (calm["key"] == other["key"])
    # exploded rows are many more than their input's size tells, so neither side may be taken for a broadcast
    pairs = calm.hint("merge").join(other, same & (F.col("fp") < F.col("b")) & near).select(F.col("fp").alias("a"), "b")
    if none_hot:
        return pairs
    whole = unique.select(F.col("fp").alias("b"))
    busy = probes.join(hot, ["seg", "key"])
    for s, (first, width, _) in enumerate(plan):
        outside = [i for i in range(BITS) if not first <= i < first + width]
        for used in range(distance + 1):
            rest = [sum(1 << i for i in bits) for n in range(distance - used + 1) for bits in combinations(outside, n)]
            masks = [x - (1 << 64) if x >> 63 else x for x in rest]
            ball = busy.where((F.col("seg") == s) & (F.col("used") == used)).select(
                "fp", F.col("fp").bitwiseAND(F.lit(_whole(first, width, True)).cast("long")).bitwiseOR(F.col("key"))
                .alias("centre"), F.explode(_longs(masks)).alias("mask"))
            found = ball.select("fp", F.col("centre").bitwiseXOR(F.col("mask")).alias("b"))
            pairs = pairs.unionAll(found.where("fp < b").hint("merge").join(whole, "b").select(F.col("fp").alias("a"), "b"))
    return pairs


def _whole(first: int, width: int, outside: bool = False) -> int:
    x = ((1 << width) - 1) << first
    x = (1 << 64) - 1 - x if outside else x
    return x - (1 << 64) if x >> 63 else x


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                distance: int = 2, segments: int = 2) -> DataFrame:
    """(id, fp, component) per row; component is the smallest id that links reach.

    Null and blank texts have fingerprint 0 and link like any other. Repeated rows and repeated ids stay as many
    rows; a null id belongs to the component of its text but never names it (null if nothing else is there).
    An empty table gives an empty result; further columns are ignored.
    """
    marks = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    unique = materialise(marks.groupBy("fp").agg(F.min("id").alias("first")), "unique")
    roots = components(links(unique.select("fp"), distance, segments), "a", "b")
    placed = unique.join(roots, unique["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component"))
    labels = placed.join(named, "root").select("fp", "component")
    return marks.join(labels, "fp").select("id", "fp", "component")
