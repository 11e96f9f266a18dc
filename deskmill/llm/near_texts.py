"""Near-duplicate texts: candidates by SimHash with Hamming balls and by MinHash bands, then their exact similarity.

SimHash is the search of ``simhash``: fingerprints of three-word shingles that differ in at most ``DISTANCE`` bits are found by
enumerating the ball of a segment. It loses pairs at the similarity asked for when one text goes on longer, so MinHash bands add to it.

Pairs are proposed on the sets that are compared (distinct shingles of five words), so it doesn't matter how two texts came to
differ: by scattered words, by one text going on longer or by repeats. The least value of a set under a random order is the same for two
sets with a probability that is their similarity (Jaccard). ``ROWS`` such values make a band; a pair is found when some band is equal. The number
of bands follows from the similarity asked for: pairs just at it are missed with probability ``MISSED``, nearer ones with less.

Every candidate also has to pass two bounds in the join before its sets are compared exactly. One bit each of 128 of the least values differ in
half the places in which the values do; more than ``DEVIATIONS`` standard deviations above what the similarity gives is too far
(about one pair in 47,000 just at the similarity). 128 parity bits of the shingle set differ in at most as many places
as the sets do, which never turns away a similar pair. These keep large families of moderately similar texts from being compared pair by pair.

Texts with equal word sequences are one entry. Each bucket first links its members to its smallest entry; buckets inside one
group are then settled, and in the second round only pairs across groups are looked at, so a large group of copies is
linked by a star and not pair by pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.graph import components
from deskmill.llm.simhash import fingerprint, links, shingle_hashes
from deskmill.session import materialise

DISTANCE = 3  # most bits in which SimHash fingerprints of a pair differ
SEGMENTS = 2
SIMHASH_WORDS = 3
ROWS = 6  # least values in a band
MISSED = 1e-4  # pairs just at the similarity that meet in no band
MOST_BANDS = 128  # in force below a similarity of about 0.64
DEVIATIONS = 4.5
SKETCH = 128
PART = 1 << 12  # shingles that are put into all orders at a time
BROADCAST_IDS = 1_000_000  # up to so many ids (8 MB) are sent to the texts; more are met by shuffling the texts


def band_count(similarity: float) -> int:
    """Bands after which a pair just at the similarity is missed with probability ``MISSED`` at most."""
    hit = min(max(similarity, 0.0), 1.0) ** ROWS
    return 1 if hit >= 1 - MISSED else MOST_BANDS if hit <= 0 else min(MOST_BANDS, math.ceil(math.log(MISSED) / math.log1p(-hit)))


def sketch_bits(similarity: float) -> int:
    """Most sketch bits in which a pair of the similarity may differ."""
    p = (1 - min(max(similarity, 0.0), 1.0)) / 2
    return math.floor(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))


_ORDERS = np.random.default_rng(42).integers(0, 1 << 64, (2, max(SKETCH, ROWS * MOST_BANDS)), np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def band_marks(shingles: np.ndarray, bands: int) -> tuple[int, int, list[int]]:
    """128 sketch bits as two numbers, and a hash of each band's least values; ``shingles`` are distinct hashes, at least one."""
    width = max(SKETCH, ROWS * bands)
    flips, factors = _ORDERS[0, :width, None], _ORDERS[1, :width, None] | np.uint64(1)
    least = np.full(width, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), PART):
        least = np.minimum(least, ((shingles[at:at + PART] ^ flips) * factors).min(1))
    values = _mixed(least)
    bits = np.packbits((values[:SKETCH] >> np.uint64(63)).astype(np.uint8)).view(np.int64)
    total = np.zeros(bands, np.uint64)
    for row in values[:ROWS * bands].reshape(bands, ROWS).T:
        total = _mixed(total * np.uint64(31) + row)
    # the number of the band takes part, so that bands never meet others
    keys = _mixed(total + np.arange(bands, dtype=np.uint64)).view(np.int64)
    return int(bits[0]), int(bits[1]), keys.tolist()


def parity(shingles: np.ndarray) -> tuple[int, int, int]:
    """Number of distinct shingles, and for each of 128 classes of them whether it holds an odd number."""
    odd = np.packbits((np.bincount((shingles >> np.uint64(40)).astype(np.int64) & 127, minlength=128) & 1).astype(np.uint8)).view(np.int64)
    return len(shingles), int(odd[0]), int(odd[1])


MARKS = ("c1", "c2", "f1", "f2", "n", "p1", "p2", "h")


def text_marks(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float = 0.8) -> DataFrame:
    """(id, c1, c2, f1, f2, n, p1, p2, h, bands): a 128-bit hash of the word sequence, the sketch, the number of shingles, their
    parity bits, the SimHash fingerprint and the bands; n is 0, and there are no bands, for texts shorter than a shingle."""
    bands = band_count(similarity)

    def run(batches):
        for batch in batches:
            rows, keys = [], []
            for text in batch.column(1).to_pylist():
                parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
                whole = xxhash.xxh3_128_digest(b" ".join(parts))
                c1, c2 = np.frombuffer(whole, np.int64).tolist()
                own: list[int] = []
                marks = (0,) * 6
                if len(parts) >= words:
                    shingles = np.unique(np.array(shingle_hashes(text, words), np.uint64))
                    f1, f2, own = band_marks(shingles, bands)
                    marks = (f1, f2, *parity(shingles), fingerprint(text, SIMHASH_WORDS))
                rows.append((c1, c2, *marks))
                keys.append(own)
            columns = list(zip(*rows)) or [()] * len(MARKS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns],
                                              pa.array(keys, pa.list_(pa.int64()))], ["id", *MARKS, "bands"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in MARKS],
                           T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def _keys(entries: DataFrame) -> DataFrame:
    """Every entry once per band."""
    return entries.withColumn("key", F.explode("bands")).drop("bands")


def _apart(a: str, b: str, *columns: str):
    counts = [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in columns]
    return counts[0] + counts[1]


def _near(a: str, b: str, bits: int, similarity: float):
    """Whether sketches are near and the shingle sets can be similar at all."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    return ((_apart(a, b, "f1", "f2") <= bits)
            & (_apart(a, b, "p1", "p2") <= both * ((1 - similarity) / (1 + similarity)) + 1e-9)
            & (F.least(f"{a}.n", f"{b}.n") >= F.greatest(f"{a}.n", f"{b}.n") * similarity - 1e-9))


def _sent(ids: DataFrame, name: str) -> DataFrame:
    """Distinct ids as a written table, to be broadcast if a count shows that they are few."""
    ids = materialise(ids.distinct(), name)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, name: str) -> DataFrame:
    """Pairs (a, b) of ids whose shingle sets have at least the similarity."""
    pairs = materialise(pairs.distinct(), f"{name}-pairs")
    wanted = _sent(pairs.select(F.explode(F.array("a", "b")).alias("id")), f"{name}-ids")

    def shingle(batches):
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(x, words), np.uint64)).view(np.int64) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                                             ["id", "s"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("s", T.ArrayType(T.LongType()))])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).join(wanted, "id", "left_semi")
    sets = materialise(texts.mapInArrow(shingle, schema), f"{name}-sets")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    alike = common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)
    return materialise(both.where(alike).select("a", "b"), f"{name}-links")


def ball_pairs(entries: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b) of reps by their fingerprints ``h``: each rep with the smallest of its fingerprint, and the smallest ones of
    fingerprints that differ in at most ``distance`` bits."""
    heads = materialise(entries.groupBy(F.col("h").alias("fp")).agg(F.min("rep").alias("head")), "ball-heads")
    same = entries.join(heads, entries["h"] == heads["fp"]).where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    named = [heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in ("a", "b")]
    near = links(heads.select("fp"), distance, segments).distinct().join(named[0], "a").join(named[1], "b")
    return same.unionAll(near.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8,
                bits: int | None = None) -> DataFrame:
    """(id, c1, c2, component) per row: component is the smallest id that links reach.

    Texts with equal words link, also blank and null ones with each other; shorter ones than ``words`` only so. Rows with a
    null id belong to the group of their text and name none. Ids have to be unique or repeat only with equal texts for
    the similarity of differing texts to be well defined; an empty table gives an empty result. ``bits`` is the most
    sketch bits in which a pair may differ, by default what the similarity allows.
    """
    bits = sketch_bits(similarity) if bits is None else bits
    marks = materialise(text_marks(docs, id_col, text_col, words, similarity), "marks")
    shown = MARKS[2:-1]
    # equal texts have equal marks, so any of them will do
    entries = materialise(marks.groupBy("c1", "c2").agg(F.min("id").alias("rep"), *[F.max(c).alias(c) for c in (*shown, "h", "bands")]), "entries")
    usable = entries.where((F.col("n") > 0) & F.col("rep").isNotNull()).select("rep", *shown, "bands")
    keyed = _keys(usable)
    heads = keyed.groupBy("key").agg(F.min("rep").alias("rep"), *[F.min_by(c, "rep").alias(c) for c in shown])
    stars = keyed.alias("x").hint("merge").join(heads.alias("y"), "key").where((F.col("x.rep") != F.col("y.rep")) & _near("x", "y", bits, similarity))
    balls = ball_pairs(entries.where((F.col("n") > 0) & F.col("rep").isNotNull()).select("rep", "h"))
    first = _verified(stars.select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).unionAll(balls), docs, id_col, text_col, words, similarity, "stars")
    groups = components(first, "a", "b")
    grouped = materialise(usable.join(groups, usable["rep"] == groups["node"], "left").select(
        "rep", *shown, "bands", F.coalesce("root", "rep").alias("g")), "grouped")
    table = _keys(grouped)
    cross = table.alias("x").hint("merge").join(table.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.g") != F.col("y.g"))
                                                & (F.col("x.rep") < F.col("y.rep")) & _near("x", "y", bits, similarity))
    pairs = cross.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    second = _verified(pairs, docs, id_col, text_col, words, similarity, "pairs")
    roots = components(first.unionAll(second), "a", "b")
    named = entries.join(roots, entries["rep"] == roots["node"], "left").select(
        "c1", "c2", F.coalesce("root", "rep").alias("component"))
    return marks.select("id", "c1", "c2").join(named, ["c1", "c2"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose group has a smaller id; columns stay as they are.

    Of rows that repeat the kept id one stays. Rows with a null id stay only if their group has no other id; then all do.
    """
    groups = materialise(near_groups(docs, id_col, text_col, words, similarity), "groups")
    gone = groups.where(F.col("id").isNotNull() & (F.col("id") != F.col("component"))).select(F.col("id").alias(id_col))
    left = docs.join(_sent(gone, "gone"), id_col, "left_anti")
    nameless = groups.where(F.col("id").isNull() & F.col("component").isNotNull())
    if not nameless.isEmpty():  # a null id can only be told by its text
        texts = nameless.select(F.lit(True).alias("_gone"), "c1", "c2").distinct()
        marked = text_marks(docs.where(F.col(id_col).isNull()), text_col, text_col, words)
        copies = marked.join(texts, ["c1", "c2"]).select(F.col("id").alias("_t")).distinct()
        nulls = docs.where(F.col(id_col).isNull())
        left = left.where(F.col(id_col).isNotNull()).unionByName(nulls.join(copies, F.col(text_col).eqNullSafe(F.col("_t")), "left_anti"))
    repeated = materialise(groups.where(F.col("id") == F.col("component")).groupBy("id").count().where("count > 1")
                           .select(F.col("id").alias(id_col)), "repeated")
    if not repeated.isEmpty():
        left = left.join(repeated, id_col, "left_anti").unionByName(left.join(repeated, id_col, "left_semi").dropDuplicates([id_col]))
    return left.select(*docs.columns)
