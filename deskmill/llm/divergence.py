"""How far the sources of a language differ in their words, by count-level bitmaps.

Words are counted per (language, source) inside the tasks before anything is shuffled. A language's kept words are dealt by
hash into shards of a few thousand. In a shard, each source has one bitset of word ids per count that occurs there; the AND
of two bitsets and its popcount say how many words have count a in one source and b in the other, so the divergence function
is evaluated once per joint cell instead of once per word. Words that a source lacks are the complement. All arithmetic is on
whole numbers.

A shard holds at most ``SHARD`` words of ``TILE`` x ``TILE`` sources, whatever the corpus; a source or a language with most
of all rows is spread over the shards.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.session import materialise

SHARD = 4096  # words of a shard
TILE = 512  # sources on one side of a shard
HELD = 400_000  # counts a task holds before it passes them on

# every byte that is no part of a word becomes a space, A-Z become a-z; bytes of multi-byte characters stay
WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])


def _partial_counts(batches):
    """Counts per (lang, source, word) of what a task holds, and one row without a word for every group."""
    times: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def rows():
        for (lang, source), counts in times.items():
            in_docs = docs[lang, source]
            n = len(counts) + 1
            terms = pa.concat_arrays([pa.array([None], pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string())])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms,
                 pa.array([0, *counts.values()], pa.int64()), pa.array([0, *map(in_docs.__getitem__, counts)], pa.int64())],
                COUNTS.names)
        times.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.translate(WORD_BYTES).split()
            times[lang, source].update(words)
            docs[lang, source].update(set(words))
        if sum(map(len, times.values())) > HELD:
            yield from rows()
    yield from rows()


def group_counts(docs: DataFrame, min_docs: int = 10, lang_col: str = "lang", source_col: str = "source",
                 text_col: str = "text") -> DataFrame:
    """lang, source, term, n, total (n over the language), first (one row per lang and term), for the words in at least
    ``min_docs`` rows of their language; every occurring group has one more row with a null term and n = 0.

    Null texts, languages and sources are ''. Repeated rows count each; other columns are not read.
    """
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), empty).alias("source"),
                       F.coalesce(F.col(text_col).cast("string"), empty).cast("binary").alias("text"))
    counts = rows.mapInArrow(_partial_counts, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    return counts.select("lang", "source", "term", "n", F.sum("docs").over(word).alias("docs"), F.sum("n").over(word).alias("total"),
                         (F.col("source") == F.min("source").over(word)).alias("first")) \
        .where(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs")


def _share(n, total, kept, scale: int):
    """1 + floor(scale * (n + 2) / (total + 2 * kept)): smoothed share in whole numbers; 1 where nothing is kept."""
    return 1 + scale * (n + 2) // np.maximum(total + 2 * kept, 1)


def _gap(p, q):
    """floor((p - q)^2 / (p + q)) of 64-bit whole numbers."""
    return (p - q) ** 2 // (p + q)


def _share_col(n: str, total: str, kept: str, scale: int):
    return F.expr(f"1 + ({scale}L * ({n} + 2)) div ({total} + 2 * {kept})")


def _word_blocks(totals: np.ndarray, sources: int):
    """Words of similar frequency together, as arrays of word numbers.

    Rare words share few counts, so their blocks are wide; a frequent word has a count of its own in nearly every source, and
    a wide block would only hold bitsets of single bits.
    """
    size = np.floor(np.log2(np.maximum(totals, 1))).astype(np.int64)
    for level in np.unique(size):
        words = np.flatnonzero(size == level)
        per_source = max(1.0, 2.0 ** float(level) / sources)
        width = int(max(4, SHARD // per_source ** 2))
        for start in range(0, len(words), width):
            yield words[start:start + width]


def _shard_pairs(source: np.ndarray, word: np.ndarray, n: np.ndarray, words: int, totals: np.ndarray, kept: np.ndarray,
                 left: np.ndarray, right: np.ndarray, scale: int) -> np.ndarray:
    """Matrix [left, right] of the summed function over the ``words`` of a shard, for pairs with left < right.

    ``source``, ``word`` and ``n`` list the occurring counts; ``totals`` and ``kept`` hold N and V per source.
    """
    number = len(totals)
    result = np.zeros((number, number), np.int64)
    zero = _share(np.zeros(number, np.int64), totals, kept, scale)
    at = np.full(words, -1, np.int64)
    order = np.argsort(word, kind="stable")
    first = np.searchsorted(word[order], np.arange(words + 1))
    for block in _word_blocks(np.bincount(word, weights=n, minlength=words), number):
        rows = order[np.concatenate([np.arange(first[w], first[w + 1]) for w in block])]
        at[block] = np.arange(len(block))
        place, owner, count = at[word[rows]], source[rows], n[rows]
        by = np.lexsort((count, owner))
        place, owner, count = place[by], owner[by], count[by]
        new = np.ones(len(by), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (count[1:] != count[:-1])
        level = np.cumsum(new) - 1
        owner, count = owner[new], count[new]  # one bitset per (source, count)
        bits = np.zeros((len(owner), (len(block) + 63) // 64), np.uint64)
        np.bitwise_or.at(bits, (level, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        has = np.bitwise_count(bits).sum(1, dtype=np.int64)
        share = _share(count, totals[owner], kept[owner], scale)
        ends = np.searchsorted(owner, np.arange(number + 1))
        present = np.bincount(owner, weights=has, minlength=number).astype(np.int64)
        for a in left:
            others = right[right > a] if left is right else right
            lo, hi = ends[a], ends[a + 1]
            # joint cells: popcount of the AND of two bitsets
            cells = np.zeros((hi - lo, len(owner)), np.int64)
            for w in range(bits.shape[1]):
                cells += np.bitwise_count(bits[lo:hi, w, None] & bits[None, :, w])
            both = cells * _gap(share[lo:hi, None], share[None, :])
            met = cells.sum(0)
            only_b = (has - met) * _gap(zero[a], share)  # zeros of a, by complement
            sums = np.zeros((number, 2), np.int64)
            np.add.at(sums, owner, np.stack([both.sum(0) + only_b, met], 1))
            in_b = np.zeros((hi - lo, number), np.int64)
            np.add.at(in_b.T, owner, cells.T)
            only_a = ((has[lo:hi, None] - in_b) * _gap(share[lo:hi, None], zero[None, :])).sum(0)
            neither = len(block) - present[a] - present + sums[:, 1]
            result[a, others] += (sums[:, 0] + only_a + neither * _gap(zero[a], zero))[others]
    return result


def _shards(kept):
    return F.greatest(F.lit(1), F.ceil(kept / SHARD)).cast("int")


def pair_values(kept: DataFrame, groups: DataFrame, scale: int = 10 ** 9) -> DataFrame:
    """lang, a, b, value for every two sources a and b of a language, once per unordered pair.

    ``kept`` as ``group_counts`` gives it; ``groups`` has lang, source, total (N) and kept (V).
    """
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles = -(-most // TILE) or 1
    own = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")

    def dealt(frame: DataFrame) -> DataFrame:
        """Each row goes to the meetings of its tile with every tile."""
        frame = frame.withColumn("tile", own)
        if tiles > 1:
            frame = frame.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        else:
            frame = frame.withColumn("other", F.lit(0))
        return frame.select("lang", "shard", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile",
                            "source", "term", "n", "total", "kept")

    langs = groups.groupBy("lang").agg(_shards(F.max("kept")).alias("shards"))
    words = kept.where(F.col("term").isNotNull()).select("lang", "source", "term", "n", "first").join(langs, "lang") \
        .withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")) \
        .withColumn("total", F.lit(None).cast("long")).withColumn("kept", F.lit(None).cast("long"))
    # every source has a row without a word in every shard, with the number of the shard's words
    sizes = words.groupBy("lang", "shard").agg(F.count_if("first").alias("size"))
    every = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), _shards(F.col("kept")) - 1))) \
        .join(sizes, ["lang", "shard"], "left").withColumn("term", F.lit(None).cast("string")) \
        .withColumn("n", F.coalesce("size", F.lit(0)))
    schema = "lang string, a string, b string, value long"

    def meet(key, rows):
        lang, _, ta, tb = key
        marks = rows[rows["term"].isna()].sort_values("source")
        names = marks["source"].to_numpy()
        found = rows[rows["term"].notna()]
        word, terms = pd.factorize(found["term"])
        source = pd.Index(names).get_indexer(found["source"])
        left = np.flatnonzero(marks["tile"].to_numpy() == ta)
        right = left if ta == tb else np.flatnonzero(marks["tile"].to_numpy() == tb)
        totals, kept_words = marks["total"].to_numpy(np.int64), marks["kept"].to_numpy(np.int64)
        values = _shard_pairs(source, word, found["n"].to_numpy(np.int64), len(terms), totals, kept_words, left, right, scale)
        zero = _share(np.zeros(len(names), np.int64), totals, kept_words, scale)
        values += (int(marks["n"].iloc[0]) - len(terms)) * _gap(zero[:, None], zero[None, :])  # words of other tiles only
        a, b = np.meshgrid(left, right, indexing="ij")
        use = a < b if ta == tb else np.ones(a.shape, bool)
        return pd.DataFrame({"lang": lang, "a": names[a[use]], "b": names[b[use]], "value": values[a[use], b[use]]})

    met = dealt(words).unionByName(dealt(every)).groupBy("lang", "shard", "ta", "tb").applyInPandas(meet, schema)
    return met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, scale: int = 10 ** 9, lang_col: str = "lang",
                      source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from the others of its language.

    Part ``pair`` has every other source with the summed function over all kept words; part ``term`` the ``top`` words that
    the source uses more than the language does. A language without kept words has pairs of value 0; a source alone in its
    language has no pair. Nulls are '', ties go by the item, repeated rows count each, an empty table gives no rows.
    """
    kept = materialise(group_counts(docs, min_docs, lang_col, source_col, text_col), "divergence-counts")
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.expr("term is not null and first")).alias("kept"))
    langs = size.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("kept").alias("kept"))
    groups = materialise(size.drop("kept").join(langs, "lang"), "divergence-groups")

    pairs = materialise(pair_values(kept, groups.drop("lang_total"), scale), "divergence-pairs")
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    pair = both.withColumn("rank", F.row_number().over(ordered)).withColumn("part", F.lit("pair"))

    shares = kept.where("term is not null and n > 0").withColumnRenamed("total", "term_total").join(groups, ["lang", "source"]) \
        .withColumn("p", _share_col("n", "total", "kept", scale)).withColumn("q", _share_col("term_total", "lang_total", "kept", scale))
    term = shares.where("p > q").select("lang", "source", F.col("term").alias("item"),
                                        F.expr("((p - q) * (p - q)) div (p + q)").alias("value")) \
        .withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(term.select(*columns))
