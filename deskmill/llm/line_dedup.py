"""Line dedup: repeated runs of lines by prefix doubling over line numbers; later copies are deleted.

Lines become numbers; a run of lines is a substring of a document's number sequence. Suffixes are ranked by their
first 1, 2, 4, ... lines: the rank after doubling is the rank of the pair (own rank, rank of the suffix that many lines on),
which is how a suffix array is built. Doubling stops at the depth where every suffix has passed ``min_words`` words, as no
decision depends on more. Two ranks of depth 2^k that overlap name any run of 2^k to 2^(k+1) lines exactly, so suffixes whose
common prefix has at least ``min_words`` words form groups of equal keys (intervals of the longest-common-prefix array);
the earliest stays, and the lines of all others are marked. A maximal repeated run is the union of these shortest runs, read
forwards from its start and backwards from its end. Only DataFrame functions are used.

Lines that occur once never enter: they end a run. Only rows of numbers are shuffled until the marks are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm.names import free_name
from deskmill.session import materialise

MIN_WORDS = 50
# a line with the blank lines after it is one unit, so that blank lines neither end a run nor count as lines
UNIT_BREAK = r"\n(?=[^\S\n]*\S)"
BLANK = " \t\n\x0b\f\r"
LOW = -(1 << 63)
BUCKETS = 256


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds _d and _h, which name a document: its id and a hash of its text."""
    own = F.col(id_col) if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint") else F.xxhash64(id_col)
    return docs.withColumns({"_d": F.coalesce(own.cast("long"), F.lit(LOW)), "_h": F.xxhash64(text_col)})


def _before(frame: DataFrame, keys: list[str], order: list[str], bucket, total: str) -> DataFrame:
    """Adds _before: the sum of ``total`` over rows of the same keys that come earlier in ``order``.

    In two steps, over buckets of the order and inside a bucket, so that a key with very many rows is spread out.
    """
    rows = frame.withColumn("_b", bucket)
    sums = rows.groupBy(*keys, "_b").agg(F.sum(total).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_outer", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(total).over(inside), F.lit(0)))
    return rows.join(sums, [*keys, "_b"]).withColumn("_before", F.col("_outer") + F.col("_inner")).drop("_b", "_outer", "_inner")


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(_d, _h, i, l1, l2, words): every line by a 96-bit number."""
    units = docs.select("_d", "_h", F.posexplode(F.split(text_col, UNIT_BREAK)).alias("i", "unit"))
    line = F.rtrim("unit", F.lit(BLANK))
    words = F.size(F.split(F.ltrim(line, F.lit(BLANK)), r"\s+")).cast("long")
    return units.where(F.rtrim("unit", F.lit(BLANK)) != "").select(
        "_d", "_h", "i", F.xxhash64(line).alias("l1"), F.hash(line).alias("l2"), words.alias("words"))


def _segments(lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of repeated lines with at least ``min_words`` words; fm and bm are the lengths in lines of the shortest
    run of so many words from a line on and up to it (null if the stretch has none), rem the lines up to its end."""
    place = F.xxhash64("_d", "_h", "i")
    seen = lines.groupBy("l1", "l2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("l1", "l2")
    # as a table of its own, so that the rows of a line which very many documents share can be split over tasks in the join
    seen = materialise(seen, "repeated")
    kept = lines.join(seen, ["l1", "l2"], "left_semi").repartition("_d", "_h").dropDuplicates(["_d", "_h", "i"])
    own = Window.partitionBy("_d", "_h").orderBy("i")
    kept = kept.withColumn("seg", F.col("i") - F.row_number().over(own))
    whole = Window.partitionBy("_d", "_h", "seg")
    kept = kept.withColumns({"total": F.sum("words").over(whole), "n": F.count(F.lit(1)).over(whole)})
    kept = kept.where(F.col("total") >= min_words)
    order = whole.orderBy("i")
    kept = kept.withColumns({"after": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                             "at": F.row_number().over(order)})
    kept = kept.withColumns({"before": F.col("after") - F.col("words"), "rem": F.col("n") - F.col("at") + 1})
    ahead = whole.orderBy("before").rangeBetween(0, min_words - 1)
    back = whole.orderBy("after").rangeBetween(-(min_words - 1), 0)
    return kept.select(
        "_d", "_h", "seg", "i", "l1", "l2", "rem",
        F.when(F.col("total") - F.col("before") >= min_words, F.count(F.lit(1)).over(ahead)).alias("fm"),
        F.when(F.col("after") >= min_words, F.count(F.lit(1)).over(back)).alias("bm"))


def _first_ranks(rows: DataFrame) -> DataFrame:
    """Replaces the line number by its rank: how many suffixes start with a smaller line."""
    counts = rows.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    ranks = _before(counts, ["all"], ["l1", "l2"], F.shiftright("l1", 52), "n").select("l1", "l2", F.col("_before").alias("r"))
    return rows.join(ranks, ["l1", "l2"]).drop("l1", "l2")


def _double(rows: DataFrame, depth: int, width: int) -> DataFrame:
    """Ranks by 2 * depth lines from ranks by depth lines; shorter suffixes come first in their group and keep their rank."""
    order = Window.partitionBy("_d", "_h", "seg").orderBy("i")
    paired = rows.withColumn("r2", F.when(F.col("rem") >= 2 * depth, F.lead("r", depth).over(order)).otherwise(F.lit(-1)))
    counts = paired.where(F.col("rem") >= depth).groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n"))
    ranks = _before(counts, ["r"], ["r2"], F.floor(F.col("r2") / width), "n").where("_before > 0").select(
        F.col("r").alias("_r"), F.col("r2").alias("_r2"), "_before")
    joined = paired.join(ranks, (F.col("r") == F.col("_r")) & (F.col("r2") == F.col("_r2")), "left")
    # a rank that nothing in its group comes before stays; so does that of a suffix that has ended
    return joined.select("_d", "_h", "seg", "i", "rem", "fm", "bm", (F.col("r") + F.when(
        F.col("r2") >= 0, F.coalesce("_before", F.lit(0))).otherwise(F.lit(0))).alias("r"))


def _runs(rows: DataFrame, depth: int) -> DataFrame:
    """Shortest runs of depth to 2 * depth - 1 lines as (way, m, ra, rb, _d, _h, i): ra and rb name the content."""
    order = Window.partitionBy("_d", "_h", "seg").orderBy("i")
    near = rows.withColumns({"ahead": F.collect_list("r").over(order.rowsBetween(0, depth - 1)),
                             "back": F.collect_list("r").over(order.rowsBetween(-(2 * depth - 2), 0))})
    fits = lambda c: F.col(c).between(depth, 2 * depth - 1)
    ways = [near.where(fits("fm")).select(F.lit(1).alias("way"), F.col("fm").alias("m"), F.col("r").alias("ra"),
                                          F.element_at("ahead", (F.col("fm") - depth + 1).cast("int")).alias("rb"), "_d", "_h", "i"),
            near.where(fits("bm")).select(F.lit(2).alias("way"), F.col("bm").alias("m"),
                                          F.element_at("back", (-F.col("bm")).cast("int")).alias("ra"),
                                          F.element_at("back", F.lit(-depth)).alias("rb"), "_d", "_h",
                                          (F.col("i") - F.col("bm") + 1).cast("int").alias("i"))]
    return ways[0].unionAll(ways[1])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _h, spans): per document the stretches of units (from, to) that an earlier place has too."""
    lines = materialise(_lines(_keyed(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), id_col, text_col),
                               text_col), "lines")
    rows = materialise(_first_ranks(_segments(lines, min_words)), "ranks")
    top = rows.agg(F.count(F.lit(1)), F.max(F.greatest("fm", "bm"))).first()
    width, deepest = max(1, top[0] // BUCKETS), top[1] or 1
    found, depth = materialise(_runs(rows, 1), "runs"), 1
    while 2 * depth <= deepest:
        rows = materialise(_double(rows, depth, width), "ranks")
        depth *= 2
        found = found.unionAll(materialise(_runs(rows, depth), "runs"))
    key = ["way", "m", "ra", "rb"]
    place = F.struct("_d", "_h", "i")
    firsts = found.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = materialise(firsts, "firsts")  # for the same reason as above
    later = found.join(firsts, key).where(place > F.col("first")).select("_d", "_h", "i", (F.col("i") + F.col("m") - 1).alias("e"))
    order = Window.partitionBy("_d", "_h").orderBy("i", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.coalesce((F.col("i") > reached + 1).cast("int"), F.lit(1)))
    later = later.withColumn("no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = later.groupBy("_d", "_h", "no").agg(F.min("i").alias("s"), F.max("e").alias("e"))
    return spans.groupBy("_d", "_h").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs taken out of the text, plus n_lines and n_deleted (long).

    A line goes if it lies in a run of at least ``min_words`` words that an earlier place has line by line, trailing white space
    aside; places are ordered by id, then line. Of a run that overlaps its own copy the first lines stay.
    A blank line belongs to the line before it. A null text stays null, with 0 lines; an empty text has one line.
    Rows equal in id and text are one document and get the same text. A null id comes before all others.
    A text all of whose lines repeat becomes empty; the row stays. An empty table stays empty. Other columns are kept.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    keyed = _keyed(docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in kept]), id_col, text_col)
    spans = free_name("spans", kept)
    joined = keyed.join(repeated_runs(docs, id_col, text_col, min_words).withColumnRenamed("spans", spans), ["_d", "_h"], "left")
    units = F.split(text_col, UNIT_BREAK)
    left = F.filter(units, lambda u, n: ~F.exists(spans, lambda s: (s["s"] <= n) & (n <= s["e"])))
    gone = F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"] + 1), F.lit(0))
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept],
                         F.coalesce(F.size(units), F.lit(0)).cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"))
