"""Knowledge-base search for a table of questions: inverted index, BM25, ranking, snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.functions import fixed as X
from deskmill.functions.text import cut_ending, fold, stem, stem_pattern, words
from deskmill.operators.ordered import newest
from deskmill.session import materialise

# BM25 constants, column weights, hit limits.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TITLE_WEIGHT, BODY_WEIGHT = 4.0, 1.0
HITS_DEFAULT, HITS_MAX, PER_DOC = 8, 20, 2


def stems(text: Column, en: list[str] | None = X.EN_ENDINGS, pattern: str = X.WORD) -> Column:
    return F.transform(words(F.lower(fold(text)), pattern), lambda w: cut_ending(w, en=en))


def query_stems(text: Column, stop_words: list[str] = X.KB_STOP_WORDS, en: list[str] | None = X.EN_ENDINGS) -> Column:
    """Distinct stems in order, without short ones and stop words (which are stemmed alike)."""
    stops = F.transform(F.array(*[F.lit(w) for w in stop_words]), lambda w: stem(w, en=en))
    return F.filter(F.array_except(F.array_distinct(stems(text, en)), stops), lambda s: F.length(s) >= 2)


@dataclass
class TextIndex:
    """Written tables: documents without text, chunks(doc_id, chunk_no, text, n_words, fingerprint), counts (see ``chunk_counts``),
    stats(n, avg_len), and terms(start, page, term): the vocabulary in sorted pages."""

    documents: DataFrame
    chunks: DataFrame
    counts: DataFrame
    stats: DataFrame
    terms: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(doc_id, chunk_no, len, term, tf_title, tf_body), made of the counts."""
        each = F.arrays_zip("terms", "lens", "tf_title", "tf_body")
        return self.counts.select("doc_id", "chunk_no", F.explode(each).alias("p")).select(
            "doc_id", "chunk_no", F.col("p.lens").alias("len"), F.col("p.terms").alias("term"), "p.tf_title", "p.tf_body")

    def vocabulary(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.col("tf_title") + F.col("tf_body")).alias("cf"))


def low_words(text: Column) -> Column:
    return words(F.lower(fold(text)))


PART = 10_000  # chunks that are counted by one task, about
WORDS_KEPT = 500_000  # words whose stems a task remembers


def body_terms(sized: DataFrame, en: list[str] | None = X.EN_ENDINGS) -> DataFrame:
    """(doc_id, chunk_no, len, term, tf_body) of each row of ``sized`` (doc_id, chunk_no, len, text), counted in the row.

    A word is cut once per task and remembered; nothing is shuffled, and a task holds the numbers of a batch's words, whose texts it
    takes out once each.
    """
    names = ["doc_id", "chunk_no", "len"]
    pattern, groups = stem_pattern(X.RU_ENDINGS, en)
    ending, kept = re.compile(pattern), "".join(f"\\{i + 1}" for i in range(groups))

    def work(batches):
        known = {}
        for batch in batches:
            lists = batch.column("words")
            found = lists.flatten().dictionary_encode()
            if len(known) >= WORDS_KEPT:
                known.clear()
            cut = []
            for word in found.dictionary.to_pylist():
                term = known.get(word)
                if term is None:
                    term = known[word] = ending.sub(kept, word)
                cut.append(term)
            # words, terms and rows are numbers from here on; a row and its term make one number that is counted
            terms = pa.array(cut, pa.string()).dictionary_encode()
            size = max(1, len(terms.dictionary))
            row = np.repeat(np.arange(len(batch), dtype=np.int64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            term = terms.indices.to_numpy(zero_copy_only=False)[found.indices.to_numpy(zero_copy_only=False)]
            pair, counts = np.unique(row * size + term, return_counts=True)
            taken = pa.array(pair // size)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(taken) for c in names], terms.dictionary.take(pa.array(pair % size)), pa.array(counts, pa.int64())],
                                             [*names, "term", "tf_body"])

    rows = sized.select(*names, low_words(F.col("text")).alias("words"))
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("term", T.StringType()), T.StructField("tf_body", T.LongType())])
    return rows.mapInArrow(work, schema)


def build_postings(chunks: DataFrame, titles: DataFrame, en: list[str] | None = X.EN_ENDINGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, chunk lengths, stems). ``titles`` has any number of rows (doc_id, title); each chunk carries its document's titles.

    A posting holds the length of its chunk, so that scoring needs no join with lengths. Terms are counted inside the chunk's row;
    only finished counts are shuffled, to be put together with those of the titles.
    """
    title_terms = (titles.select("doc_id", F.explode(stems(F.col("title"), en)).alias("term"))
                   .groupBy("doc_id", "term").agg(F.count("*").alias("tf_title")))
    title_len = title_terms.groupBy("doc_id").agg(F.sum("tf_title").alias("title_len"))
    length = (F.col("n_words") + F.coalesce("title_len", F.lit(0))).alias("len")
    sized = chunks.join(title_len, "doc_id", "left")
    cut = chunks.select(F.explode(low_words(F.col("text"))).alias("word")).distinct().select("word", cut_ending(F.col("word"), en=en).alias("term"))
    body = body_terms(sized.select("doc_id", "chunk_no", length, "text"), en).select(
        "doc_id", "chunk_no", "len", "term", F.lit(0).cast("long").alias("tf_title"), "tf_body")
    lengths = sized.select("doc_id", "chunk_no", length)
    head = title_terms.join(lengths, "doc_id").select("doc_id", "chunk_no", "len", "term", "tf_title", F.lit(0).cast("long").alias("tf_body"))
    # dealt before they are put together, to parts of a fixed size: counts of a chunk are all different, a task would only pile them up;
    # a chunk's postings lie in one part, where a reader puts together all that belongs to a stem
    key = ["doc_id", "chunk_no", "len", "term"]
    parts = max(1, -(-chunks.count() // PART))
    postings = body.unionByName(head).repartition(parts, "doc_id", "chunk_no").groupBy(*key).agg(
        F.sum("tf_title").alias("tf_title"), F.sum("tf_body").alias("tf_body"))
    return postings, lengths, cut


def chunk_counts(chunks: DataFrame, titles: DataFrame, en: list[str] | None = X.EN_ENDINGS) -> DataFrame:
    """One row per chunk: (doc_id, chunk_no, lens, terms, tf_title, tf_body, n_rows, sum_len), the four lists of equal size.

    ``chunks``: doc_id, chunk_no, text, n_words · ``titles``: any number of rows (doc_id, title). The texts are dealt once, with the
    terms of their titles, and counted in the row; postings are neither shuffled nor written with their keys. Chunks with equal keys
    lie in one row: a term is counted once for each of their lengths. ``n_rows`` and ``sum_len`` tell how many they are and how long.
    """
    pattern, groups = stem_pattern(X.RU_ENDINGS, en)
    kept = "".join(f"\\{i + 1}" for i in range(groups))
    keys = ["doc_id", "chunk_no"]

    def work(batches):
        for batch in batches:
            texts, heads = batch.column("words"), batch.column("title_terms")
            inner = texts.flatten()
            row = np.repeat(np.arange(len(batch), dtype=np.int64), list_sizes(texts))
            length = batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
            wide = int(length.max(initial=0)) + 1
            # texts of one chunk that are equally long are one unit
            units, unit, number = np.unique(row * wide + length, return_inverse=True, return_counts=True)
            found = inner.flatten().dictionary_encode()
            cut = pc.replace_substring_regex(found.dictionary.cast(pa.string()), pattern, kept)
            terms = pa.concat_arrays([cut, heads.flatten().cast(pa.string())]).dictionary_encode()
            size, code = max(1, len(terms.dictionary)), terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            body = np.repeat(unit, list_sizes(inner)) * size + code[:len(cut)][found.indices.to_numpy(zero_copy_only=False)]
            # a title counts for each unit of its row, as often as the unit has texts
            n_head = list_sizes(heads)
            of_unit = units // wide
            n_title = n_head[of_unit]
            first = np.concatenate([[0], np.cumsum(n_head)])[of_unit]
            place = np.arange(n_title.sum()) - np.repeat(np.cumsum(n_title) - n_title, n_title) + np.repeat(first, n_title)
            head = np.repeat(np.arange(len(units)), n_title) * size + code[len(cut):][place]
            tf_head = batch.column("title_tf").flatten().to_numpy(zero_copy_only=False)[place] * np.repeat(number, n_title)
            key = np.concatenate([body, head])
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[order], prepend=-1))
            pair, at = key[order][new], np.empty(len(key), np.int64)
            at[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
            tf_body = np.bincount(at[:len(body)], minlength=len(pair))
            tf_title = np.bincount(at[len(body):], tf_head, len(pair)).astype(np.int64)
            owner = pair // size
            starts = pa.array(np.searchsorted(of_unit[owner], np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.array(units[owner] % wide, pa.int64()), terms.dictionary.take(pa.array(pair % size)), pa.array(tf_title, pa.int64()), pa.array(tf_body, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *[pa.ListArray.from_arrays(starts, x) for x in lists],
                                              pa.array(list_sizes(texts), pa.int64()), pa.array(np.bincount(row, length, len(batch)).astype(np.int64))], names)

    head = (titles.select("doc_id", F.explode(stems(F.col("title"), en)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
            .groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("head")))
    kind = "array<struct<term:string,tf:bigint>>"
    rows = chunks.select(*keys, F.struct("n_words", "text").alias("one"), F.lit(None).cast(kind).alias("head")).unionByName(
        chunks.select(*keys).join(head, "doc_id").select(*keys, F.lit(None).cast("struct<n_words:int,text:string>").alias("one"), F.col("head").cast(kind)))
    parts = max(1, -(-chunks.count() // PART))
    whole = rows.repartition(parts, *keys).groupBy(*keys).agg(F.collect_list("one").alias("texts"), F.first("head", ignorenulls=True).alias("head"))
    whole = whole.withColumn("head", F.coalesce("head", F.expr(f"cast(array() as {kind})")))
    length = F.aggregate("head", F.lit(0).cast("bigint"), lambda a, h: a + h["tf"])
    sized = whole.select(*keys, F.transform("texts", lambda x: x["n_words"] + length).alias("sizes"), F.transform("texts", lambda x: low_words(x["text"])).alias("words"),
                         F.transform("head", lambda h: h["term"]).alias("title_terms"), F.transform("head", lambda h: h["tf"]).alias("title_tf"))
    numbers = T.ArrayType(T.LongType())
    schema = T.StructType([*[chunks.schema[c] for c in keys], T.StructField("lens", numbers), T.StructField("terms", T.ArrayType(T.StringType())),
                           T.StructField("tf_title", numbers), T.StructField("tf_body", numbers), T.StructField("n_rows", T.LongType()), T.StructField("sum_len", T.LongType())])
    names = schema.names
    return sized.mapInArrow(work, schema)


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


PAGE = 256


def vocabulary_pages(vocabulary: DataFrame) -> DataFrame:
    """(start, page, term): terms in order, in pages of ``PAGE`` terms with the same first two letters."""
    start = F.left("term", F.lit(2))
    place = F.row_number().over(Window.partitionBy("start").orderBy("term")) - 1
    return vocabulary.select(start.alias("start"), "term").withColumn("page", F.floor(place / PAGE).cast("int")).select("start", "page", "term")


def build_index(documents: DataFrame, chunks: DataFrame, aliases: DataFrame, write=None, en: list[str] | None = X.EN_ENDINGS) -> TextIndex:
    """Write the index once; chunks are cut once and read back for postings, scoring and display.

    documents: doc_id, path, title, … · chunks: doc_id, chunk_no, text · aliases: canonical (a path), alias
    ``write(name, frame)`` says where the tables go.
    """
    write = write or (lambda name, df: materialise(df, name))
    docs = write("documents", documents)
    cut = write("chunks", chunks.withColumn("n_words", F.size(words(F.col("text")))).withColumn("fingerprint", F.sha1("text")))
    other = aliases.join(docs.select("doc_id", F.col("path").alias("canonical")), "canonical").select("doc_id", F.col("alias").alias("title"))
    titles = docs.select("doc_id", "title").unionByName(other)
    counts = write("counts", chunk_counts(cut, titles, en))
    sums = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.sum("sum_len").alias("all"))
    stats = write("stats", sums.select("n", (F.col("all") / F.nullif(F.col("n"), F.lit(0))).alias("avg_len")))
    pages = vocabulary_pages(counts.select(F.explode("terms").alias("term")).distinct())
    return TextIndex(docs, cut, counts, stats, write("terms", pages))


def question_terms(questions: DataFrame, stop_words: list[str] = X.KB_STOP_WORDS, en: list[str] | None = X.EN_ENDINGS) -> DataFrame:
    """(question_id, term_no, stem)."""
    return questions.select("question_id", F.posexplode(query_stems(F.col("text"), stop_words, en)).alias("term_no", "stem"))


def shorter_stems(stems_: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(stem, short): the longest known term that starts the stem, up to three letters shorter and at least four long."""
    low = F.greatest(F.lit(4), F.length("stem") - 3)
    starts = stems_.filter(low <= F.length("stem") - 1).select("stem", F.explode(F.transform(
        F.sequence(low, F.length("stem") - 1), lambda k: F.substring(F.col("stem"), F.lit(1), k))).alias("term"))
    return (starts.join(vocabulary.select("term"), "term").groupBy("stem")
            .agg(F.max_by("term", F.length("term")).alias("short")))


def prefix_pages(stems_: DataFrame, terms: DataFrame) -> DataFrame:
    """(stem, start, page): the pages of the vocabulary in which terms that start with the stem can lie.

    A stem's terms lie together, from the stem itself on; the first and last term of a page tell whether it meets them.
    """
    fences = terms.groupBy("start", "page").agg(F.min("term").alias("first"), F.max("term").alias("last"))
    asked = stems_.filter(F.length("stem") >= 2).withColumn("start", F.left("stem", F.lit(2)))
    meets = (F.col("last") >= F.col("stem")) & (F.left("first", F.length("stem")) <= F.col("stem"))
    return asked.join(fences, "start").filter(meets).select("stem", "start", "page")


def prefix_terms(stems_: DataFrame, terms: DataFrame) -> DataFrame:
    """(stem, term): every known term that starts with the stem, found in the sorted pages that hold such terms."""
    pages = prefix_pages(stems_, terms)
    return terms.join(pages, ["start", "page"]).filter(F.startswith("term", "stem")).select("stem", "term")


def phrase_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(stem, phrase, term): a stem searches terms that start with it, and its shorter stem exactly. ``vocabulary`` in pages."""
    distinct = terms.select("stem").distinct()
    prefix = prefix_terms(distinct, vocabulary).select("stem", F.lit("prefix").alias("phrase"), "term")
    short = shorter_stems(distinct, vocabulary).select("stem", F.lit("short").alias("phrase"), F.col("short").alias("term"))
    return prefix.unionByName(short)


def idf(df: Column, n: Column) -> Column:
    plain = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(plain <= 0, F.lit(IDF_FLOOR)).otherwise(plain)


def bm25(freq: Column, df: Column, length: Column, n: Column, avg_len: Column) -> Column:
    return idf(df, n) * (freq * (K1 + 1)) / (freq + K1 * (1 - B + B * length / avg_len))


ASKED = 400_000  # stems, or terms of questions, that a task holds at once, about
SLICE = 4_000  # chunks that are scored together
KINDS = ["prefix", "short"]


class Lookup:
    """Which stems search a term: those that it starts with, and those whose shorter stem it is. Told for each term that is met.

    A phrase is a number: twice its stem's number and its kind. What is held grows with the stems, not with the vocabulary.
    """

    def __init__(self, rows: pa.Table):
        self.stems = np.unique(rows.column("stem").to_numpy().astype(str))
        number = {s: i for i, s in enumerate(self.stems.tolist())}
        self.prefixes = {s: 2 * i for s, i in number.items() if len(s) >= 2}
        self.lengths = sorted({len(s) for s in self.prefixes})
        self.shorts = {}
        for stem_, short in set(zip(rows.column("stem").to_pylist(), rows.column("short").to_pylist())):
            if short is not None:
                self.shorts.setdefault(short, []).append(2 * number[stem_] + 1)
        self.forget()

    def forget(self):
        self.place, self.first, self.phrase = {}, [0], []

    def meet(self, term: str) -> int:
        self.phrase += [self.prefixes[term[:k]] for k in self.lengths if k <= len(term) and term[:k] in self.prefixes]
        self.phrase += self.shorts.get(term, ())
        self.first.append(len(self.phrase))
        at = self.place[term] = len(self.first) - 2
        return at

    def found(self, lists: pa.Array, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, phrase, posting) of each posting of a phrase; a unit is a chunk, or chunks with equal keys and lengths."""
        terms = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lists), dtype=np.int64), list_sizes(lists))
        if not len(row):
            return (np.zeros(0, np.int64),) * 3
        if len(self.place) >= WORDS_KEPT:
            self.forget()
        at = np.array([self.meet(t) if (i := self.place.get(t)) is None else i for t in terms.dictionary.to_pylist()], np.int64)
        at = at[terms.indices.to_numpy(zero_copy_only=False)]
        first, phrase = np.array(self.first, np.int64), np.array(self.phrase, np.int64)
        number = first[at + 1] - first[at]
        other = np.ones(len(row), bool)
        other[1:] = (row[1:] != row[:-1]) | (lens[1:] != lens[:-1])
        posting = np.repeat(np.arange(len(row)), number)
        return (np.cumsum(other) - 1)[posting], phrase[np.arange(len(posting)) - np.repeat(np.cumsum(number) - number - first[at], number)], posting


def slices(batches):
    for batch in batches:
        for lo in range(0, len(batch), SLICE):
            yield batch.slice(lo, SLICE)


def in_groups(rows: DataFrame, key: str) -> list[DataFrame]:
    """Rows dealt by a key to groups of about ``ASKED``, each of which fits a task and the driver."""
    n = max(1, -(-rows.count() // ASKED))
    return [rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


@dataclass
class ChunkScores:
    """BM25 of stems in chunks, computed where a chunk's counts are read: neither postings nor scores are shuffled or written.

    stems(stem, short, idf_prefix, idf_short): written; each pass over the counts takes as many as ``ASKED``.
    """

    counts: DataFrame
    stems: DataFrame
    avg_len: float
    weights: tuple[float, float]

    def lookup(self, of: DataFrame) -> tuple[Lookup, np.ndarray]:
        rows = of.toArrow()
        lookup = Lookup(rows)
        weight = np.zeros(2 * len(lookup.stems))
        at = 2 * np.searchsorted(lookup.stems, rows.column("stem").to_numpy().astype(str))
        for i, k in enumerate(KINDS):
            weight[at + i] = rows.column(f"idf_{k}").to_numpy()
        return lookup, weight

    def scorer(self, lookup: Lookup, idf_of: np.ndarray):
        """A function that gives (row, stem number, score) of a batch of counts."""
        avg_len, (title_weight, body_weight) = self.avg_len, self.weights

        def score(batch):
            lens = batch.column("lens").flatten().to_numpy(zero_copy_only=False)
            unit, phrase, posting = lookup.found(batch.column("terms"), lens)
            title, body = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("tf_title", "tf_body"))
            key = unit * len(idf_of) + phrase
            order = np.argsort(key, kind="stable")
            key, posting = key[order], posting[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            if not len(starts):
                return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
            freq = np.add.reduceat(title[posting] * title_weight + body[posting] * body_weight, starts)
            key, posting = key[starts], posting[starts]
            parts = idf_of[key % len(idf_of)] * (freq * (K1 + 1)) / (freq + K1 * (1 - B + B * lens[posting] / avg_len))
            pair = key // 2
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            row = np.repeat(np.arange(len(batch), dtype=np.int64), list_sizes(batch.column("terms")))
            return row[posting[starts]], pair[starts] % (len(idf_of) // 2), np.add.reduceat(parts, starts)
        return score

    def rows(self) -> DataFrame:
        """(stem, doc_id, chunk_no, score)."""
        keys = ["doc_id", "chunk_no"]
        schema = T.StructType([T.StructField("stem", T.StringType()), *[self.counts.schema[c] for c in keys], T.StructField("score", T.DoubleType())])
        names = schema.names

        def worker(group):
            lookup, idf_of = self.lookup(group)
            score, known = self.scorer(lookup, idf_of), lookup.stems.tolist()

            def work(batches):
                spelt = pa.array(known, pa.string())
                for batch in slices(batches):
                    row, stem_, value = score(batch)
                    yield pa.RecordBatch.from_arrays([spelt.take(pa.array(stem_)), *[batch.column(c).take(pa.array(row)) for c in keys], pa.array(value)], names)
            return work

        return reduce(DataFrame.unionAll, [self.counts.mapInArrow(worker(g), schema) for g in in_groups(self.stems, "stem")])

    def best(self, terms: DataFrame, depth: int, chosen: Column, least: DataFrame | None = None) -> DataFrame:
        """(question_id, doc_id, chunk_no, score, matched): at least the ``depth`` best of the ``chosen`` chunks of each question.

        A task keeps the best it has met of each question. Of a slice of chunks it sums only for questions whose bound, the best scores
        of their stems there, reaches the last place so far, which begins as ``least``.
        """
        kinds = dict(self.counts.dtypes) | dict(terms.dtypes)
        names = ["question_id", "doc_id", "chunk_no", "score", "matched"]
        schema = ", ".join(f"{n} {kinds[n]}" for n in names[:3]) + ", score double, matched bigint"

        def worker(group):
            lookup, idf_of = self.lookup(self.stems.join(group.select("stem").distinct(), "stem", "left_semi"))
            score, stems_ = self.scorer(lookup, idf_of), lookup.stems
            asked = group.select("question_id", "stem").toArrow()
            number = {s: i for i, s in enumerate(stems_.tolist())}
            stem_ = np.array([number.get(s, -1) for s in asked.column("stem").to_pylist()], np.int64)
            code = pc.dictionary_encode(asked.column("question_id").combine_chunks(), null_encoding="encode")
            ids, code = code.dictionary, code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(code, kind="stable")
            order = order[stem_[order] >= 0]
            stem_, starts = stem_[order], np.searchsorted(code[order], np.arange(len(ids) + 1))
            owner = code[order]
            bars = np.full(len(ids), -1.0)
            if least is not None:
                place = {q: i for i, q in enumerate(ids.to_pylist())}
                for q, value in least.collect():
                    if q in place:
                        bars[place[q]] = value - SLACK

            def work(batches):
                held, bar, size = [], bars.copy(), 0

                def cut(tables):
                    """The ``depth`` best of each question, in the order of the ranks."""
                    whole = pa.Table.from_batches(tables)
                    order = [("question", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("chunk_no", "ascending")]
                    whole = whole.take(pc.sort_indices(whole, order, null_placement="at_start"))
                    q = whole.column("question").to_numpy()
                    first = np.flatnonzero(np.diff(q, prepend=-1))
                    place_ = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                    last = place_ == depth - 1
                    bar[q[last]] = np.maximum(bar[q[last]], whole.column("score").to_numpy()[last] - SLACK)
                    return whole.filter(pa.array(place_ < depth)).combine_chunks().to_batches()

                for batch in slices(batches):
                    row, stem_no, value = score(batch)
                    if not len(row):
                        continue
                    by = np.argsort(stem_no, kind="stable")
                    row, stem_no, value = row[by], stem_no[by], value[by]
                    first = np.searchsorted(stem_no, np.arange(len(stems_) + 1))
                    tops = np.zeros(len(stems_))
                    np.maximum.at(tops, stem_no, value)
                    bound = np.bincount(owner, tops[stem_], len(ids))
                    rows, owners, totals, counts = [], [], [], []
                    for at in np.flatnonzero((bound >= bar) & (bound > 0)):
                        own = stem_[starts[at]:starts[at + 1]]
                        picked = np.concatenate([np.arange(first[w], first[w + 1]) for w in own])
                        sums = np.bincount(row[picked], value[picked], len(batch)).round(6)
                        number_ = np.bincount(row[picked], minlength=len(batch))
                        good = np.flatnonzero((number_ > 0) & (sums >= bar[at]))
                        if len(good) > depth:
                            good = good[sums[good] >= np.partition(sums[good], -depth)[-depth]]
                        rows.append(good)
                        owners.append(np.full(len(good), at))
                        totals.append(sums[good])
                        counts.append(number_[good])
                    if not rows:
                        continue
                    taken = pa.array(np.concatenate(rows))
                    held.append(pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), batch.column("doc_id").take(taken), batch.column("chunk_no").take(taken),
                                                            pa.array(np.concatenate(totals)), pa.array(np.concatenate(counts), pa.int64())], ["question", *names[1:]]))
                    size += len(taken)
                    if size > max(2 * depth * len(ids), 50_000):
                        held = cut(held)
                        size = sum(map(len, held))
                if held:
                    for best in cut(held):
                        yield pa.RecordBatch.from_arrays([ids.take(best.column("question")), *[best.column(c) for c in names[1:]]], names)
            return work

        rows = self.counts.filter(chosen)
        return reduce(DataFrame.unionAll, [rows.mapInArrow(worker(g), schema) for g in in_groups(terms, "question_id")])


def stem_counts(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(stem, df_prefix, df_short): how many chunks hold a term of the stem, by kind. Tasks count, only their sums are shuffled."""
    def worker(group):
        lookup = Lookup(group.toArrow())
        known = lookup.stems.tolist()

        def work(batches):
            sums = np.zeros(2 * len(known), np.int64)
            for batch in slices(batches):
                unit, phrase, _ = lookup.found(batch.column("terms"), batch.column("lens").flatten().to_numpy(zero_copy_only=False))
                key = np.sort(unit * len(sums) + phrase, kind="stable")
                sums += np.bincount(key[np.diff(key, prepend=-1) > 0] % max(1, len(sums)), minlength=len(sums))
            held = np.flatnonzero(sums.reshape(-1, 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.string()).take(pa.array(held)), *[pa.array(sums[2 * held + i]) for i in range(2)]], names)
        return work

    names = ["stem", *[f"df_{k}" for k in KINDS]]
    parts = [counts.select("terms", "lens").mapInArrow(worker(g), "stem string, df_prefix bigint, df_short bigint") for g in in_groups(asked, "stem")]
    return reduce(DataFrame.unionAll, parts).groupBy("stem").agg(*[F.sum(c).alias(c) for c in names[1:]])


def asked_stems(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(stem, short): the distinct stems of questions and their shorter stems, see ``phrase_terms``. ``vocabulary`` in pages."""
    distinct = terms.select("stem").distinct()
    return distinct.join(shorter_stems(distinct, vocabulary), "stem", "left")


def chunk_scores(index: TextIndex, asked: DataFrame, title_weight: float = TITLE_WEIGHT, body_weight: float = BODY_WEIGHT) -> ChunkScores:
    """BM25 of each asked stem (stem, short) in each chunk that holds it, for all questions at once, as rows or as the best chunks of questions.

    The terms of a stem are found among those of the chunks, where they are read.
    """
    asked = materialise(asked, "asked-stems")
    n, avg_len = index.stats.select("n", "avg_len").first()
    weights = [idf(F.col(f"df_{k}"), F.lit(n)).alias(f"idf_{k}") for k in KINDS]
    held = stem_counts(index.counts, asked).select("stem", *weights)
    return ChunkScores(index.counts, materialise(asked.join(held, "stem"), "stems"), avg_len, (title_weight, body_weight))


def stem_scores(index: TextIndex, phrases: DataFrame, title_weight: float = TITLE_WEIGHT, body_weight: float = BODY_WEIGHT) -> DataFrame:
    """(stem, doc_id, chunk_no, score) of ``chunk_scores`` for the phrases of ``phrase_terms``."""
    asked = phrases.groupBy("stem").agg(F.max(F.when(F.col("phrase") == "short", F.col("term"))).alias("short"))
    return chunk_scores(index, asked, title_weight, body_weight).rows()


BLOCK = 100_000  # postings of a block, about
PROBE = 16  # one block in so many is scored first, for the thresholds
SLACK = 1e-5  # scores are compared after rounding to six digits


def score_blocks(scores: DataFrame, size: int = BLOCK) -> DataFrame:
    """Postings dealt to blocks of about ``size``; all postings of a chunk lie in one block. Written, as it is read several times."""
    rows = materialise(scores, "scores")
    number = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "chunk_no"), F.lit(number)).cast("int"))


def open_blocks(terms: DataFrame, blocks: DataFrame, least: DataFrame | None) -> DataFrame:
    """(question_id, stem, least, block): the blocks whose bound, the best scores of the question's stems in the block, reaches
    the question's threshold ``least``. Without thresholds every block that holds one of the stems is open."""
    tops = blocks.groupBy("stem", "block").agg(F.max("score").alias("top"))
    rows = terms.select("question_id", "stem").join(tops, "stem")
    rows = rows.join(least, "question_id", "left") if least is not None else rows.withColumn("least", F.lit(None).cast("double"))
    bound = F.sum("top").over(Window.partitionBy("question_id", "block"))
    return (rows.withColumn("bound", bound).filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
            .select("question_id", "stem", "least", "block"))


def best_in_blocks(asked: DataFrame, blocks: DataFrame, depth: int) -> DataFrame:
    """(question_id, doc_id, chunk_no, score, matched): the ``depth`` best chunks of each open block, and ties of the last.

    A task holds one block and the questions that are open there; scores are summed over the block's postings, stem by stem.
    """
    def work(key, questions, postings):
        stems, code = np.unique(postings["stem"].to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(stems) + 1))
        chunk = postings.groupby(["doc_id", "chunk_no"], sort=False).ngroup().to_numpy()
        number = int(chunk.max()) + 1 if len(chunk) else 0
        place = np.zeros(number, np.int64)
        place[chunk] = np.arange(len(chunk))
        chunk, score = chunk[order], postings["score"].to_numpy()[order]
        known = questions[questions["stem"].isin(stems)].sort_values("question_id", kind="stable")
        wanted, least = np.searchsorted(stems, known["stem"].to_numpy()), known["least"].to_numpy(float)
        ids, starts = np.unique(known["question_id"].to_numpy(), return_index=True)
        rows, owners, totals, counts = [], [], [], []
        for at, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(known)])):
            picked = np.concatenate([np.arange(first[w], first[w + 1]) for w in wanted[lo:hi]])
            sums = np.bincount(chunk[picked], score[picked], number).round(6)
            held = np.bincount(chunk[picked], minlength=number)
            bar = least[lo] - SLACK if least[lo] == least[lo] else -1.0
            found = np.flatnonzero((held > 0) & (sums >= bar))
            if len(found) > depth:
                found = found[sums[found] >= np.partition(sums[found], -depth)[-depth]]
            rows.append(place[found])
            owners.append(np.full(len(found), at))
            totals.append(sums[found])
            counts.append(held[found])
        if not rows:
            return pd.DataFrame(columns=names)
        best = postings.iloc[np.concatenate(rows)]
        return pd.DataFrame({"question_id": ids[np.concatenate(owners)], "doc_id": best["doc_id"].to_numpy(), "chunk_no": best["chunk_no"].to_numpy(),
                             "score": np.concatenate(totals), "matched": np.concatenate(counts)})

    kinds = {**dict(asked.dtypes), **dict(blocks.dtypes)}
    names = ["question_id", "doc_id", "chunk_no", "score", "matched"]
    schema = ", ".join(f"{n} {kinds[n]}" for n in names[:3]) + ", score double, matched bigint"
    rows = blocks.select("block", "stem", "doc_id", "chunk_no", "score")
    named = asked.select("question_id", "stem", "least", F.col("block").alias("in_block"))
    return named.groupBy("in_block").cogroup(rows.groupBy("block")).applyInPandas(work, schema)


def thresholds(found: DataFrame, depth: int) -> DataFrame:
    """(question_id, least): the score of each question's chunk number ``depth`` among those found."""
    return (newest(found, ["question_id"], depth, F.col("score").desc(), F.col("doc_id"), F.col("chunk_no"))
            .filter(F.col("rank") == depth).select("question_id", F.col("score").alias("least")))


def candidates(terms: DataFrame, scores: DataFrame | ChunkScores, limit: int = HITS_DEFAULT, chunks_of: DataFrame | None = None) -> DataFrame:
    """The best max(10·limit, 50) chunks per question by BM25, with the number of question terms each holds.

    Some chunks are scored first; what they give as a question's last place is a threshold for the others. Scores of an index are summed
    where its counts are read. Scores given as rows go once to blocks, whatever the number of questions, and a question goes on only to
    blocks whose bound reaches its threshold. Blocks give their best chunks only.
    """
    depth = max(limit * 10, 50)
    order = [F.col("score").desc(), F.col("doc_id"), F.col("chunk_no")]
    if isinstance(scores, ChunkScores):
        if chunks_of is not None:
            scores = replace(scores, counts=scores.counts.join(chunks_of.select("doc_id").distinct(), "doc_id", "left_semi"))
        terms = materialise(terms, "terms")
        probed = F.pmod(F.xxhash64("doc_id", "chunk_no"), F.lit(PROBE)) == 0
        probe = materialise(scores.best(terms, depth, probed), "probed")
        rest = scores.best(terms, depth, ~probed, thresholds(probe, depth))
        return newest(probe.unionByName(rest), ["question_id"], depth, *order, rank="bm25_rank")
    if chunks_of is not None:
        scores = scores.join(chunks_of.select("doc_id").distinct(), "doc_id", "left_semi")
    blocks = score_blocks(scores)
    probed = F.col("block") % PROBE == 0
    first, others = blocks.filter(probed), blocks.filter(~probed)
    probe = materialise(best_in_blocks(open_blocks(terms, first, None), first, depth), "probed")
    rest = best_in_blocks(open_blocks(terms, others, thresholds(probe, depth)), others, depth)
    return newest(probe.unionByName(rest), ["question_id"], depth, *order, rank="bm25_rank")


def rank_candidates(found: DataFrame) -> DataFrame:
    """More distinct question terms first, BM25 among equals."""
    w = Window.partitionBy("question_id").orderBy(F.col("matched").desc(), F.col("score").desc(), "doc_id", "chunk_no")
    return found.withColumn("place", F.row_number().over(w))


def per_doc_cap(ranked: DataFrame, n: int = PER_DOC) -> DataFrame:
    return newest(ranked, ["question_id", "doc_id"], n, F.col("place")).drop("rank")


def same_text_once(ranked: DataFrame) -> DataFrame:
    return newest(ranked, ["question_id", "fingerprint"], 1, F.col("place")).drop("rank")


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with chunk text and document columns; hits whose chunk is gone fall out."""
    return hits.join(chunks, ["doc_id", "chunk_no"]).join(documents, "doc_id")


def pick_hits(ranked: DataFrame, limit: int = HITS_DEFAULT) -> DataFrame:
    """Walk each question's candidates in order: at most two per document, equal texts once, until the limit.

    Both rules look at kept hits only, so this is one fold over at most max(10·limit, 50) candidates.
    """
    n = max(1, min(limit, HITS_MAX))
    kind = "struct<place:int,doc_id:bigint,chunk_no:int,score:double,matched:bigint,fingerprint:string>"
    cols = ["place", "doc_id", "chunk_no", "score", "matched", "fingerprint"]
    row = F.struct(*cols).cast(kind)
    sorted_ = ranked.groupBy("question_id").agg(F.sort_array(F.collect_list(row)).alias("c"))

    def step(kept, c):
        of_doc = F.size(F.filter(kept, lambda k: k["doc_id"] == c["doc_id"]))
        seen = F.exists(kept, lambda k: k["fingerprint"] == c["fingerprint"])
        return F.when((F.size(kept) < n) & (of_doc < PER_DOC) & ~seen, F.concat(kept, F.array(c))).otherwise(kept)

    kept = F.aggregate("c", F.expr(f"cast(array() as array<{kind}>)"), step)
    return (sorted_.select("question_id", F.posexplode(kept).alias("_at", "h"))
            .select("question_id", (F.col("_at") + 1).alias("rank"), "h.*").drop("fingerprint"))


def snippet(text: Column, terms: Column, window: int = 45, step: int = 5, en: list[str] | None = X.EN_ENDINGS,
            stemmed: Column | None = None) -> Column:
    """The window of words with most distinct terms (the first such), hits in brackets. ``terms``: array<struct(stem, short)>.

    ``stemmed``: the stems of the text's words, where they are known.
    """
    found = words(text)
    gaps = F.split(text, X.WORD, -1)
    each = F.transform(found, lambda w: stem(w, en=en)) if stemmed is None else stemmed
    hit_terms = F.transform(each, lambda s: F.transform(
        F.filter(terms, lambda t: s.startswith(t["stem"]) | F.coalesce(s == t["short"], F.lit(False))), lambda t: t["stem"]))
    row = F.struct(found.alias("words"), gaps.alias("gaps"), hit_terms.alias("hits"))
    return F.when(F.size(found) == 0, F.substring(text, 1, 300)).otherwise(_window(row, window, step))


def _window(row: Column, window: int, step: int) -> Column:
    n = F.size(row["words"])
    # a one-element transform names the row once, so that its arrays are computed once
    named = F.transform(F.array(row), lambda r: _render(r, window, step))
    return F.when(n > 0, F.element_at(named, 1))


def _render(r: Column, window: int, step: int) -> Column:
    n = F.size(r["words"])
    scored = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: F.struct(
        F.size(F.array_distinct(F.flatten(F.slice(r["hits"], s + 1, window)))).alias("k"), (-s).alias("back")))
    best = F.transform(F.array(F.array_max(scored)), lambda b: F.struct((-b["back"]).alias("a"), F.least(-b["back"] + window, n).alias("b")))

    def text_of(span):
        body = F.transform(F.sequence(span["a"], span["b"] - 1), lambda i: F.concat(
            F.when(i == span["a"], F.lit("")).otherwise(F.get(r["gaps"], i)),
            F.when(F.size(F.get(r["hits"], i)) > 0, F.concat(F.lit("["), F.get(r["words"], i), F.lit("]"))).otherwise(F.get(r["words"], i))))
        before = F.when((span["a"] > 0) | (F.get(r["gaps"], F.lit(0)) != ""), "…").otherwise("")
        after = F.when((span["b"] < n) | (F.get(r["gaps"], n) != ""), "…").otherwise("")
        return F.concat(before, F.replace(F.array_join(body, ""), F.lit("\n"), F.lit(" ")), after)

    return F.element_at(F.transform(best, text_of), 1)


def with_snippets(hits: DataFrame, terms: DataFrame, shorts: DataFrame) -> DataFrame:
    """Hits (with text) and their snippet. The terms of a question are a short list, so collecting them is bounded.

    The stems of a place's words are gathered by question and rank: hits with equal keys share them.
    """
    per = (terms.join(shorts, "stem", "left").groupBy("question_id")
           .agg(F.collect_list(F.struct("stem", "short")).alias("terms")))
    cut = (hits.select("question_id", "rank", F.posexplode(low_words(F.col("text"))).alias("at", "word"))
           .select("question_id", "rank", "at", cut_ending(F.col("word"), en=X.EN_ENDINGS).alias("term"))
           .groupBy("question_id", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "term"))).alias("_cut")))
    rows = hits.join(per, "question_id").join(cut, ["question_id", "rank"], "left")
    known = F.transform("_cut", lambda c: c["term"])
    return rows.withColumn("snippet", snippet(F.col("text"), F.col("terms"), stemmed=known)).drop("terms", "_cut")


def search(index: TextIndex, questions: DataFrame, limit: int = HITS_DEFAULT, product: str | None = None) -> DataFrame:
    """Ranked hits of every question, with snippets. Texts are read for the hits alone, the others are compared by fingerprint."""
    terms = materialise(question_terms(questions), "question-terms")
    scores = chunk_scores(index, asked_stems(terms, index.terms))
    only = index.documents.filter(F.col("product") == product) if product else None
    found = materialise(rank_candidates(candidates(terms, scores, limit, only)), "found")
    texts = found.join(index.chunks.select("doc_id", "chunk_no", "fingerprint"), ["doc_id", "chunk_no"])
    shown = materialise(hydrate(materialise(pick_hits(texts, limit), "hits"), index.chunks, index.documents), "shown")
    return with_snippets(shown, terms, shorter_stems(terms.select("stem").distinct(), index.terms)).drop("text", "n_words", "fingerprint")
