"""Search in code blocks for a table of questions: substring index, candidates, reranking, display.

Blocks are rows (file_id, line_start, path, name, doc, body, kind, object_name, is_export …); the
pair (file_id, line_start) names a block.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.functions import fixed as X
from deskmill.functions.text import bind, fold, is_identifier, stem, strip, words
from deskmill.operators.chunking import START
from deskmill.operators.ordered import newest
from deskmill.operators.search import bm25
from deskmill.session import materialise

# Column weights, field weights, candidate list sizes, display limits.
WEIGHTS = {"path": 3.0, "name": 10.0, "doc": 4.0, "body": 1.0}
FIELD_WEIGHTS = {"name": 1.0, "doc": 0.7, "path": 0.6, "body": 0.35}
LIST_SIZES = {"any": 400, "any_head": 200, "all": 100, "all_head": 150}
HEAD = ["name", "doc"]
COLUMNS = ["path", "name", "doc", "body"]
KEY = ["file_id", "line_start"]
SNIPPET_LINES, SNIPPET_WIDTH, OUTPUT_CHARS = 6, 160, 12000
GAP = "\u0001"


def parse_query(questions: DataFrame, stop_words: list[str] = X.CODE_STOP_WORDS, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(question_id, term_no, base, exact, variants). Names from code stay whole, other words are stemmed and get synonyms."""
    known = {**X.SYNONYMS, **(synonyms or {})}
    pairs = [F.lit(x) for k, v in known.items() for x in (k, F.array(*[F.lit(s.lower().replace("ё", "е")) for s in v if len(s) >= 3]))]
    table = F.create_map(*pairs)

    def term(w):
        exact, low = is_identifier(w), F.lower(fold(w))
        return F.struct(F.when(exact, low).otherwise(stem(w)).alias("base"), exact.alias("exact"), low.alias("low"))

    found = F.transform(words(F.col("text"), X.CODE_WORD), term)
    found = F.filter(found, lambda t: ~t["low"].isin(stop_words) & (F.length(t["base"]) >= 3))
    first = bind(found, lambda ts: bind(F.transform(ts, lambda t: t["base"]), lambda bases: F.filter(
        F.transform(ts, lambda t, i: F.when(F.array_position(bases, t["base"]) == i + 1, t)), lambda t: t.isNotNull())))
    rows = questions
    each = rows.select("question_id", F.posexplode(first).alias("term_no", "_t"))
    none = F.expr("cast(array() as array<string>)")
    more = F.when(F.col("_t.exact"), none).otherwise(F.coalesce(F.try_element_at(table, F.col("_t.base")), none))
    return each.select("question_id", "term_no", F.col("_t.base").alias("base"), F.col("_t.exact").alias("exact"),
                       F.array_distinct(F.concat(F.array("_t.base"), more)).alias("variants"))


def structure_intent(terms: DataFrame, stems: list[str] = X.STRUCTURE_STEMS) -> DataFrame:
    """(question_id, wants_structure): does a question ask what an object consists of."""
    return terms.groupBy("question_id").agg(F.bool_or(F.col("base").isin(stems)).alias("wants_structure"))


def grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(fold(text)), F.lit("(?s)(?=(...))"), F.lit(1)))


PIECE = 1 << 20  # letters that are cut into grams at a time


def gram_lists(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(numbers of the texts, first place of each gram's numbers, grams): the texts with each gram, in the order of grams, each text once."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), []
    # letters by their place among those that occur, so that a gram and its text make one small number
    occurs = np.zeros(0x110000, bool)
    occurs[letters] = True
    alphabet, place = np.flatnonzero(occurs), (np.cumsum(occurs) - 1)[letters]
    size, number = len(alphabet), len(texts)
    inside = owner[:-2] == owner[2:]
    code, owner = ((place[:-2] * size + place[1:-1]) * size + place[2:])[inside], owner[:-2][inside]
    if size ** 3 * number < 1 << 62:
        pair = np.sort(code * number + owner)
        pair = pair[np.diff(pair, prepend=-1) != 0]
        code, owner = np.divmod(pair, number)
    else:
        order = np.lexsort((owner, code))
        code, owner = code[order], owner[order]
        new = (np.diff(code, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0)
        code, owner = code[new], owner[new]
    first = np.flatnonzero(np.diff(code, prepend=-1) != 0)
    known = code[first]
    spelt = alphabet[np.stack([known // (size * size), known // size % size, known % size], 1)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return owner, np.append(first, len(code)), [spelt[i:i + 3] for i in range(0, len(spelt), 3)]


def pieces(texts: list[str]):
    """(first, end) of runs of texts of about ``PIECE`` letters."""
    ends = np.cumsum([len(x) for x in texts])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
        yield lo, hi
        lo = hi


def whole_texts(blocks: DataFrame) -> DataFrame:
    whole = F.concat_ws(GAP, *COLUMNS)
    return blocks.filter(F.length(whole) >= 3).select(*KEY, F.lower(fold(whole)).alias("whole"))


def key_fields(blocks: DataFrame) -> list[T.StructField]:
    return [T.StructField(k, blocks.schema[k].dataType) for k in KEY]


def trigram_index(blocks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(gram, file_id, line_start): every three letters of every column; ``only`` keeps the grams that are asked for."""
    def work(batches):
        for batch in batches:
            texts = batch.column("whole").to_pylist()
            for lo, hi in pieces(texts):
                owner, first, found = gram_lists(texts[lo:hi])
                taken = pa.array(owner + lo, pa.int64())
                spelt = pa.array(found, pa.string()).take(pa.array(np.repeat(np.arange(len(found)), np.diff(first))))
                yield pa.RecordBatch.from_arrays([spelt, *[batch.column(k).take(taken) for k in KEY]], ["gram", *KEY])

    schema = T.StructType([T.StructField("gram", T.StringType()), *key_fields(blocks)])
    found = whole_texts(blocks).mapInArrow(work, schema)
    return found.join(only, "gram", "left_semi") if only is not None else found


def gram_places(blocks: DataFrame) -> DataFrame:
    """(gram, n, places): the keys of the blocks with a gram, in one row for each gram of a piece of the table."""
    def work(batches):
        for batch in batches:
            texts = batch.column("whole").to_pylist()
            for lo, hi in pieces(texts):
                owner, first, found = gram_lists(texts[lo:hi])
                taken = pa.array(owner + lo, pa.int64())
                keys = pa.StructArray.from_arrays([batch.column(k).take(taken) for k in KEY], KEY)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.diff(first)), pa.ListArray.from_arrays(
                    pa.array(first, pa.int32()), keys)], ["gram", "n", "places"])

    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("places", T.ArrayType(T.StructType(key_fields(blocks))))])
    return whole_texts(blocks).mapInArrow(work, schema)


@dataclass
class GramIndex:
    """Written tables: blocks with their length, grams(gram, n, places) of all blocks in the order of grams, where ``places`` are the
    keys of n blocks, counts(gram, df) and stats(n, avg_len)."""

    blocks: DataFrame
    grams: DataFrame
    counts: DataFrame
    stats: DataFrame


def build_gram_index(blocks: DataFrame, write=None) -> GramIndex:
    """Write the index of the blocks once; ``write(name, frame)`` says where the tables go.

    Each file of grams is in their order, so that a reader of some grams passes over the rest of it; nothing is shuffled for it.
    """
    write = write or (lambda name, df: materialise(df, name))
    return index_grams(write("blocks", with_length(blocks)), write)


def with_length(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("len", block_length())


def index_grams(sized: DataFrame, write) -> GramIndex:
    """The index of blocks that are written already, with their length."""
    found = write("grams", gram_places(sized).sortWithinPartitions("gram"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    return GramIndex(sized, found, write("counts", found.groupBy("gram").agg(F.sum("n").alias("df"))), write("stats", stats))


def anchors(variants: DataFrame, counts: DataFrame) -> DataFrame:
    """(variant, gram): the rarest gram of each variant; variants with an unknown gram occur nowhere and fall out."""
    asked = variants.select("variant", F.explode(grams(F.col("variant"))).alias("gram"))
    return (asked.join(counts, "gram", "left").groupBy("variant")
            .agg(F.min(F.struct("df", "gram")).alias("a"), F.bool_or(F.col("df").isNull()).alias("lost"))
            .filter(~F.col("lost")).select("variant", F.col("a.gram").alias("gram")))


def occurrences(text: Column, v: Column) -> Column:
    """Occurrences of v, overlapping ones included."""
    plain = ((F.length(text) - F.length(F.replace(text, v, F.lit("")))) / F.length(v)).cast("int")
    overlaps = F.exists(F.sequence(F.lit(1), F.length(v) - 1), lambda k: F.left(v, k) == F.right(v, k))
    return F.when(plain == 0, 0).when(overlaps & (plain > 0), F.regexp_count(text, F.concat(F.lit(r"(?=\Q"), v, F.lit(r"\E)")))).otherwise(plain)


def proposals(index: GramIndex, variants: DataFrame) -> DataFrame:
    """(variant, file_id, line_start): blocks with a variant's rarest gram, from the index alone."""
    held = index.grams.join(anchors(variants, index.counts), "gram")
    return held.select("variant", F.explode("places").alias("p")).select("variant", *[f"p.{k}" for k in KEY])


TOKENS_KEPT = 200_000  # tokens whose variants a task remembers
TOKEN = re.compile(r"\w{3,}")


def overlapping(text: str, v: str) -> int:
    n, at = 0, text.find(v)
    while at >= 0:
        n, at = n + 1, text.find(v, at + 1)
    return n


class VariantCounter:
    """Counts variants of three letters or more in texts, overlapping occurrences included.

    A variant of word characters lies inside a run of them, so each different run is looked at once and remembered; it is
    asked at every place for the variants that begin with the three letters there. Other variants are looked for in the text.
    """

    def __init__(self):
        self.number, self.spelt, self.starts, self.other, self.known = {}, [], {}, [], {}

    def add(self, variants) -> None:
        for v in variants:
            if v not in self.number:
                self.number[v] = len(self.spelt)
                self.spelt.append(v)
                if re.fullmatch(r"\w+", v):
                    self.starts.setdefault(v[:3], []).append(v)
                else:
                    self.other.append(v)
                self.known.clear()

    def inside(self, token: str) -> list[str]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= TOKENS_KEPT:
                self.known.clear()
            found = [v for i in range(len(token) - 2) for v in self.starts.get(token[i:i + 3], ()) if token.startswith(v, i)]
            if len(token) <= 64:
                self.known[token] = found
        return found

    def count(self, text: str) -> Counter:
        total, known = Counter(), self.known
        for token, n in Counter(TOKEN.findall(text)).items():
            found = known.get(token)
            for v in self.inside(token) if found is None else found:
                total[v] = total.get(v, 0) + n
        for v in self.other:
            n = overlapping(text, v)
            if n:
                total[v] = n
        return total

    def count_rows(self, columns: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the variant, its counts in each column) of every variant that a row holds; tokens are numbers from the first on."""
        n, size = len(columns[0]), max(1, len(self.spelt))
        found = [TOKEN.findall(x) for texts in columns for x in texts]
        tokens = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
        lists = [[self.number[v] for v in self.inside(w)] for w in tokens.dictionary.to_pylist()]
        held, first = np.array([v for vs in lists for v in vs], np.int64), np.cumsum([0, *map(len, lists)])
        code = np.repeat(np.arange(len(found)), [len(ws) for ws in found]) * max(1, len(lists)) + tokens.indices.to_numpy()
        pair, times = np.unique(code, return_counts=True)
        text, token = np.divmod(pair, max(1, len(lists)))
        many = (first[1:] - first[:-1])[token]
        each = np.repeat(np.arange(len(pair)), many)
        variant = held[np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[token], many)]
        text, times = text[each], times[each]
        more = [(i, self.number[v], k) for i, x in enumerate(x for texts in columns for x in texts) for v in self.other if (k := overlapping(x, v))]
        if more:
            text, variant, times = (np.concatenate([old, np.array(new, np.int64)]) for old, new in zip((text, variant, times), zip(*more)))
        entry, at = np.unique(text % max(1, n) * size + variant, return_inverse=True)
        counts = np.bincount(at * len(columns) + text // max(1, n), times, len(entry) * len(columns)).astype(np.int64)
        return entry // size, entry % size, counts.reshape(-1, len(columns))


ROWS = 2_000  # blocks whose texts a task looks at together, about


def variant_hits(index: GramIndex, variants: DataFrame) -> DataFrame:
    """(variant, file_id, line_start, len, tf_path, tf_name, tf_doc, tf_body) of all blocks that hold a variant.

    The rarest gram proposes blocks, the text decides: only proposed blocks give their text. What is shuffled for a block is the numbers
    of the grams that propose it; the variants, whose size is that of the question table, meet the texts group by group.
    """
    asked = materialise(anchors(variants, index.counts).groupBy("gram").agg(F.collect_list("variant").alias("vs"))
                        .withColumn("g", F.monotonically_increasing_id()), "anchors")
    proposed = (index.grams.join(asked.select("gram", "g"), "gram").select("g", F.explode("places").alias("p"))
                .groupBy(*[F.col(f"p.{k}").alias(k) for k in KEY]).agg(F.collect_list("g").alias("gs")))
    low = [F.lower(fold(F.col(c))).alias(c) for c in COLUMNS]
    number = max(1, -(-index.stats.first()["n"] // ROWS))
    rows = index.blocks.join(proposed, KEY).select(F.pmod(F.xxhash64(*KEY), F.lit(number)).cast("int").alias("group"), *KEY, "len", "gs", *low)
    names = ["variant", *KEY, "len", *[f"tf_{c}" for c in COLUMNS]]
    schema = T.StructType([T.StructField("variant", T.StringType()), *[T.StructField(k, index.blocks.schema[k].dataType) for k in (*KEY, "len")],
                           *[T.StructField(f"tf_{c}", T.IntegerType()) for c in COLUMNS]])
    counter = VariantCounter()

    def work(terms, blocks):
        grams_of = np.unique(terms.column("g").to_numpy())
        lists = terms.column("vs").combine_chunks()
        words_of = lists.flatten().to_pylist()
        counter.add(words_of)
        # the gram that proposes each of the counter's variants
        by = np.full(len(counter.spelt), -1, np.int64)
        by[[counter.number[v] for v in words_of]] = np.searchsorted(grams_of, np.repeat(terms.column("g").to_numpy(), pc.list_value_length(lists).to_numpy()))
        texts = [blocks.column(c).to_pylist() for c in COLUMNS]
        whole = [i for i, each in enumerate(zip(*texts)) if None not in each]
        row, variant, counts = counter.count_rows([[t[i] for i in whole] for t in texts])
        row = np.array(whole, np.int64)[row]
        # what is found is given as often as it was proposed, which is more than once where a block's key repeats
        proposals_of = blocks.column("gs").combine_chunks()
        size, at = max(1, len(grams_of)), np.repeat(np.arange(len(blocks)), pc.list_value_length(proposals_of).to_numpy())
        pairs = np.sort(at * size + np.searchsorted(grams_of, proposals_of.flatten().to_numpy()))
        key = np.where(by[variant] < 0, -1, row * size + by[variant])
        each = np.repeat(np.arange(len(key)), np.searchsorted(pairs, key, "right") - np.searchsorted(pairs, key))
        taken, counts = pa.array(row[each]), counts[each].astype(np.int32)
        spelt = pa.array(counter.spelt, pa.string()).take(pa.array(variant[each]))
        return pa.Table.from_arrays([spelt, *[blocks.column(k).take(taken) for k in (*KEY, "len")], *[pa.array(counts[:, i]) for i in range(len(COLUMNS))]], names)

    groups = F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    terms = asked.select("g", "vs", groups.alias("in_group"))
    return terms.groupBy("in_group").cogroup(rows.groupBy("group")).applyInArrow(work, schema)


def block_length() -> Column:
    return sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in COLUMNS[1:]), F.greatest(F.length("path") - 2, F.lit(0)))


GROUP = 2_000_000  # hits of a group of blocks, about
PROBE = 16  # one group in so many is looked at first, for the thresholds
SLACK = 1e-5  # scores are compared after rounding to six digits


def best_in_groups(asked: DataFrame, scored: DataFrame) -> DataFrame:
    """(question_id, list_no, file_id, line_start, score): the best blocks of each group for each of a question's lists.

    A task holds the hits of one group of blocks and all terms. ``asked`` has question_id, term_no, v, n_terms, the group and a
    least score per list (least_0 …); ``scored`` has v, the block's key, its group and the scores in all columns (s_0) and in the head (s_1).
    """
    sizes = [LIST_SIZES[x] for x in ("any", "any_head", "all", "all_head")]
    kinds = dict(scored.dtypes)
    schema = f"question_id {dict(asked.dtypes)['question_id']}, list_no int, " + ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", score double"
    names = ["question_id", "list_no", *KEY, "score"]

    def work(key, terms, hits):
        if not len(terms) or not len(hits):
            return pd.DataFrame(columns=names)
        block = hits.groupby(KEY, sort=False).ngroup().to_numpy()
        number = int(block.max()) + 1
        place = np.zeros(number, np.int64)
        place[block] = np.arange(len(block))
        keys = [hits[k].to_numpy()[place] for k in KEY]
        known, code = np.unique(hits["v"].to_numpy(), return_inverse=True)
        # a block's key may repeat; the hits of a variant in it are one entry then
        pair, at = np.unique(code.astype(np.int64) * number + block, return_inverse=True)
        scores = [np.bincount(at, hits[c].to_numpy(float), len(pair)) for c in ("s_0", "s_1")]
        first, block = np.searchsorted(pair, np.arange(len(known) + 1) * number), pair % number
        terms = terms[terms["v"].isin(known)].sort_values(["question_id", "term_no"], kind="stable")
        wanted, term_no = np.searchsorted(known, terms["v"].to_numpy()), terms["term_no"].to_numpy()
        least = [terms[f"least_{i}"].to_numpy(float) for i in range(len(sizes))]
        n_terms = terms["n_terms"].to_numpy()
        ids, starts = np.unique(terms["question_id"].to_numpy(), return_index=True)
        out = []
        for q, lo, hi in zip(ids, starts, [*starts[1:], len(terms)]):
            span = range(lo, hi)
            picked = np.concatenate([np.arange(first[wanted[i]], first[wanted[i] + 1]) for i in span])
            owner = np.concatenate([np.full(first[wanted[i] + 1] - first[wanted[i]], term_no[i]) for i in span])
            once = len(np.unique(term_no[lo:hi])) == hi - lo
            for head, column in enumerate(scores):
                use = column[picked] > 0
                rows, terms_of = picked[use], owner[use]
                sums = np.bincount(block[rows], column[rows], number).round(6)
                # a term with several variants is held once
                held = block[rows] if once else np.unique(terms_of.astype(np.int64) * number + block[rows]) % number
                held = np.bincount(held, minlength=number)
                lists = [(head, held > 0)] + ([(head + 2, held == n_terms[lo])] if n_terms[lo] > 1 else [])
                for no, fits in lists:
                    bar = least[no][lo]
                    found = np.flatnonzero(fits & (sums >= bar - SLACK) if bar == bar else fits)
                    if len(found) > sizes[no]:
                        found = found[sums[found] >= np.partition(sums[found], -sizes[no])[-sizes[no]]]
                        found = found[np.lexsort([*[k[found] for k in reversed(keys)], -sums[found]])][:sizes[no]]
                    if len(found):
                        out.append(pd.DataFrame({"question_id": q, "list_no": no, **{n: k[found] for n, k in zip(KEY, keys)}, "score": sums[found]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    return asked.groupBy("in_group").cogroup(scored.groupBy("group")).applyInPandas(work, schema)


def candidate_lists(terms: DataFrame, hits: DataFrame, stats: DataFrame, size: int = GROUP) -> DataFrame:
    """(question_id, list_no, list_rank, file_id, line_start, score): up to four lists per question.

    Any term or all terms (only with two or more), in all columns or in name and description. ``hits`` is a written table.

    Hits go once to groups of about ``size``, whatever the number of questions, and are summed there; no row is made per question
    and hit. A few groups are looked at first: the last score of a list among them is its threshold for the others.
    """
    number = max(1, -(-hits.count() // size))
    freqs = [sum((F.col(f"tf_{c}") * WEIGHTS[c] for c in columns[1:]), F.col(f"tf_{columns[0]}") * WEIGHTS[columns[0]]) for columns in (COLUMNS, HEAD)]
    # variants are known by number from here on
    df = materialise(hits.groupBy("variant").agg(*[F.count_if(f > 0).alias(f"df_{i}") for i, f in enumerate(freqs)])
                     .withColumn("v", F.monotonically_increasing_id()), "variants")
    n, avg_len = stats.select("n").scalar(), stats.select("avg_len").scalar()
    scored = hits.join(df, "variant").select("v", *KEY, F.pmod(F.xxhash64(*KEY), F.lit(number)).cast("int").alias("group"), *[
        F.when(f > 0, bm25(f, F.col(f"df_{i}"), F.col("len"), n, avg_len)).otherwise(0.0).alias(f"s_{i}") for i, f in enumerate(freqs)])
    n_terms = terms.groupBy("question_id").agg(F.count("*").alias("n_terms"))
    asked = materialise(terms.select("question_id", "term_no", F.explode("variants").alias("variant")).join(df.select("variant", "v"), "variant")
                        .join(n_terms, "question_id").select("question_id", "term_no", "v", "n_terms"), "asked")
    groups = F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    sizes = [LIST_SIZES[x] for x in ("any", "any_head", "all", "all_head")]

    def best(limits, probed):
        to = asked.join(limits, "question_id", "left") if limits is not None else asked.withColumns(
            {f"least_{i}": F.lit(None).cast("double") for i in range(len(sizes))})
        inside = lambda c: (F.col(c) % PROBE == 0) == probed
        return best_in_groups(to.withColumn("in_group", groups).filter(inside("in_group")), scored.filter(inside("group")))

    def ranked(rows):
        first = newest(rows, ["question_id", "list_no"], max(sizes), F.col("score").desc(), *[F.col(k) for k in KEY], rank="list_rank")
        return first.filter(F.col("list_rank") <= F.element_at(F.array(*[F.lit(x) for x in sizes]), F.col("list_no") + 1))

    found = materialise(best(None, True), "probed")
    if number > 1:
        last = [F.min(F.when((F.col("list_no") == i) & (F.col("list_rank") == x), F.col("score"))).alias(f"least_{i}") for i, x in enumerate(sizes)]
        limits = ranked(found).groupBy("question_id").agg(*last)
        found = found.unionByName(best(limits, False))
    return ranked(found).select("question_id", "list_no", "list_rank", *KEY, "score")


def candidate_union(lists: DataFrame) -> DataFrame:
    """Each block once per question; the first list that holds it gives its score."""
    first = lists.groupBy("question_id", *KEY).agg(F.min(F.struct("list_no", "list_rank", "score")).alias("f"))
    return first.select("question_id", *KEY, "f.list_no", "f.list_rank", F.col("f.score").alias("bm25"))


WORD_START = "\u0002"


def word_starts(low: Column) -> Column:
    """The text with a mark wherever a word may begin: at its start and after everything that is no letter."""
    return F.regexp_replace(low, r"(?<!\p{L})", WORD_START)


def readable(text: Column) -> Column:
    """struct(text, low, marked): what ``match_quality`` looks at, made once per text."""
    low = F.lower(text)
    return F.struct(text.alias("text"), low.alias("low"), word_starts(low).alias("marked"))


def match_quality(text: Column, variants: Column, prepared: bool = False) -> Column:
    """1.0 when a variant begins a word (text start, after a non-letter, or at a capital), 0.4 inside a word, else 0.

    ``text`` is a text, or with ``prepared`` the struct of ``readable``. Variants are taken literally. Most word starts
    are found by looking for the marked variant in the marked text; only what is left is searched for a capital.
    """
    def at_capital(v, t):
        head, rest = F.left(v, F.lit(1)), F.substring(v, F.lit(2), F.length(v))
        quoted = F.when(rest != "", F.concat(F.lit(r"(?iu:\Q"), F.replace(rest, F.lit(r"\E"), F.lit("")), F.lit(r"\E)"))).otherwise("")
        return (F.upper(head) != head) & F.rlike(t, F.concat(F.upper(head), quoted))

    def quality(r):
        found = F.filter(variants, lambda v: F.contains(r["low"], v))
        begins = lambda v: F.contains(r["marked"], word_starts(v))
        return bind(found, lambda vs: F.when(F.size(vs) == 0, 0.0).when(F.exists(vs, begins), 1.0)
                    .when(F.exists(vs, lambda v: at_capital(v, r["text"])), 1.0).otherwise(0.4))

    return quality(text) if prepared else bind(readable(text), quality)


def variant_quality(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(variant, file_id, line_start, name, doc, path, body): match quality per column of the wanted variants (variant and a
    block's key) that the block holds.

    Each wanted block's text is read once, with the list of the variants asked of it.
    """
    asked = wanted.groupBy(*KEY).agg(F.collect_set("variant").alias("vs"))
    fields = F.struct(*[readable(fold(F.col(c))).alias(c) for c in COLUMNS])
    each = bind(fields, lambda r: F.transform("vs", lambda v: F.struct(
        v.alias("variant"), *[match_quality(r[c], F.array(v), prepared=True).alias(c) for c in COLUMNS])))
    found = blocks.select(*KEY, *COLUMNS).join(asked, KEY).select(*KEY, F.explode(each).alias("q")).select(*KEY, "q.*")
    return found.filter(F.greatest(*COLUMNS) > 0)


def rerank(found: DataFrame, blocks: DataFrame, questions: DataFrame, terms: DataFrame, depth: int,
           structure: list[str] = X.STRUCTURE_STEMS) -> DataFrame:
    """Order candidates by BM25, terms covered, where they were found and whether they begin a word.

    Texts are looked at for the candidates only, at most 850 per question, and only for the variants of the questions that a
    block is a candidate of.
    """
    asked = found.select("question_id", *KEY).join(terms.select("question_id", "term_no", F.explode("variants").alias("variant")), "question_id")
    per_term = (asked.join(variant_quality(blocks, asked), ["variant", *KEY])
                .groupBy("question_id", *KEY, "term_no").agg(
                    F.max(F.greatest(*[F.col(c) * w for c, w in FIELD_WEIGHTS.items()])).alias("best"), F.max("name").alias("in_name")))
    sums = per_term.groupBy("question_id", *KEY).agg(
        F.sum("best").alias("coverage"), F.count_if(F.col("best") > 0).alias("matched"), F.count_if(F.col("in_name") == 1.0).alias("named"))
    whole = terms.groupBy("question_id").agg(
        F.count("*").alias("n"), F.collect_list(F.when(F.col("exact"), F.col("base"))).alias("idents"),
        F.bool_or(F.col("base").isin(structure)).alias("wants"))
    said = questions.select("question_id", words(F.lower(fold(F.col("text"))), X.CODE_WORD).alias("said"))
    rows = (found.join(sums, ["question_id", *KEY]).join(whole.join(said, "question_id"), "question_id")
            .join(blocks.select(*KEY, "kind", "proc_name", "object_name", "is_export"), KEY))
    n = F.col("n")
    score = (F.col("bm25") * F.pow(0.25 + F.col("coverage") / n, F.lit(2)) * (0.5 + F.col("matched") / n)
             * F.pow(1 + F.col("named") / n, F.lit(2)))
    proc, obj = F.lower("proc_name"), F.lower("object_name")
    score = score * F.when((proc != "") & F.array_contains("idents", proc), 4.0).otherwise(1.0)
    score = score * F.when((obj != "") & F.array_contains("said", obj), 2.5).otherwise(1.0)
    score = score * F.when(F.col("kind") == "object", F.when(F.col("wants"), 2.5).otherwise(0.6)).when(F.col("is_export"), 1.3).otherwise(1.0)
    scored = rows.select("question_id", *KEY, "list_no", "list_rank", "matched", F.round(score, 5).alias("score"))
    return newest(scored, ["question_id"], depth, F.col("score").desc(), *[F.col(k) for k in KEY], rank="place")


def lexical_search(index: GramIndex, questions: DataFrame, depth: int = 50, synonyms: dict | None = None,
                   structure: list[str] = X.STRUCTURE_STEMS) -> DataFrame:
    """The best ``depth`` blocks per question; ``structure`` are the stems that ask what an object consists of."""
    terms = materialise(parse_query(questions, synonyms=synonyms), "terms")
    variants = terms.select(F.explode("variants").alias("variant")).distinct()
    hits = materialise(variant_hits(index, variants), "hits")
    found = materialise(candidate_union(candidate_lists(terms, hits, index.stats)), "candidates")
    return rerank(found, index.blocks, questions, terms, depth, structure)


def snippet_lines(hits: DataFrame, terms: DataFrame, max_lines: int = SNIPPET_LINES, width: int = SNIPPET_WIDTH) -> DataFrame:
    """Header line and lines with matches under their real numbers; with fewer than two, the first three lines too.

    An object's description is shown by its first lines, without numbers, as it is no text of a file.
    """
    per = terms.groupBy("question_id").agg(F.flatten(F.collect_list("variants")).alias("_vs"))
    rows = hits.join(per, "question_id")

    def shown(lines):
        indexes = F.sequence(F.lit(0), F.size(lines) - 1)
        header = F.slice(F.filter(indexes, lambda i: F.get(lines, i).rlike(START)), 1, 1)
        matching = F.filter(indexes, lambda i: bind(F.lower(F.get(lines, i)), lambda low: F.exists("_vs", lambda v: F.contains(low, v))))
        picked = bind(header, lambda h: F.slice(F.concat(h, F.array_except(matching, h)), 1, max_lines))
        chosen = bind(picked, lambda p: F.array_sort(F.when(F.size(p) < 2, F.array_union(p, F.slice(indexes, 1, 3))).otherwise(p)))
        return F.transform(chosen, lambda i: F.concat((F.col("line_start") + i).cast("string"), F.lit(": "), F.substring(strip(F.get(lines, i)), 1, width)))

    first = F.transform(F.slice(F.split("body", "\n"), 1, max_lines), lambda line: F.substring(line, 1, 3 * width))
    return rows.withColumn("lines", F.when(F.col("kind") == "object", first).otherwise(bind(F.split("body", "\n"), shown))).drop("_vs")


def char_budget(blocks_of_text: DataFrame, group: str, order: str, text: str, budget: int = OUTPUT_CHARS, used: int = 0) -> DataFrame:
    """Blocks that fit when put out in order, each with a line end; ``shown`` of how many were put out."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.coalesce(F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = blocks_of_text.withColumn("_over", F.lit(used) + before + F.length(text) > budget)
    cut = F.max(F.col("_over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fitting = marked.withColumn("_cut", cut)
    return (fitting.withColumn("found", F.count("*").over(Window.partitionBy(group))).filter("_cut = 0")
            .withColumn("shown", F.count("*").over(Window.partitionBy(group))).drop("_over", "_cut"))


def _tail_keys(parent: Column, rest: Column) -> Column:
    """Join keys of a path end that may begin inside a path part: the rest, and up to three last letters before it."""
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(parent))), lambda k: F.concat_ws("|", F.right(parent, k), rest))


def object_request(request: Column, kinds=None) -> Column:
    """struct(type, name) of ``Type.Name`` in any spelling of the type, with or without quotes; type is null where none is named."""
    kinds = X.OBJECT_KINDS if kinds is None else kinds
    spelt = {**X.PLURAL_TYPES, **{w.lower(): shown for *others, shown in kinds for w in (*others, shown)}}
    types = F.create_map(*[F.lit(x) for pair in spelt.items() for x in pair])
    bare = F.regexp_replace(strip(request), "^[«»\"'`]+|[«»\"'`]+$", "")
    found = F.when(F.contains(bare, F.lit(".")), F.try_element_at(types, F.lower(fold(F.substring_index(bare, ".", 1)))))
    return F.struct(found.alias("type"), F.when(found.isNotNull(), F.split_part(bare, F.lit("."), F.lit(2))).otherwise(bare).alias("name"))


def resolve_module(files: DataFrame, requests: DataFrame, tail_limit: int = 20, name_limit: int = 40) -> DataFrame:
    """(request, level, repo, path, line_from, line_to): exact repo and path, else exact path, else path end, else object name.

    Lines are those of a link's tail, null without one. Path ends and names are compared without case. All levels are equality joins. Object names are cut to the first modules of each name before
    the join, so a name that very many modules share does not multiply with its requests.
    """
    tail = r":(\d+)(?:-(\d+))?[`'\"\s]*$"
    asked = requests.select("request").distinct().withColumn("wanted", F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.translate("request", "\\", "/"), r"^[`'\"\s]+|[`'\"\s]+$", ""), r":(\d+)(-\d+)?$", ""), r"^/+|/+$", ""))
    place = files.select("repo", "path")
    by_repo = asked.join(place.withColumn("wanted", F.concat_ws("/", "repo", "path")), "wanted").select("request", F.lit(1).alias("level"), "repo", "path")
    exact = asked.join(place.withColumn("wanted", F.col("path")), "wanted").select("request", F.lit(2).alias("level"), "repo", "path")
    ends = asked.filter(F.contains("wanted", F.lit("/"))).withColumn("wanted", F.lower("wanted")).withColumn("_head", F.substring_index("wanted", "/", 1))
    ends = ends.withColumn("_key", F.element_at(_tail_keys(F.col("_head"), F.expr("substring(wanted, length(_head) + 1)")), -1))
    parts = F.split(F.lower("path"), "/")
    tails = place.select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(
        F.get(parts, i - 1).alias("parent"), F.concat(F.lit("/"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/")).alias("rest")))).alias("t"))
    tails = tails.select("repo", "path", F.explode(_tail_keys(F.col("t.parent"), F.col("t.rest"))).alias("_key"))
    by_tail = tails.join(ends, "_key").filter(F.endswith(F.lower("path"), F.col("wanted"))).select("request", "repo", "path").distinct()
    by_tail = newest(by_tail, ["request"], tail_limit, F.col("path"), F.col("repo")).select("request", F.lit(3).alias("level"), "repo", "path")
    named = asked.withColumn("_o", object_request(F.col("wanted"))).select(
        "request", F.lower("_o.name").alias("_name"), F.coalesce("_o.type", F.lit("")).alias("_type"))
    known = files.withColumn("_name", F.lower("object_name")).withColumn("_type", F.explode(F.array(F.col("object_type"), F.lit(""))))
    first = newest(known.select("_name", "_type", "repo", "path").distinct(), ["_name", "_type"], name_limit, F.col("path"), F.col("repo"))
    by_name = named.join(first, ["_name", "_type"]).select("request", F.lit(4).alias("level"), "repo", "path")
    found = by_repo.unionByName(exact).unionByName(by_tail).unionByName(by_name)
    best = found.groupBy("request").agg(F.min("level").alias("level"))
    line = lambda i: F.regexp_extract("request", tail, i).try_cast("int")
    return found.join(best, ["request", "level"]).withColumns({"line_from": line(1), "line_to": F.coalesce(line(2), line(1))})


def find_object(objects: DataFrame, requests: DataFrame, limit: int = 5) -> DataFrame:
    """(request, level, object_id, object_name, rank): exact name, else objects whose name and synonym hold the stems of all
    words, shortest name first. A type in the request has to be the object's; ``objects`` has object_id, object_type,
    object_name and synonym.

    Objects are cut to ``limit`` per name and type before anything is joined.
    """
    asked = requests.select("request").distinct().withColumn("_o", object_request(F.col("request"))).select(
        "request", F.lower(fold(F.col("_o.name"))).alias("_low"), F.coalesce("_o.type", F.lit("")).alias("_type"))
    texts = objects.select("object_id", "object_name", F.lower(fold(F.col("object_name"))).alias("_low"),
                           F.lower(fold(F.concat_ws(" ", "object_name", "synonym"))).alias("_text"),
                           F.explode(F.array("object_type", F.lit(""))).alias("_type"))
    known = newest(texts, ["_low", "_type"], limit, F.col("object_id"))
    exact = known.join(asked, ["_low", "_type"]).select("request", F.lit(1).alias("level"), "object_id", "object_name")
    wanted = F.transform(F.filter(words(F.col("_low"), X.CODE_WORD), lambda w: F.length(w) >= 3), lambda w: stem(w))
    parts = asked.select("request", "_type", wanted.alias("_words")).filter(F.size("_words") > 0)
    # the rarest gram of the words proposes texts, all words decide; a request with an unknown gram has no hit
    asked_for = parts.select("request", "_type", "_words", F.explode(F.array_distinct(F.flatten(F.transform("_words", grams)))).alias("gram"))
    known_grams = materialise(texts.select("_text", "_type").distinct().filter(F.length("_text") >= 3)
                              .select("_text", "_type", F.explode(grams(F.col("_text"))).alias("gram"))
                              .join(asked_for.select("_type", "gram").distinct(), ["_type", "gram"], "left_semi"), "name-grams")
    counts = known_grams.groupBy("_type", "gram").agg(F.count("*").alias("df"))
    rarest = (asked_for.join(counts, ["_type", "gram"], "left").groupBy("request", "_type", "_words")
              .agg(F.min(F.struct("df", "gram")).alias("a"), F.bool_or(F.col("df").isNull()).alias("lost"))
              .filter(~F.col("lost")).select("request", "_type", "_words", F.col("a.gram").alias("gram")))
    held = (known_grams.join(rarest, ["gram", "_type"])
            .filter(F.forall("_words", lambda w: F.contains(F.col("_text"), w))).select("request", "_text", "_type"))
    per_text = newest(texts, ["_text", "_type"], limit, F.col("object_id"))
    partial = held.join(per_text, ["_text", "_type"]).select("request", F.lit(2).alias("level"), "object_id", "object_name")
    found = exact.unionByName(partial)
    best = found.groupBy("request").agg(F.min("level").alias("level"))
    return newest(found.join(best, ["request", "level"]), ["request"], limit, F.length("object_name"), F.col("object_id"))


def object_modules(owners: DataFrame, blocks: DataFrame) -> DataFrame:
    """Modules of each asked object with their number of procedures; an object without type or repo fits any."""
    mods = blocks.groupBy(F.lower("object_name").alias("_name"), F.col("object_type").alias("_type"), F.col("repo").alias("_repo"), "path").agg(
        F.count_if(F.col("kind").isin("proc", "func")).alias("procedures"))
    # a module is met under its type and repo, and under either left open, so that owners meet those that fit them only
    open_ = {"_any_type": F.explode(F.array(F.lit(True), F.lit(False))), "_any_repo": F.explode(F.array(F.lit(True), F.lit(False)))}
    for name, each in open_.items():
        mods = mods.withColumn(name, each)
    known = mods.withColumn("_of_type", F.when(F.col("_any_type"), "").otherwise(F.col("_type"))).withColumn(
        "_of_repo", F.when(F.col("_any_repo"), "").otherwise(F.col("_repo")))
    asked = owners.select("owner_id", F.lower("object_name").alias("_name"), F.col("object_type").isNull().alias("_any_type"), F.col("repo").isNull().alias("_any_repo"),
                          F.coalesce("object_type", F.lit("")).alias("_of_type"), F.coalesce("repo", F.lit("")).alias("_of_repo"))
    return asked.join(known, ["_name", "_any_type", "_any_repo", "_of_type", "_of_repo"]).select("owner_id", F.col("_repo").alias("repo"), "path", "procedures")


def _short_grams(text: Column) -> Column:
    """Every one, two and three letters of a lower-case text."""
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(3), F.length(text) - i + 1)), lambda n: F.substring(text, i, n)))
    return F.when(F.length(text) > 0, F.array_distinct(F.flatten(each)))


def near_names(names: DataFrame, requests: DataFrame, group: str, limit: int = 200) -> DataFrame:
    """Contents lines (``name``) of the asked group that hold the request in any case, else the first lines of the group.

    The rarest gram of a request within its group proposes lines, so a request meets only lines that share this gram with it.
    What a request without any gets is cut per group before it is joined. An empty request gets the first lines.
    """
    order, shown = F.col("name_order"), ["request_id", "rank", "name"]
    low = F.lower("request")
    wanted = requests.select("request_id", group, low.alias("_low")).filter(F.length("_low") > 0)
    size = F.least(F.lit(3), F.length("_low"))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_low") - size + 1), lambda i: F.substring(F.col("_low"), i, size)))
    asked = wanted.select("request_id", group, "_low", F.explode(own).alias("gram"))
    held = materialise(names.select(group, "name", "name_order", F.explode(_short_grams(F.lower("name"))).alias("gram"))
                       .join(asked.select(group, "gram").distinct(), [group, "gram"], "left_semi"), "line-grams")
    counts = held.groupBy(group, "gram").agg(F.count("*").alias("df"))
    rarest = (asked.join(counts, [group, "gram"], "left").groupBy("request_id", group, "_low")
              .agg(F.min(F.struct("df", "gram")).alias("a"), F.bool_or(F.col("df").isNull()).alias("lost"))
              .filter(~F.col("lost")).select("request_id", group, "_low", F.col("a.gram").alias("gram")))
    near = held.join(rarest, [group, "gram"]).filter(F.contains(F.lower("name"), F.col("_low")))
    found = materialise(newest(near, ["request_id"], limit, order).select(*shown), "near")
    others = requests.join(found.select("request_id").distinct(), "request_id", "left_anti")
    return found.unionByName(others.join(newest(names, [group], limit, order), group).select(*shown))
