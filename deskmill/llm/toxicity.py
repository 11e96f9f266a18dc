"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Terms are words and word beginnings that labelled texts show to go with a label; with all terms the results were worse and the
index too large for a task (figures in README). Document frequencies cover the whole corpus. The examples are a bounded sample
of the labelled rows (``toxic_examples``, ``clean_examples``), so the index is bounded and goes to every task; examples with
equal vectors are one entry with their votes summed. For a text, the blocks of entries are visited by falling upper bound, and
their postings read only then, until no block can hold a nearer one, which is exact. Votes are weighted by distance and turned
into probabilities by a monotone curve fitted on the examples, each left out of its own vote. Texts are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.names import free_name
from deskmill.llm.sampling import bounded_sample
from deskmill.session import materialise

WORDS = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)
TOXIC_EXAMPLES, CLEAN_EXAMPLES = 4000, 8000
RAREST = 4  # examples a term has to occur in
LIFT = 3.0  # least ratio of a term's shares among toxic and clean examples; weak signs are many and common
SIGNIFICANT = 6.0  # least chi-square of a term
NEIGHBOURS = 15
PRIOR_WEIGHT = 0.2
BLOCK = 8
THRESHOLD = 0.3
REMEMBERED = 50_000


def word_terms(word: str) -> list[str]:
    """A word and its beginnings; beginnings carry a sign, as they are other terms than words."""
    return [word, *[word[:n] + "*" for n in STARTS if len(word) > n]]


def held_out(id_col):
    """Whether a row is kept from learning: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# --- the index

class BlockMaxIndex:
    """Postings by block of entries and term, with the largest weight of every term in every block."""

    def __init__(self, vectors: list[dict[int, float]], terms: int, block: int = BLOCK):
        # entries with the same heaviest terms lie together, which keeps the bounds of blocks tight
        order = sorted(range(len(vectors)), key=lambda i: (sorted(vectors[i], key=lambda t: (-vectors[i][t], t)), i))
        self.order, self.block, self.terms = np.array(order, np.int64), block, terms
        self.blocks = -(-len(order) // block)
        sizes = [len(vectors[i]) for i in order]
        place = np.repeat(np.arange(len(order)), sizes)
        term = np.array([t for i in order for t in vectors[i]], np.int64)
        weight = np.array([w for i in order for w in vectors[i].values()], np.float64)
        by = np.lexsort((place, term, place // block))
        self.place, self.weight = place[by], weight[by]
        # one list of postings per key: block and term
        self.keys, self.starts = np.unique(self.place // block * terms + term[by], return_index=True)
        self.ends = np.append(self.starts[1:], len(by))
        most = np.maximum.reduceat(self.weight, self.starts) if len(by) else self.weight
        # for each term the blocks it occurs in and its largest weight there
        by = np.argsort(self.keys % max(terms, 1), kind="stable")
        cuts = np.searchsorted(self.keys[by] % max(terms, 1), np.arange(terms + 1))
        blocks, most = self.keys[by] // max(terms, 1), most[by]
        self.most = [(blocks[i:j], most[i:j]) for i, j in zip(cuts, cuts[1:])]
        self.read = 0  # postings read by all queries so far

    def cosines(self, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Blocks x entries: cosines of the entries of some blocks, from the postings of the query's terms in these blocks."""
        wanted = (blocks[:, None] * self.terms + terms).ravel()
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == wanted)
        starts, lengths = self.starts[at[hit]], (self.ends - self.starts)[at[hit]]
        shift = np.cumsum(lengths) - lengths
        postings = np.arange(lengths.sum()) + np.repeat(starts - shift, lengths)
        self.read += len(postings)
        cell = np.repeat(hit // len(terms), lengths) * self.block + self.place[postings] % self.block
        gains = np.repeat(weights[hit % len(terms)], lengths) * self.weight[postings]
        return np.round(np.bincount(cell, gains, len(blocks) * self.block), 12).reshape(-1, self.block)

    def nearest(self, query: dict[int, float], count: int, votes: np.ndarray) -> list[tuple[float, int]]:
        """(cosine, entry) by falling cosine, ties by entry, until ``count`` votes are reached; whole entries.

        Blocks are visited by falling bound, a few at first and more each time, until no block left can hold an entry as near as
        the last one needed. The postings of a block are read when it is visited, so those of all other blocks are
        skipped. Only entries with a cosine above zero are in question; ``votes`` says how many examples an entry stands for.
        """
        terms = np.array(sorted(query), np.int64)
        weights = np.array([query[t] for t in terms.tolist()])
        bound = np.zeros(self.blocks)
        for t, w in zip(terms.tolist(), weights.tolist()):
            blocks, most = self.most[t]
            bound[blocks] += w * most
        bound += 1e-11
        order = np.argsort(-bound, kind="stable")
        scores, entries = np.zeros(0), np.zeros(0, np.int64)
        least, at, step = 2e-11, 0, 1
        while at < len(order) and bound[order[at]] > least:
            chosen = order[at:at + step]
            chosen = chosen[bound[chosen] > least]
            score = self.cosines(chosen, terms, weights)
            row, col = np.nonzero(score >= max(least - 1e-11, 1e-12))
            scores = np.concatenate([scores, score[row, col]])
            entries = np.concatenate([entries, self.order[chosen[row] * self.block + col]])
            ranking = np.lexsort((entries, -scores))
            scores, entries = scores[ranking], entries[ranking]
            enough = np.flatnonzero(np.cumsum(votes[entries]) >= count)
            if len(enough):
                scores, entries = scores[:enough[0] + 1], entries[:enough[0] + 1]
                least = max(least, scores[-1])
            at, step = at + step, step * 2
        return list(zip(scores.tolist(), entries.tolist()))


def monotone_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: (x, mean) of every pool's ends, to be interpolated."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order.tolist():
        pools.append([w[i] * y[i], w[i], x[i], x[i]])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or
                                  pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    ends = [(e, (p[0] + 0.5 * y.mean()) / (p[1] + 0.5)) for p in pools for e in sorted({p[2], p[3]})]
    xs, ys = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])
    return xs, np.maximum.accumulate(ys) if len(ys) else ys


class Model:
    """Terms, document frequencies, examples and the curve; small and of bounded size."""

    def __init__(self, terms: list[str], frequency: dict[int, int], documents: int,
                 examples: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], rate: float):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.names = terms
        self.idf = np.array([math.log((1 + documents) / (1 + frequency.get(i, 0))) + 1 for i in range(len(terms))])
        self.rate = rate
        toxic = sum(y for *_, y in examples)
        weights = (((1 - rate) * len(examples) / max(1, len(examples) - toxic)), rate * len(examples) / max(1, toxic))
        groups: dict[tuple, list] = {}
        for example, ids, counts, y in examples:
            row = groups.setdefault((ids, counts), [example, 0, [0.0, 0.0]])
            row[0], row[1] = min(row[0], example), row[1] + 1
            row[2][y] += weights[y]
        self.none = groups.pop(((), ()), [None, 0, [0.0, 0.0]])
        keys = sorted(groups)
        self.place = {k: i for i, k in enumerate(keys)}
        self.example = [groups[k][0] for k in keys]
        self.votes = np.array([groups[k][1] for k in keys], np.int64)
        self.sums = np.array([groups[k][2] for k in keys]).reshape(-1, 2)
        self.index = BlockMaxIndex([self.vector(*k) for k in keys], len(terms))
        self.curve = None
        if examples:
            known: dict[tuple, float] = {}
            for _, ids, counts, y in examples:
                if (ids, counts, y) not in known:
                    known[ids, counts, y] = self.raw(ids, counts, weights[y] * np.eye(2)[y])[0]
            x = np.array([known[i, c, y] for _, i, c, y in examples])
            y = np.array([e[3] for e in examples], np.float64)
            self.curve = monotone_curve(x, y, np.where(y > 0, weights[1], weights[0]))

    def vector(self, ids, counts) -> dict[int, float]:
        raw = {i: (1 + math.log(n)) * self.idf[i] for i, n in zip(ids, counts)}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {i: x / norm for i, x in raw.items()}

    def raw(self, ids, counts, without=None) -> tuple[float, list[tuple[float, int]]]:
        """Share of toxic votes, and the entries that voted; ``without`` takes one example's vote out."""
        away = np.zeros(2) if without is None else without
        if not ids:
            total = np.maximum(np.array(self.none[2]) - away, 0)
            near = []
        else:
            near = self.index.nearest(self.vector(ids, counts), NEIGHBOURS + (without is not None), self.votes)
            own = self.place.get((ids, counts), -1) if without is not None else -1
            total = sum((s ** 4 * np.maximum(self.sums[e] - (away if e == own else 0), 0) for s, e in near), np.zeros(2))
        part = total.sum()
        return float((total[1] + PRIOR_WEIGHT * self.rate) / (part + PRIOR_WEIGHT)), near

    def score(self, ids, counts) -> tuple[float, list[dict]]:
        raw, near = self.raw(ids, counts)
        value = float(np.interp(raw, *self.curve)) if self.curve is not None and len(self.curve[0]) else raw
        value = min(1.0, max(0.0, value + 1e-6 * (raw - 0.5)))  # the curve has level parts: keep the order inside them
        return value, [{"example": self.example[e], "cosine": s,
                        "toxic": float(self.sums[e][1] / self.sums[e].sum())} for s, e in near[:5]]


# --- Spark jobs

def choose_examples(labels: DataFrame, id_col: str, label_col: str, toxic: int, clean: int) -> DataFrame:
    """(id, y) of at most ``toxic`` + ``clean`` labelled rows that may be learned from, picked by hash."""
    usable = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    usable = materialise(usable, "usable-labels")
    parts = [bounded_sample(usable.where(F.col("y") == y), "id", n) for y, n in ((1, toxic), (0, clean))]
    return parts[0].unionAll(parts[1])


def _term_counts(batches):
    """(term, toxic, clean): in how many texts of each label a term occurs, summed in the task."""
    found: dict[str, list[int]] = {}

    def flush():
        rows = list(found.items())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                           pa.array([r[1][1] for r in rows], pa.int64()),
                                           pa.array([r[1][0] for r in rows], pa.int64())], ["term", "toxic", "clean"])

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for term in {t for w in set(WORDS.findall((text or "").lower())) for t in word_terms(w)}:
                found.setdefault(term, [0, 0])[y] += 1
            if len(found) > 200_000:
                yield flush()
    yield flush()


def _counted(texts: list[str | None], terms: dict[str, int]) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of the known terms in every text, rising, and how often each occurs."""
    known: dict[str, list[int]] = {}
    ids, counts = [], []
    for text in texts:
        total: dict[int, int] = {}
        for word, n in Counter(WORDS.findall((text or "").lower())).items():
            own = known.get(word)
            if own is None:
                if len(known) > 4 * REMEMBERED:
                    known.clear()
                own = known[word] = [terms[t] for t in word_terms(word) if t in terms]
            for term in own:
                total[term] = total.get(term, 0) + n
        ids.append(sorted(total))
        counts.append([total[t] for t in ids[-1]])
    return ids, counts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        toxic_examples: int = TOXIC_EXAMPLES, clean_examples: int = CLEAN_EXAMPLES,
        telling: bool = True) -> tuple[Model, DataFrame]:
    """The model, and (id, terms, counts) of every row of ``docs``, which gives the document frequencies.

    With ``telling`` the cosine is over the terms that lean towards toxic, otherwise over all that ``RAREST`` examples hold.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = materialise(choose_examples(labels, id_col, label_col, toxic_examples, clean_examples), "examples")
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    rate = usable.agg(F.avg(F.col(label_col).cast("double"))).first()[0] or 0.0
    # the sample is bounded by its two parameters, so it may go to every task; of rows that repeat an id one teaches
    taught = materialise(texts.join(F.broadcast(sample), "id").groupBy("id").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("one")).select("id", "one.text", "one.y"), "taught")
    both = taught.select("text", "y").mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") + F.col("b") >= RAREST)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    c, d = pos - F.col("a"), neg - F.col("b")
    lean = F.col("a") * d - F.col("b") * c
    chi = F.lit(float(pos + neg)) * lean * lean / ((F.col("a") + F.col("b")) * (c + d + 0.5) * F.lit(max(pos, 1)) * F.lit(max(neg, 1)))
    strong = F.col("a") * F.lit(max(neg, 1)) >= LIFT * F.col("b") * F.lit(max(pos, 1))
    # every term that passes, as many as the bounded sample's words give
    known = both.where((lean > 0) & strong & (chi >= SIGNIFICANT)) if telling else both
    terms = sorted(r["term"] for r in known.select("term").collect()) if pos and neg else []
    lookup = {t: i for i, t in enumerate(terms)}

    def extract(batches):
        for batch in batches:
            ids, counts = _counted(batch.column(1).to_pylist(), lookup)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array(counts, pa.list_(pa.int32()))], ["id", "terms", "counts"])

    kind = docs.schema[id_col].dataType
    lists = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("terms", "counts")]
    shape = T.StructType([T.StructField("id", kind), *lists])
    found = materialise(texts.mapInArrow(extract, shape), "terms")
    frequency = {r[0]: r[1] for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    rows = taught.select("id", "text").mapInArrow(extract, shape).join(F.broadcast(sample), "id").select("id", "terms", "counts", "y").collect()
    examples = sorted((r["id"], tuple(r["terms"]), tuple(r["counts"]), r["y"]) for r in rows)
    return Model(terms, frequency, found.count(), examples, rate), found


class _Scores:
    """Scores of one task; texts with equal terms are scored once."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, ids, counts) -> tuple[float, list[dict]]:
        key = (tuple(ids), tuple(counts))
        if key not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[key] = self.model.score(*key)
        return self.known[key]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", toxic_examples: int = TOXIC_EXAMPLES,
                   clean_examples: int = CLEAN_EXAMPLES, threshold: float = THRESHOLD, telling: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, evidence (nearest examples with cosine and label).

    Learns only from labelled rows that are not held out, from at most the given numbers of them; rows with a null id
    or label teach nothing, of several labels of an id the highest counts. Null and empty texts get a score like
    any other text without known terms. Without labels the score is one constant. Repeated rows are scored each; an empty
    table gives an empty result; columns other than id and text are never looked at.
    """
    model, found = fit(docs, labels, id_col, text_col, label_col, toxic_examples, clean_examples, telling)
    kind = docs.schema[id_col].dataType
    evidence = T.ArrayType(T.StructType([T.StructField("example", kind), T.StructField("cosine", T.DoubleType()),
                                         T.StructField("toxic", T.DoubleType())]))

    def score(batches):
        scores = _Scores(model)
        for batch in batches:
            shape = pa.list_(pa.struct([("example", batch.column(0).type), ("cosine", pa.float64()), ("toxic", pa.float64())]))
            made = [scores(i, c) for i, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.float64()),
                                              pa.array([m[1] for m in made], shape)], ["id", "score", "evidence"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)])
    return found.mapInArrow(score, schema).select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay, and rows stay where they lie.

    Scores are those of ``score_toxicity``, with the same rules for nulls, repeats and empty tables.
    """
    model, _ = fit(docs, labels, id_col, text_col, **fitting)
    terms, names = model.terms, docs.columns
    work_col = free_name("_text", names)
    frame = docs.withColumn(work_col, F.col(text_col).cast("string"))

    def keep(batches):
        scores = _Scores(model)
        for batch in batches:
            ids, counts = _counted(batch.column(work_col).to_pylist(), terms)
            good = pa.array([scores(i, c)[0] < threshold for i, c in zip(ids, counts)], pa.bool_())
            yield batch.select(names).filter(good)

    return frame.mapInArrow(keep, docs.schema)
