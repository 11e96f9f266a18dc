"""Search by score blocks and sorted pages next to plain versions, and what they read."""

import collections
import math
import random

from pyspark.sql import functions as F

from deskmill.operators import code_search as C
from deskmill.operators import search as S
from deskmill.session import materialise


def scored(spark, chunks=6000, questions=12, seed=1):
    """A stem that all chunks hold and all questions ask for, and rare stems of much higher scores."""
    rnd = random.Random(seed)
    rows = [("hot", d, 0, 0.05 + 0.2 * rnd.random()) for d in range(chunks)]
    terms = []
    for q in range(questions):
        terms.append((q, 0, "hot"))
        for i in range(1, 4):
            stem = f"r{rnd.randrange(20)}"
            if (q, stem) not in {(t[0], t[2]) for t in terms}:
                terms.append((q, i, stem))
    for r in range(20):
        rows += [(f"r{r}", d, 0, 2.0 + 4 * rnd.random()) for d in rnd.sample(range(chunks), 120)]
    return (spark.createDataFrame(terms, "question_id int, term_no int, stem string"),
            spark.createDataFrame(rows, "stem string, doc_id long, chunk_no int, score double"))


def plain_best(terms, scores, depth):
    by_stem = {}
    for s in scores.collect():
        by_stem.setdefault(s.stem, []).append(s)
    out = set()
    for q in {t.question_id for t in terms.collect()}:
        sums = {}
        for t in terms.filter(F.col("question_id") == q).collect():
            for s in by_stem.get(t.stem, []):
                a, n = sums.get((s.doc_id, s.chunk_no), (0.0, 0))
                sums[s.doc_id, s.chunk_no] = a + s.score, n + 1
        best = sorted(((-round(a, 6), *k, n) for k, (a, n) in sums.items()))[:depth]
        out |= {(q, d, c, -a, n, i + 1) for i, (a, d, c, n) in enumerate(best)}
    return out


def test_score_blocks_give_the_plain_best(spark, monkeypatch):
    for seed, size in ((1, 500), (2, 10 ** 6)):
        monkeypatch.setattr(S.score_blocks, "__defaults__", (size,))
        terms, scores = scored(spark, seed=seed)
        found = S.candidates(terms, scores, 8).select("question_id", "doc_id", "chunk_no", "score", "matched", "bm25_rank")
        assert {tuple(r) for r in found.collect()} == plain_best(terms, scores, 80)


def test_few_chunks_and_one_stem(spark):
    terms = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (3, 0, "none")], "question_id int, term_no int, stem string")
    scores = spark.createDataFrame([("a", 1, 0, 1e-6), ("b", 1, 0, 1e-6), ("b", 2, 0, 7.5), ("b", 2, 1, 7.5)],
                                   "stem string, doc_id long, chunk_no int, score double")
    found = S.candidates(terms, scores, 8).select("question_id", "doc_id", "chunk_no", "score", "matched", "bm25_rank")
    assert {tuple(r) for r in found.collect()} == plain_best(terms, scores, 80)


def test_closed_blocks_are_not_read(spark):
    """Blocks with the frequent stem alone stay below the threshold that the rare stems' chunks give."""
    terms, scores = scored(spark, chunks=4000, questions=6)
    blocks = S.score_blocks(scores.filter("stem = 'hot' or doc_id < 400"), 200)
    least = terms.select("question_id").distinct().withColumn("least", F.lit(2.0))
    asked, every = S.open_blocks(terms, blocks, least), S.open_blocks(terms, blocks, None)
    rare = scores.filter("stem <> 'hot' and doc_id < 400").count()
    pairs = asked.select("question_id", "block").distinct().count()
    assert pairs <= rare * 6 and asked.join(blocks, ["stem", "block"]).count() < every.join(blocks, ["stem", "block"]).count()
    only_hot = blocks.groupBy("block").agg(F.count_if(F.col("stem") != "hot").alias("n")).filter("n = 0").select("block")
    assert only_hot.count() == 0 or asked.join(only_hot, "block", "left_semi").count() == 0


def test_every_posting_goes_to_one_block(spark):
    _, scores = scored(spark, chunks=300)
    blocks = S.score_blocks(scores, 50)
    assert blocks.count() == scores.count()
    assert blocks.groupBy("doc_id", "chunk_no").agg(F.countDistinct("block").alias("n")).filter("n > 1").count() == 0


def test_prefixes_are_looked_up_in_their_pages(spark):
    rnd = random.Random(4)
    known = sorted({"".join(rnd.choice("abcж") for _ in range(rnd.randrange(1, 9))) for _ in range(9000)} | {"th" + str(i) for i in range(3000)})
    stems = ["ab", "abc", "жж", "th1", "th29", "zz", "abcabca", "th2999", "caж"]
    pages = S.vocabulary_pages(spark.createDataFrame([(t,) for t in known], "term string"))
    asked = spark.createDataFrame([(s,) for s in stems], "stem string")
    found = {tuple(r) for r in S.prefix_terms(asked, pages).collect()}
    assert found == {(s, t) for s in stems for t in known if t.startswith(s) and len(t) >= 2}
    touched = S.prefix_pages(asked, pages).join(pages, ["start", "page"]).count()
    assert touched <= len(found) + 2 * S.PAGE * len(stems)


def test_stems_of_words_and_in_the_row_agree(spark):
    texts = spark.createDataFrame([(1, "Счёта счетов running runs RUNNING 12 x"), (2, "")], "doc_id long, text string")
    chunks = texts.select("doc_id", F.lit(0).alias("chunk_no"), "text", F.size(S.words(F.col("text"))).alias("n_words"))
    titles = spark.createDataFrame([(1, "Счета")], "doc_id long, title string")
    postings, _, _ = S.build_postings(chunks, titles)
    plain = texts.select("doc_id", F.explode(S.stems(F.col("text"))).alias("term")).groupBy("doc_id", "term").count()
    assert sorted(map(tuple, postings.filter("tf_body > 0").select("doc_id", "term", "tf_body").collect())) == sorted(map(tuple, plain.collect()))
    assert postings.agg(F.sum("tf_title")).first()[0] == 1


def some_blocks(spark, n=300):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9))) for _ in range(200)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    return words, spark.createDataFrame([(i, 1, text(3), rnd.choice(words), text(5), text(40)) for i in range(n)],
                                        "file_id long, line_start int, path string, name string, doc string, body string")


def test_kept_grams_find_what_the_texts_hold(spark):
    words, blocks = some_blocks(spark)
    index = C.build_gram_index(blocks)
    rows = blocks.collect()
    for asked in (words[:10] + ["abc", "zzz"], words[50:53]):  # a second call reads the same tables
        variants = spark.createDataFrame([(w,) for w in asked], "variant string")
        found = {(r.variant, r.file_id) for r in C.variant_hits(index, variants).collect()}
        assert found == {(w, r.file_id) for w in asked for r in rows if any(w in r[c] for c in C.COLUMNS)}


def test_grams_propose_without_texts(spark):
    words, blocks = some_blocks(spark)
    index = C.build_gram_index(blocks)
    variants = spark.createDataFrame([(words[0],)], "variant string")
    plan = C.proposals(index, variants)._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "ReadSchema" in plan
    assert C.proposals(index, variants).count() <= index.counts.join(variants.select(F.explode(C.grams(F.col("variant"))).alias("gram")), "gram").agg(F.min("df")).first()[0]


def test_candidate_lists_next_to_all_rows(spark):
    """Lists put together from groups of blocks, with thresholds, are those of the plain sums; keys may repeat."""
    rnd = random.Random(4)
    vs = [f"v{i}" for i in range(12)]
    rows = [(v, f, 1, 40 + f % 7, *[rnd.randrange(0, 3) for _ in range(3)], 1) for f in range(900) for v in vs if rnd.random() < 0.5]
    rows += rows[:5]
    hits = materialise(spark.createDataFrame(rows, "variant string, file_id long, line_start int, len int, tf_path int, tf_name int, tf_doc int, tf_body int"), "h")
    terms = [(q, no, no_vs) for q in range(5) for no, no_vs in enumerate([[vs[q], vs[q + 5]], [vs[q + 1]], ["none"] if q == 3 else [vs[q + 2]]])] + [(9, 0, [vs[0]])]
    asked = spark.createDataFrame(terms, "question_id long, term_no int, variants array<string>")
    stats = spark.createDataFrame([(900, 43.0)], "n long, avg_len double")
    got = {}
    for r in C.candidate_lists(asked, hits, stats, size=60).collect():
        got.setdefault((r.question_id, r.list_no), []).append((r.list_rank, r.file_id, r.score))
    held, scores = {}, {}
    for head, weights in enumerate([(3, 10, 4, 1), (0, 10, 4, 0)]):
        freq = [(r, sum(w * x for w, x in zip(weights, r[4:]))) for r in rows]
        df = collections.Counter(r[0] for r, f in freq if f)
        for r, f in freq:
            for q, no, own in terms:
                if f and r[0] in own:
                    idf = math.log((900 - df[r[0]] + 0.5) / (df[r[0]] + 0.5))
                    score = (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * r[3] / 43))
                    scores[q, head, r[1]] = scores.get((q, head, r[1]), 0) + score
                    held.setdefault((q, head, r[1]), set()).add(no)
    for q in {x[0] for x in terms}:
        n = sum(x[0] == q for x in terms)
        for no, size in enumerate([400, 200, 100, 150]):
            want = sorted((-round(s, 6), f) for (a, head, f), s in scores.items() if a == q and head == no % 2 and (no < 2 or n > 1 and len(held[a, head, f]) == n))[:size]
            found = sorted(got.get((q, no), []))
            assert [f for _, f, _ in found] == [f for _, f in want] and [k for k, _, _ in found] == list(range(1, len(want) + 1)), (q, no)


def test_hits_and_lists_make_no_row_per_question(spark):
    """Neither counting nor summing goes through a row for each question, term and block."""
    words, blocks = some_blocks(spark)
    index = C.build_gram_index(blocks)
    variants = spark.createDataFrame([(w,) for w in words[:5]], "variant string")
    hits = materialise(C.variant_hits(index, variants), "hits")
    low = {(r.file_id, c): r[c] for r in blocks.collect() for c in C.COLUMNS}
    for r in hits.collect():
        assert [r[f"tf_{c}"] for c in C.COLUMNS] == [sum(low[r.file_id, c].startswith(r.variant, i) for i in range(len(low[r.file_id, c]))) for c in C.COLUMNS]
    terms = spark.createDataFrame([(q, 0, words[:5]) for q in range(3)], "question_id long, term_no int, variants array<string>")
    plan = C.candidate_lists(terms, hits, index.stats)._jdf.queryExecution().executedPlan().toString()
    assert "tf_body" not in plan
    odd = spark.createDataFrame([(1, 1, "p", "n", "", "aaa \U0001d400\U0001d401x"), (2, 1, "p", None, None, "ab"), (3, 1, None, None, None, "ab")], blocks.schema)
    got = {(r.file_id, r.gram) for r in C.trigram_index(odd).collect()}
    whole = {1: "p\1n\1\1aaa \U0001d400\U0001d401x", 2: "p\1ab"}
    assert got == {(k, t[i:i + 3]) for k, t in whole.items() for i in range(len(t) - 2)}


def test_variants_are_counted_at_every_place():
    rnd = random.Random(6)
    variants = ["aba", "abab", "aaa", "b_a", "a-b", "ы1a", "-ab", "abc"]
    counter = C.VariantCounter()
    for k in range(1, 200):
        text = "".join(rnd.choice("aab_-ы1 ") for _ in range(k))
        counter.add(variants[:1 + k % 8])
        got = counter.count(text)
        for v in variants[:1 + k % 8]:
            assert got[v] == sum(text.startswith(v, i) for i in range(len(text))), (v, text)


def test_terms_are_counted_in_the_row(spark):
    """Words are cut as the column function cuts them, without a shuffle; keys may repeat."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeингсяёЁS1") for _ in range(rnd.randrange(1, 12))) for _ in range(400)] + ["running", "книгами", "houses"]
    rows = [(d, c, 7, " ".join(rnd.choice(words) for _ in range(60))) for d in range(20) for c in range(2)]
    rows += rows[:2] + [(99, 0, 0, ""), (98, 0, 0, None)]
    sized = spark.createDataFrame(rows, "doc_id long, chunk_no int, len long, text string")
    got = S.body_terms(sized)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = sized.select("doc_id", "chunk_no", F.explode(S.stems(F.col("text"))).alias("term")).groupBy("doc_id", "chunk_no", "term").count()
    both = [collections.Counter({tuple(r)[:3]: r[3] for r in x.collect()}) for x in (got.groupBy("doc_id", "chunk_no", "term").agg(F.sum("tf_body")), want)]
    assert both[0] == both[1] and both[0]


def test_reranking_asks_a_block_only_for_its_questions(spark):
    """A variant is looked at in the blocks that are candidates of a question with it, and nowhere else."""
    words, blocks = some_blocks(spark, 40)
    terms = spark.createDataFrame([(q, no, [w]) for q in range(10) for no, w in enumerate(words[q:q + 3])], "question_id long, term_no int, variants array<string>")
    found = spark.createDataFrame([(q, f, 1) for q in range(10) for f in range(q, 40, 10)], "question_id long, file_id long, line_start int")
    asked = found.join(terms.select("question_id", F.explode("variants").alias("variant")), "question_id")
    got = C.variant_quality(blocks, asked).collect()
    texts = {r.file_id: [r[c] for c in C.COLUMNS] for r in blocks.collect()}
    assert {(r.variant, r.file_id) for r in got} == {(r.variant, r.file_id) for r in asked.collect() if any(r.variant in x for x in texts[r.file_id])}


def test_a_variant_counts_as_often_as_it_was_proposed(spark):
    words, blocks = some_blocks(spark, 30)
    index = C.build_gram_index(blocks.unionByName(blocks.filter("file_id < 3")))
    variants = spark.createDataFrame([(w,) for w in words[:60]], "variant string")
    once = {(r.variant, r.file_id): r.asDict() for r in C.variant_hits(C.build_gram_index(blocks), variants).collect()}
    again = C.variant_hits(index, variants).collect()
    assert all(r.asDict() == once[r.variant, r.file_id] for r in again)
    assert collections.Counter((r.variant, r.file_id) for r in again) == {k: 4 if k[1] < 3 else 1 for k in once}


def test_words_of_a_batch_are_taken_out_once_each(spark):
    """Counting goes by numbers: no text is made for each word of each chunk. Rows with equal keys are counted apart."""
    import inspect
    source = inspect.getsource(S.body_terms)
    assert "dictionary.to_pylist()" in source and 'column("words").to_pylist()' not in source
    texts = ["aa Running running aa bb", "aa", None, " .,", "книгами книга", ""]
    rows = spark.createDataFrame([(d // 2, 0, 5, x) for d, x in enumerate(texts)], "doc_id long, chunk_no int, len long, text string").coalesce(1)
    plain = rows.select("doc_id", S.stems(F.col("text")).alias("s")).collect()
    want = sorted((r.doc_id, *pair) for r in plain for pair in collections.Counter(r.s or ()).items())
    assert sorted((r.doc_id, r.term, r.tf_body) for r in S.body_terms(rows).collect()) == want
    assert [n for d, t, n in want if t == "aa"] == [1, 2]


def test_blocks_are_proposed_by_gram_numbers(spark):
    """The index holds a gram once for each piece of blocks, and rows are counted together as each text alone; keys may repeat."""
    words, blocks = some_blocks(spark)
    index = C.build_gram_index(blocks)
    assert index.grams.count() < index.grams.agg(F.sum("n")).first()[0] / 10
    want = collections.Counter(r.gram for r in C.trigram_index(blocks).collect())
    assert {r.gram: r.df for r in index.counts.collect()} == want
    assert sorted(map(tuple, index.grams.select("gram", F.explode("places").alias("p")).select("gram", "p.*").collect())) == sorted(
        map(tuple, C.trigram_index(blocks).collect()))
    plan = C.variant_hits(index, spark.createDataFrame([(w,) for w in words], "variant string"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(g#" in plan and "collect_list(variant" not in plan


def test_rows_are_counted_as_their_texts_are():
    rnd = random.Random(5)
    variants = ["aba", "abab", "aaa", "b_a", "a-b", "ы1a", "-ab", "abc"]
    counter = C.VariantCounter()
    counter.add(variants)
    columns = [["".join(rnd.choice("aab_-ы1 ") for _ in range(rnd.randrange(0, 80))) for _ in range(50)] for _ in range(3)]
    row, variant, counts = counter.count_rows(columns)
    got = {(int(r), counter.spelt[v]): list(map(int, n)) for r, v, n in zip(row, variant, counts)}
    plain = {(i, v): [counter.count(texts[i])[v] for texts in columns] for i in range(50) for v in variants}
    assert got == {k: n for k, n in plain.items() if any(n)}
    assert [len(x) for x in counter.count_rows([[], [], []])] == [0, 0, 0]


def test_grams_of_texts_in_order():
    rnd = random.Random(3)
    wide = ["".join(chr(rnd.randrange(0x20000, 0x2A000)) for _ in range(2000)) for _ in range(3)]
    for some in (wide + ["ab", "", "abcabc"], ["ab", "", "abcabc"], ["a"], ["".join(rnd.choice("abcы") for _ in range(90)) for _ in range(30)]):
        owner, first, found = C.gram_lists(some)
        want = collections.defaultdict(set)
        for k, t in enumerate(some):
            for i in range(len(t) - 2):
                want[t[i:i + 3]].add(k)
        assert found == sorted(want)
        assert {g: list(owner[a:b]) for g, a, b in zip(found, first, first[1:])} == {g: sorted(x) for g, x in want.items()}


def test_scores_meet_written_counts(spark):
    """Frequencies are not dealt again for the stems' numbers of chunks, and a chunk's postings are read together."""
    docs = spark.createDataFrame([(d, f"p{d}", f"Title {d}", "running books of the house " * (d + 1)) for d in range(6)], "doc_id long, path string, title string, text string")
    chunks = docs.select("doc_id", F.lit(0).alias("chunk_no"), "text")
    index = S.build_index(docs.drop("text"), chunks, spark.createDataFrame([], "canonical string, alias string"))
    terms = S.question_terms(spark.createDataFrame([(1, "running house")], "question_id long, text string"))
    scores = S.stem_scores(index, S.phrase_terms(terms, index.terms))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert scores.count() == 12


def odd_index(spark):
    """Documents with repeated keys, equal and different lengths, further titles, a chunk without words."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdeингсЁ1") for _ in range(rnd.randrange(2, 7))) for _ in range(150)] + ["running", "книгами", "houses"]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    rows = [(d, c, text(rnd.randrange(5, 40))) for d in range(60) for c in range(3)]
    rows += rows[:4] + [(4, 0, text(12)), (5, 1, "..."), (7, 2, rows[23][2])]
    docs = spark.createDataFrame([(d, f"p{d}", f"Title {words[d]}") for d in range(59)] + [(3, "p3", "Title twice")], "doc_id long, path string, title string")
    aliases = spark.createDataFrame([("p1", "other houses"), ("p1", "running"), ("none", "x")], "canonical string, alias string")
    return words, docs, spark.createDataFrame(rows, "doc_id long, chunk_no int, text string"), aliases


def test_counts_hold_what_postings_do(spark):
    """A chunk's terms lie in one row, whatever its keys; rows made of them, and the number and length of chunks, are as counted plainly."""
    words, docs, chunks, aliases = odd_index(spark)
    index = S.build_index(docs, chunks, aliases)
    keys = ["doc_id", "chunk_no"]
    assert index.counts.count() == chunks.select(*keys).distinct().count()
    titles = docs.select("doc_id", "title").unionByName(aliases.join(docs, F.col("path") == F.col("canonical")).select("doc_id", F.col("alias").alias("title")))
    plain, lengths, _ = S.build_postings(chunks.withColumn("n_words", F.size(S.words(F.col("text")))), titles)
    names = [*keys, "len", "term", "tf_title", "tf_body"]
    assert sorted(map(tuple, index.postings.select(*names).collect())) == sorted(map(tuple, plain.select(*names).collect()))
    assert index.stats.select("n", F.round("avg_len", 9)).first() == lengths.agg(F.count("*"), F.round(F.avg("len"), 9)).first()
    nothing = S.build_index(docs.filter("false"), chunks.filter("false"), aliases)
    assert tuple(nothing.stats.first()) == (0, None) and nothing.vocabulary().count() == 0
    terms = S.question_terms(spark.createDataFrame([(1, "running")], "question_id long, text string"))
    assert S.candidates(terms, S.chunk_scores(nothing, S.asked_stems(terms, nothing.terms))).count() == 0


def test_index_is_searched_without_moving_postings(spark, monkeypatch):
    """The best chunks are those of the scores as rows, in slices and in groups of questions too; no posting is shuffled or written."""
    words, docs, chunks, aliases = odd_index(spark)
    index = S.build_index(docs, chunks, aliases)
    rnd = random.Random(3)
    asked = [(q, " ".join(w[:rnd.randrange(2, 7)] for w in rnd.sample(words, 9))) for q in range(8)] + [(20, "zzzz"), (21, None)]
    terms = materialise(S.question_terms(spark.createDataFrame(asked + asked[:1], "question_id long, text string")), "t")
    stems = S.asked_stems(terms, index.terms)
    scores = S.chunk_scores(index, stems)
    rows = scores.rows()
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    best = scores.best(terms, 50, F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in best and "MapInArrow" in best
    phrases = S.phrase_terms(terms, index.terms)
    plain = collections.Counter((r.stem, r.doc_id, r.chunk_no, round(r.score, 9)) for r in rows.collect())
    assert plain == collections.Counter((r.stem, r.doc_id, r.chunk_no, round(r.score, 9)) for r in S.stem_scores(index, phrases).collect())
    tf = index.postings.join(phrases, "term").groupBy("stem", "doc_id", "chunk_no", "len", "phrase").agg(F.sum(F.col("tf_title") * 4 + F.col("tf_body")).alias("f"))
    df = tf.groupBy("stem", "phrase").agg(F.count("*").alias("df"))
    n, avg_len = index.stats.first()
    want = (tf.join(df, ["stem", "phrase"]).withColumn("s", S.bm25(F.col("f"), F.col("df"), F.col("len"), F.lit(n), F.lit(avg_len)))
            .groupBy("stem", "doc_id", "chunk_no", "len").agg(F.sum("s").alias("score")))
    assert plain == collections.Counter((r.stem, r.doc_id, r.chunk_no, round(r.score, 9)) for r in want.collect())
    names = ["question_id", "doc_id", "chunk_no", "score", "matched", "bm25_rank"]
    by_rows = sorted(tuple(r) for r in S.candidates(terms, materialise(rows, "rows"), 5).select(*names).collect())
    for size, most in ((4_000, 400_000), (7, 10)):
        monkeypatch.setattr(S, "SLICE", size)
        monkeypatch.setattr(S, "ASKED", most)
        got = sorted(tuple(r) for r in S.candidates(terms, S.chunk_scores(index, stems), 5).select(*names).collect())
        assert got == by_rows and len({r[0] for r in got}) == 8
    some = docs.filter("doc_id < 9")
    assert {r.doc_id for r in S.candidates(terms, scores, 5, some).collect()} <= set(range(9))


def test_documents_of_hits_alone_are_made_flat(spark):
    """Whether a hit holds its passage is asked of written hits; the table of documents is not shuffled for it."""
    from deskmill.plans.evaluation import ranks
    from deskmill.session import Tables, workspace
    folder = workspace(spark, "tables")
    passages = [f"passage  of w{i}a w{i}b w{i}c\nand more" for i in range(6)]
    docs = [(i + 1, f"text before\n{p if i < 4 else 'w%da w%db' % (i, i)} behind and filling {i} words", "en", "src2", 60) for i, p in enumerate(passages)]
    docs += [(i, f"other text {i} of nothing", "en", "src2", 20) for i in range(20, 26)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = ranks(Tables(spark, folder))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(text" in plan and "AS whole" not in plan
    assert "Window" not in plan  # the hits are read, not computed beside the documents
    assert {r.question_id: r["rank"] for r in found.collect()} == {**{i: 1 for i in range(4)}, 4: None, 5: None}
