"""Operators on embeddings and pages, graph components and the pipeline."""

import time
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskmill.llm import ann, embedding_dedup, graph, html_text
from deskmill.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [(1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2),
       (5, [1.0, 0.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [float("nan"), 1.0, 0.0], 1), (9, [None, 1.0, 0.0], 1),
       (10, [], 1), (11, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (12, [float("inf"), 0.0, 0.0], 1), (13, [0.0, 1.0, 0.0], 1)]


def frame(spark, rows, shape=VECTORS):
    return spark.createDataFrame(rows, shape)


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(60)]
    edges = [*chain, *[(100, 100 + i) for i in range(50)], (7, 7), (500, None), *[(int(a), int(b)) for a, b in rng.integers(200, 400, (90, 2))]]
    near = defaultdict(set)
    for a, b in edges:
        if b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = graph.components(frame(spark, edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert graph.components(frame(spark, [], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("block", [7, 512])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(12):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 30)):
            rows.append((n, (base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2])).astype("f4").tolist(), int(rng.integers(0, 2))))
            n += 1
    v = np.array([r[1] for r in rows], "f8")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    linked = (u @ u.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(n)
    for _ in range(n):
        root = np.minimum(root, np.where(linked, root[None, :], n).min(1))
    got = {r.id: r for r in embedding_dedup.near_vectors(frame(spark, rows), block=block).collect()}
    assert [got[i].n_links for i in range(n)] == linked.sum(1).tolist()
    assert [got[i].component for i in range(n)] == root.tolist()
    assert all(r.kept == (r.id == r.component) for r in got.values())


def test_near_vectors_odd_rows(spark):
    docs = frame(spark, ODD).withColumn("n_links", F.lit("x"))
    got = embedding_dedup.near_vectors(docs).collect()
    assert len(got) == len(ODD)
    links = {(r.id, r.n_links, r.component) for r in got}
    assert {(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (13, 0, 13), (None, 0, None)} <= links
    assert all(r.n_links == 0 for r in got if r.id is None or r.id > 3)
    assert embedding_dedup.near_vectors(frame(spark, [])).count() == 0


def brute_nearest(rows, queries, top):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8")
    out = {}
    for q in queries:
        s = (v * v[ids == q][0]).sum(1)
        out[q] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:top]
    return out


def test_ann_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in QUERIES["op5_ann"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 20 * len(want)
    exact = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(exact[q, v] - s) < 1e-12 for q in got for v, s in got[q] if (q, v) in exact)


def test_ann_odd_rows(spark):
    got = ann.nearest(frame(spark, ODD).withColumn("rank", F.lit("x")), F.col("vec_id") % 2 == 0, top=3).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    assert found[4, 1] == (3, 2.0) and found[4, 2] == (1, 1.0) and found[4, 3][0] == 2
    assert {q for q, _ in found} == {2, 4}
    assert ann.nearest(frame(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    same = frame(spark, [(i, [1.0, 2.0], 0) for i in range(900)])
    ties = ann.nearest(same, F.col("vec_id") == 5, top=4, leaf=50).orderBy("rank").collect()
    assert [r.vec_id for r in ties] == [0, 1, 2, 3]


def test_ann_small_leaves(spark):
    """Every query gets all it asked for, though no leaf it visits first holds that many; blocks of queries change nothing."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(700, 6)))]
    asks = F.col("vec_id") % 7 == 0
    got = {}
    for block in (3, 1000):
        found = ann.nearest(frame(spark, rows), asks, top=20, recall=0.01, leaf=3, query_block=block).collect()
        got[block] = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    assert got[3] == got[1000]
    assert set(got[3]) == {(q, k) for q in range(0, 700, 7) for k in range(1, 21)}
    exact = brute_nearest([(i, v) for i, v, _ in rows], list(range(0, 700, 7)), 20)
    full = ann.nearest(frame(spark, rows), asks, top=20, recall=1.0, leaf=3, query_block=3).collect()
    hits = sum(r.vec_id in {v for v, _ in exact[r.query_id]} for r in full)
    assert hits >= 0.99 * 20 * 100


def test_ann_repeated_id(spark):
    """An id on a third of all rows: each row is a candidate, none of its own id's queries."""
    rows = [(1 if i % 3 == 0 else i + 10, [1.0, float(i)], 0) for i in range(600)]
    got = ann.nearest(frame(spark, rows), F.col("vec_id") == 11, top=5, leaf=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(609, 600.0), (608, 599.0), (1, 598.0), (606, 597.0), (605, 596.0)]


def test_ann_tree_grows(spark):
    """Leaves and places agree with the walk from the root, and every leaf is visited once."""
    rows = np.random.default_rng(2).normal(size=(500, 4))
    tree = ann.Tree(rows, leaf=8)
    assert sorted(tree.visit(rows[0])) == list(range(tree.leaves))
    assert tree.leaves >= 500 / 8
    assert set(tree.place(rows).tolist()) <= set(range(tree.leaves))


class _Article(HTMLParser):
    """Text of <article> by block, for pages of the test tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = QUERIES["op7_html_text"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        reader = _Article()
        reader.feed(pages[r.page_id])
        reader.close()
        want = "\n\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)
        assert (r.text, r.n_chars) == (want, len(want))


PAGE = """<html><head><title>t</title></head><body><header><h1>Site name</h1><p>Welcome to our site, it has many words</p></header>
<div class="top header"><p>The second head of this site is made of words too</p></div>
<div class="cookie-notice"><p>We use cookies on this site, please accept them all.</p></div><div id="content"><h1>Title &amp; more</h1>
<p>First paragraph of the story, long   enough to win.</p><div class="advert"><p>Buy cheap things now, they are very good</p></div>
<p>Second paragraph<br>with a <a href="x">link &lt;in&gt;</a> side.</p><form><p>Subscribe here please</p><input></form></div>
<aside><p>Other things are here with many words to read</p></aside>
<section class="comments"><p>Nice article, I liked it very much, thanks</p></section><footer>Foot and more</footer></body></html>"""


def test_main_text_of_other_pages():
    counts = html_text.count_features([PAGE.replace('<div id="content">', "<article>").replace("</form></div>", "</form></article>")] * 3)
    want = "Title & more\n\nFirst paragraph of the story, long enough to win.\n\nSecond paragraph with a link <in> side."
    for weights in (html_text.weights_of(counts), {}):
        assert html_text.main_text(PAGE, weights) == want
    for page, text in ((None, ""), ("", ""), ("plain words only", "plain words only"), ("<p>not closed <b>here", "not closed here"),
                       ("<script>a b c", ""), ("<!-- a b", ""), ("1 < 2 & 3", "1 < 2 & 3")):
        assert html_text.main_text(page, {}) == text


def test_wrappers_are_not_noise():
    story = "<h1>A title of five words</h1><p>The story has a few words in its first paragraph.</p>"
    want = "A title of five words\n\nThe story has a few words in its first paragraph."
    side = '<div class="sidebar"><p>Read these other things on the side</p></div><nav><a href="x">One menu</a></nav>'
    for before, after in (('<div class="has-sidebar">', "</div>"), ('<div class="content-with-sidebar">', "</div>"),
                          ('<div class="two-column left-side">', "</div>"), ("<form action=x>", "</form>"), ('<div class="sidebar">', "</div>")):
        for body in (story, f"<article>{story}</article>", f"<main>{story}</main>"):
            assert html_text.main_text(f"<html><body>{before}{body}{side}{after}</body></html>", {}) == want
    assert html_text.main_text(f"<html><head><title>t</title><meta x=y><body>{story}</body></html>", {}) == want
    assert html_text.main_text(f"<head><title>t</title>{story}", {}) == want


def test_names_that_only_hold_a_noise_word():
    parts = [f'<h2 id="{x}">About {x}</h2><p>Here are some words.</p>' for x in ("related-work", "search-algorithms", "social-effects", "side-effects",
                                                                               "comments")]
    page = "<article>" + "".join(parts) + '<div class="alert-box"><p>Mind this.</p></div><div class="ad"><p>Buy it.</p></div></article>'
    text = html_text.main_text(page, {})
    assert text.count("Here are some words.") == text.count("About ") == 5 and "Mind this." in text and "Buy it." not in text
    talk = '<article><p>Short story.</p><section class="comments"><p>' + "a long talk " * 50 + "</p></section></article>"
    assert html_text.main_text(talk, {}) == "Short story."


def test_best_region_is_the_largest_sum():
    rng = np.random.default_rng(5)
    for _ in range(200):
        weights = {f"<{i}": float(x) for i, x in enumerate(rng.integers(-5, 6, 12))}
        pieces = [html_text.Piece(f"<{i}", 0, None, False, False, False) for i in range(12)]
        start, end = html_text.best_region(pieces, weights)
        value = lambda a, b: sum(weights[f"<{i}"] for i in range(a, b))
        assert value(start, end) == max(0, max(value(a, b) for a in range(12) for b in range(a + 1, 13)))


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>some words here</p>"), (4, "u", "<p>" + "long " * 50_000)]
    got = html_text.extract_text(frame(spark, rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 15, 249_999]
    assert html_text.extract_text(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        path = str(tmp_path / name)
        out.write.parquet(path)
        if n + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.read.parquet(path)
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > 150
    pieces = spark.read.parquet(path)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]
    assert corpus_pipeline.run(spark, SMALL).count() == pieces.count()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, next to a plain version of it."""
    import corpus_pipeline
    from deskmill.llm import secret_scan, toxicity
    from test_llm_documents import groups_of, plain_line_dedup, plain_secrets

    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        kept.append((name, {r.doc_id: r.text for r in docs.collect()}, spark.read.parquet(path)))
        docs = spark.read.parquet(path)
    (_, before, after), (_, lines_in, lines_out), (_, near_in, near_out), (_, secrets_in, secrets_out), (_, packed_in, packed) = kept
    scored = toxicity.score_toxicity(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored if not r.predicted} < set(before)
    assert {r.doc_id: r.text for r in lines_out.collect()} == {i: t for i, (t, _) in plain_line_dedup(sorted(lines_in.items()), 50).items()}
    assert all(r.n_chars == len(r.text) for r in lines_out.collect())
    low = {i: [w.decode() for w in t.encode().lower().split()] for i, t in near_in.items()}
    runs = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in low.items()}
    alike = lambda a, b: low[a] == low[b] or len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]) > 0
    ids = sorted(low)
    roots = groups_of(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if alike(a, b)])
    assert {r.doc_id for r in near_out.collect()} == {i for i in ids if roots[i] == i}
    scanner = secret_scan.Scanner()
    for r in secrets_out.collect():
        spans = scanner.spans(secrets_in[r.doc_id])
        assert [x for x in spans if x[0] in secret_scan.BASE] == plain_secrets(secrets_in[r.doc_id])
        assert r.text == secret_scan.redacted(secrets_in[r.doc_id], spans) and r.n_chars == len(r.text)
    assert {r.doc_id for r in packed.collect()} == set(packed_in)
    bins = defaultdict(list)
    for r in packed.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 2048 and [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] for b in bins.values())


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "", "en", "s", 0), (None, None, None, None, None)]
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, shape)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{len(rows)}")
            stage(spark, docs, SMALL).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == bool(rows)


def test_an_id_on_rows_of_unequal_vectors(spark):
    near = [[1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [1.0, 0.0, 0.01]]
    rows = [(1, near[0], 5), (1, near[1], 5), (2, near[2], 5), (2, [0.0, 1.0, 0.0], 5), (3, [0.0, 1.0, 0.01], 5), (9, near[0], 6), (1, near[0], 5)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    assert sorted((r.id, r.n_links, r.component) for r in found.collect()) == [
        (1, 3, 1), (1, 3, 1), (1, 3, 1), (2, 1, 2), (2, 3, 1), (3, 1, 2), (9, 0, 9)]


def test_hidden_is_an_attribute_not_a_word():
    page = ('<body><article><p title="the hidden costs of war">First paragraph</p><div data-x="a hidden gem">second</div><p hidden>gone</p>'
            '<p style="color: red; display : none">gone</p><p data-class="menu" title="class=menu">third</p></article></body>')
    texts = [p.text for p in html_text.read_page(page) if p.text and not p.noise]
    assert texts == ["First paragraph", "second", "third"]


@pytest.mark.parametrize("page", ['<a x="' * 8000, "<span>" * 8000 + "</b>" * 8000, "<li><div>" + "<span>" * 8000 + "<li></li>" * 4000,
                                  "<!--" * 10000, "< " * 30000, "<p '" * 9000 + ">"])
def test_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    html_text.read_page(page)
    assert time.perf_counter() - start < 2
