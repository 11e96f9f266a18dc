"""Source divergence, periodic runs and token counts next to plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deskmill.llm import bpe, divergence, html_text, line_dedup, periodic_runs, secret_scan, token_counts, toxicity
from deskmill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


# --- source divergence

def plain_divergence(rows, min_docs, top=10, scale=10 ** 9):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {k[0] for k in counts}:
        kept = [w for w, n in docs[lang].items() if n >= min_docs]
        groups = {s: Counter({w: c[w] for w in kept if c[w]}) for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())
        share = lambda c, w: 1 + scale * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in groups.items():
            pairs = [(sum(gap(share(c, w), share(d, w)) for w in kept), x) for x, d in groups.items() if x != s]
            terms = [(gap(share(c, w), share(whole, w)), w) for w in c if share(c, w) > share(whole, w)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def many_sources(seed, docs, sources, vocabulary):
    rnd = random.Random(seed)
    words = ["w" + "".join(rnd.choice("abcdeé") for _ in range(4)) for _ in range(vocabulary)]
    rows = []
    for _ in range(docs):
        lang = rnd.choice(["en", "en", "de", None])
        text = " ".join(words[min(int(rnd.paretovariate(0.7)) - 1, vocabulary - 1)].upper() if rnd.random() < 0.1 else
                        words[min(int(rnd.paretovariate(0.7)) - 1, vocabulary - 1)] for _ in range(rnd.randrange(60)))
        rows.append((lang, "s" + str(min(int(rnd.paretovariate(0.5)) - 1, sources - 1)), rnd.choice([text, text, text, None])))
    return rows


@pytest.mark.parametrize("tile,shard", [(512, 4096), (3, 16)])
def test_divergence_is_plain(spark, monkeypatch, tile, shard):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "HELD", 200)
    rows = many_sources(3, 400, 12, 150) + [("xx", "only", "alone here"), ("yy", "a", ""), ("yy", None, "..."), ("yy", "", "x")]
    docs = spark.createDataFrame([(*r, 7, "p") for r in rows], "lang string, source string, text string, n int, term string").repartition(5)
    found = divergence.source_divergence(docs, min_docs=4)
    assert {tuple(r) for r in found.collect()} == plain_divergence(rows, 4)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(docs).count() == 0


def test_divergence_joint_cells_are_per_count():
    """The function is evaluated per pair of counts, whatever the number of words."""
    words = 500
    source, word, n = np.repeat([0, 1], words), np.tile(np.arange(words), 2), np.concatenate([np.full(words, 2), np.full(words, 3)])
    totals, kept = np.array([2 * words, 3 * words]), np.full(2, words)
    side = np.arange(2)
    value = divergence._shard_pairs(source, word, n, words, totals, kept, side, side, 10 ** 9)[0, 1]
    p, q = (1 + 10 ** 9 * (c + 2) // (c * words + 2 * words) for c in (2, 3))
    assert value == words * ((p - q) ** 2 // (p + q))


# --- periodic runs

def plain_runs(words, min_words=12):
    """All runs by going through every period."""
    n, runs = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            length = i - s + p
            if length >= max(min_words, 2 * p) and not any(
                    all(words[k] == words[k + q] for k in range(s, s + length - q)) for q in range(1, p)):
                runs.add((s, length, p))
    return sorted(runs)


def plain_planted(words, h):
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts():
    rnd = random.Random(5)
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts = [" ".join(fib[-1]), " ".join("abcabdabcabdabcabdabc" * 3), "x " * 500, "x " * 11, "x " * 12, None, "", " \t\n ", "a b c"]
    for alphabet in (1, 2, 3, 8):
        for _ in range(25):
            texts.append(" ".join(str(rnd.randrange(alphabet)) for _ in range(rnd.randrange(120))))
    for _ in range(30):
        part = [str(rnd.randrange(50)) for _ in range(rnd.randrange(1, 40))]
        text = [str(rnd.randrange(50)) for _ in range(60)] + part * rnd.randrange(2, 6) + part[:rnd.randrange(len(part))]
        texts.append("\x0b".join(text + [str(rnd.randrange(50)) for _ in range(60)] + rnd.choice([[], part * 3])))
    return texts


@pytest.mark.parametrize("held", [5_000, 50])
def test_runs_are_plain(spark, monkeypatch, held):
    monkeypatch.setattr(periodic_runs, "TREE_WORDS", held)
    texts = run_texts()
    docs = spark.createDataFrame([(i, t, "r", "s") for i, t in enumerate(texts)], "doc_id long, text string, runs string, row string").coalesce(2)
    for r in periodic_runs.collapse_runs(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        runs = plain_runs(words)
        assert [tuple(x) for x in r.runs] == runs, words
        assert (r.collapsed, r.row) == (plain_collapsed(words, runs), "s")


def test_runs_min_words(spark):
    texts = [t for t in run_texts() if t]
    for least in (2, 5, 30):
        ids = [np.unique(t.split(), return_inverse=True)[1] + 9 * i for i, t in enumerate(texts)]
        found = periodic_runs.find_runs(np.concatenate(ids), np.array([len(x) for x in ids]), least)
        assert [tuple(r) for r in found.tolist()] == [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t.split(), least)]


def test_common_extensions_against_plain():
    rnd = np.random.default_rng(2)
    words = np.concatenate([rnd.integers(1, 4, 300), [0]])
    trees = periodic_runs.Extensions(words, 1)
    a, b = rnd.integers(0, 300, (2, 2000))
    a, b = a[a != b], b[a != b]
    plain = [next(k for k in range(301) if words[i + k] != words[j + k]) for i, j in zip(a, b)]
    assert trees.common(a, b).tolist() == plain
    order = sorted(range(301), key=lambda i: words[i:].tolist())
    assert np.argsort(trees.rank).tolist() == order
    flipped = np.where(words == 0, 0, 4 - words)
    assert np.argsort(trees.backward_rank()).tolist() == sorted(range(301), key=lambda i: flipped[i:].tolist())


def test_op12_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, FOLDER).collect()
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    for r in rows:
        words = plain_planted(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""), zlib.crc32(str(r.doc_id).encode()))
        runs = plain_runs(words) if len(words) < 1500 else None
        if runs is None:
            continue
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()


def test_runs_of_nothing(spark):
    assert periodic_runs.collapse_runs(spark.createDataFrame([], "text string")).count() == 0


# --- token counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own_counter():
    with open(PATH, encoding="utf-8") as file:
        return token_counts.Counter(file.read(), *token_counts.character_classes())


def odd_texts():
    rnd = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "'", "''", "'s", "'t", "'re", "'ve", "'ll", "'m", "'d", "'r", "'v", "'l", "'S", "a", "r", "e", "l",
             "1", "٣", "é", "ж", "漢字", "\U0001f600", "!", ".", "<|endoftext|>", "<|endof", "the", "word", "\x00", "\x85", "\ufffd", "\u0301"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(6000)]
    texts += ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 60))) for _ in range(2000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(1, 0x3000)])) for _ in range(40)) for _ in range(2000)]
    texts += ["".join(rnd.choice(["in", "ter", "nation", "al", "iz", "ing", "un", "ed", "s"]) for _ in range(rnd.randrange(1, 9))) for _ in range(2000)]
    return texts + ["", "a" * 5000, " " * 3000, "'r", "'", " '", "x'r", "'s" * 400, "=" * 700, "ab" * 900 + "\n" * 400 + "c"]


def test_token_counts_are_the_librarys(library, own_counter):
    texts = odd_texts()
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    found = own_counter.count(texts)
    assert [t for t, a, b in zip(texts, want, found.tolist()) if a != b] == []


def test_token_counts_of_every_character(library, own_counter):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}'s" for c in points[k:k + 64]) for k in range(0, len(points), 64)]
    assert own_counter.count(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_chunks_and_restarts_change_nothing(own_counter, monkeypatch):
    texts = odd_texts()[:3000]
    want = own_counter.count(texts).tolist()
    whole = "".join(texts)
    classes = np.append(own_counter.kinds[np.frombuffer(whole.encode("utf-32-le"), "<u4")], token_counts.END)
    assert all((token_counts.pretoken_starts(classes, k) == token_counts.pretoken_starts(classes, len(classes))).all() for k in (1, 2, 7, 256))
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "SLICE", 300)
    assert own_counter.count(texts).tolist() == want


def test_token_counts_keep_columns(spark):
    docs = spark.createDataFrame([("a b c", None, 9, "x"), (None, "<|endoftext|>", 9, "x"), ("", "y z", 9, "x")],
                                 "row string, text string, n_tokens int, _in string")
    assert sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=str) == [
        ("", "y z", "x", 2), ("a b c", None, "x", 0), (None, "<|endoftext|>", "x", 1)]
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_op13_on_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op13_token_counts"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


# --- columns of the caller that are called like helper columns

def test_helper_columns_meet_no_column_of_the_caller(spark):
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.createDataFrame([(1, "password = abcdef12", "a", "b", "c", "d"), (2, None, "a", "b", "c", "d")],
                                 "doc_id long, text string, _text string, spans string, _in string, _html string")
    own = lambda frame: sorted((r["_text"], r["spans"], r["_in"], r["_html"]) for r in frame.collect())
    for made in (secret_scan.find_secrets(docs, clean_col="clean"), line_dedup.drop_repeated_lines(docs),
                 bpe.encode(docs, tokens, public_tokenizers.PATTERN), token_counts.count_tokens(docs, PATH), periodic_runs.collapse_runs(docs)):
        assert own(made) == [("a", "b", "c", "d")] * 2
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), "_text", "spans", "_in", "_html")
    assert own(html_text.extract_text(pages)) == [("a", "b", "c", "d")] * 2


def test_toxicity_stage_keeps_a_column_called_like_its_own(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    docs = read("documents").withColumn("_text", F.lit("mine"))
    kept = toxicity.keep_clean(docs, read("labels"))
    assert kept.columns == docs.columns and [r[0] for r in kept.select("_text").distinct().collect()] == ["mine"]
