"""Knowledge-base search queries: all benchmark items are asked over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.functions import fixed as X
from deskmill.functions.text import cut_ending, stem_pattern, words
from deskmill.operators import search as S
from deskmill.plans.corpus import CHUNKS_SQL, KB_SQL, TITLE, knowledge_of
from deskmill.plans.registry import query
from deskmill.session import kept, materialise


PATTERN, GROUPS = stem_pattern(X.RU_ENDINGS, X.EN_ENDINGS)
PUT = "".join(f"\\{i + 1}" for i in range(GROUPS))


def stem_sql(w: str) -> str:
    return f"regexp_replace(lower(translate({w}, 'ёЁ', 'еЕ')), '{PATTERN}', '{PUT}')"


def stems_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{X.WORD}'), lambda w: {stem_sql('w')})"


STOPS = "list_transform([" + ",".join(f"'{w}'" for w in X.KB_STOP_WORDS) + f"], lambda w: {stem_sql('w')})"
TERMS_SQL = f"""stops AS (SELECT {STOPS} AS st),
q0 AS (SELECT item_id AS question_id, {stems_sql('text')} AS ss, st FROM benchmark, stops),
q1 AS (SELECT question_id, list_filter(ss, lambda x, i: list_position(ss, x) = i AND length(x) >= 2 AND NOT list_contains(st, x)) AS ss FROM q0),
terms AS MATERIALIZED (SELECT question_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS term_no, unnest(ss) AS stem FROM q1)"""
POST_SQL = KB_SQL + ", " + CHUNKS_SQL.format(src="documents_kb") + f""",
tt AS (SELECT doc_id, title FROM documents_kb UNION ALL SELECT d.doc_id, a.alias FROM
  (SELECT DISTINCT canonical, {TITLE.format(p='path')} AS alias, {TITLE.format(p='canonical')} AS own FROM kept WHERE path<>canonical) a
  JOIN documents_kb d ON d.path=a.canonical WHERE a.alias<>a.own),
th AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({stems_sql('title')}) AS term FROM tt) GROUP BY 1, 2),
body AS (SELECT doc_id, chunk_no, unnest({stems_sql('text')}) AS term FROM chunks),
post AS MATERIALIZED (SELECT doc_id, chunk_no, term, sum(a) AS tf_title, sum(b) AS tf_body FROM (SELECT doc_id, chunk_no, term, 0 AS a, 1 AS b FROM body
  UNION ALL SELECT c.doc_id, c.chunk_no, term, tf, 0 FROM th JOIN chunks c USING (doc_id)) GROUP BY 1, 2, 3),
lens AS (SELECT c.doc_id, c.chunk_no, coalesce(sum(p.tf_title + p.tf_body), 0) AS len FROM chunks c LEFT JOIN post p USING (doc_id, chunk_no) GROUP BY 1, 2),
stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens)"""
SCORE_SQL = POST_SQL + ", " + TERMS_SQL + """,
ds AS (SELECT DISTINCT stem FROM terms), voc AS (SELECT DISTINCT term FROM post),
shorts AS (SELECT stem, max_by(term, length(term)) AS short FROM ds JOIN voc ON starts_with(stem, term)
  AND length(term) BETWEEN greatest(4, length(stem)-3) AND length(stem)-1 GROUP BY 1),
ph AS (SELECT stem, 'prefix' AS phrase, term FROM ds JOIN voc ON starts_with(term, stem) UNION ALL SELECT stem, 'short', short FROM shorts),
tf AS (SELECT stem, phrase, doc_id, chunk_no, 4.0*sum(tf_title)+sum(tf_body) AS f FROM post JOIN ph USING (term) GROUP BY 1, 2, 3, 4),
dfs AS (SELECT stem, phrase, count(*) AS df FROM tf GROUP BY 1, 2),
sc AS MATERIALIZED (SELECT stem, doc_id, chunk_no, sum(CASE WHEN ln((n-df+0.5)/(df+0.5)) <= 0 THEN 1e-6 ELSE ln((n-df+0.5)/(df+0.5)) END
  * f*2.2/(f+1.2*(0.25+0.75*len/avg_len))) AS score FROM tf JOIN dfs USING (stem, phrase) JOIN lens USING (doc_id, chunk_no), stats GROUP BY 1, 2, 3)"""
RANK_SQL = SCORE_SQL + """,
per AS (SELECT question_id, doc_id, chunk_no, round(sum(score), 6) AS score, count(*) AS matched FROM terms JOIN sc USING (stem) GROUP BY 1, 2, 3),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, chunk_no) AS bm25_rank FROM per) WHERE bm25_rank <= 80),
ranked AS MATERIALIZED (SELECT c.*, sha1(ch.text) AS fingerprint, row_number() OVER (PARTITION BY question_id ORDER BY matched DESC, score DESC, c.doc_id, c.chunk_no) AS place
  FROM cand c JOIN chunks ch USING (doc_id, chunk_no))"""
# the walk over candidates keeps a list of place:doc:fingerprint texts
HITS_SQL = "WITH RECURSIVE " + RANK_SQL + """,
walk AS (SELECT question_id, 0::BIGINT AS place, []::BIGINT[] AS docs, []::VARCHAR[] AS texts, []::BIGINT[] AS places FROM (SELECT DISTINCT question_id FROM ranked)
  UNION ALL SELECT w.question_id, r.place,
   CASE WHEN len(w.places) < 8 AND len(list_filter(w.docs, lambda d: d = r.doc_id)) < 2 AND NOT list_contains(w.texts, r.fingerprint) THEN list_append(w.docs, r.doc_id) ELSE w.docs END,
   CASE WHEN len(w.places) < 8 AND len(list_filter(w.docs, lambda d: d = r.doc_id)) < 2 AND NOT list_contains(w.texts, r.fingerprint) THEN list_append(w.texts, r.fingerprint) ELSE w.texts END,
   CASE WHEN len(w.places) < 8 AND len(list_filter(w.docs, lambda d: d = r.doc_id)) < 2 AND NOT list_contains(w.texts, r.fingerprint) THEN list_append(w.places, r.place) ELSE w.places END
  FROM walk w JOIN ranked r ON r.question_id = w.question_id AND r.place = w.place + 1),
done AS (SELECT question_id, max_by(places, place) AS places FROM walk GROUP BY 1),
hits AS (SELECT d.question_id, list_position(d.places, r.place) AS rank, r.place, r.doc_id, r.chunk_no, r.score, r.matched
  FROM done d JOIN ranked r ON r.question_id = d.question_id AND list_contains(d.places, r.place))"""


def questions(t):
    return t.benchmark.select(F.col("item_id").alias("question_id"), "text")


def index_of(t):
    """The index of the documents as they are; it is built once and kept until a file of the table changes."""
    def build(write):
        # what is told of a text is computed where it is read, so that the documents are put together without it
        kb = knowledge_of(t.documents.withColumn("chars", F.length("text")))
        documents = kb["documents"].select("doc_id", "path", "title", "product", "digest", "chars")
        S.build_index(documents, kb["chunks"], kb["aliases"], write)

    return S.TextIndex(**kept(t.documents, "text-index", build))


def ranked(t):
    index = index_of(t)
    terms = S.question_terms(questions(t))
    # written, so that its size is known when chunks and documents meet it
    found = materialise(S.rank_candidates(S.candidates(terms, S.chunk_scores(index, S.asked_stems(terms, index.terms)))), "found")
    return S.hydrate(found, index.chunks, index.documents)


@query("tokens_stemmed", f"SELECT doc_id, array_to_string({stems_sql('text')}, ' ') AS stemmed FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(S.stems(F.col("text")), " ").alias("stemmed"))


@query("suffix_stem", f"""
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{X.WORD}'))) AS word FROM documents) SELECT word, {stem_sql('word')} AS stem FROM w""")
def _(t):
    vocabulary = t.documents.select(F.explode(words(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return vocabulary.select("word", cut_ending(F.col("word"), en=X.EN_ENDINGS).alias("stem"))


@query("query_terms", "WITH " + TERMS_SQL + " SELECT * FROM terms")
def _(t):
    return S.question_terms(questions(t))


@query("vocabulary", "WITH " + POST_SQL + " SELECT term, count(*) AS df, CAST(sum(tf_title+tf_body) AS BIGINT) AS cf FROM post GROUP BY 1")
def _(t):
    return index_of(t).vocabulary()


@query("corpus_stats", "WITH " + POST_SQL + " SELECT n, round(avg_len, 6) AS avg_len FROM stats")
def _(t):
    return index_of(t).stats.select("n", F.round("avg_len", 6).alias("avg_len"))


@query("shorter_stem", "WITH " + SCORE_SQL + " SELECT stem, short FROM shorts")
def _(t):
    stems = S.question_terms(questions(t)).select("stem").distinct()
    return S.shorter_stems(stems, index_of(t).terms)


@query("prefix_match", "WITH " + SCORE_SQL + " SELECT stem, term FROM ph WHERE phrase='prefix'")
def _(t):
    stems = S.question_terms(questions(t)).select("stem").distinct()
    return S.prefix_terms(stems, index_of(t).terms)


@query("bm25_weighted", "WITH " + SCORE_SQL + " SELECT stem, doc_id, chunk_no, round(score, 6) AS score FROM sc")
def _(t):
    index = index_of(t)
    asked = S.asked_stems(S.question_terms(questions(t)), index.terms)
    return S.chunk_scores(index, asked).rows().withColumn("score", F.round("score", 6))


@query("bm25_candidates", "WITH " + RANK_SQL + " SELECT question_id, doc_id, chunk_no, score, matched, bm25_rank FROM cand")
def _(t):
    index = index_of(t)
    terms = S.question_terms(questions(t))
    return S.candidates(terms, S.chunk_scores(index, S.asked_stems(terms, index.terms)))


@query("kb_rank", "WITH " + RANK_SQL + " SELECT question_id, doc_id, chunk_no, matched, score, place FROM ranked")
def _(t):
    return ranked(t).select("question_id", "doc_id", "chunk_no", "matched", "score", "place")


@query("hydrate_hits", "WITH " + RANK_SQL + """ SELECT r.question_id, r.place, d.path, r.chunk_no, r.fingerprint FROM ranked r JOIN documents_kb d USING (doc_id)""")
def _(t):
    return ranked(t).select("question_id", "place", "path", "chunk_no", "fingerprint")


@query("per_doc_cap", "WITH " + RANK_SQL + """ SELECT question_id, doc_id, chunk_no, place FROM
(SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY place) AS rn FROM ranked) WHERE rn <= 2""")
def _(t):
    return S.per_doc_cap(ranked(t)).select("question_id", "doc_id", "chunk_no", "place")


@query("same_text_once", "WITH " + RANK_SQL + """ SELECT question_id, fingerprint, min(place) AS place FROM ranked GROUP BY 1, 2""")
def _(t):
    return S.same_text_once(ranked(t)).select("question_id", "fingerprint", "place")


@query("ranked_hits", HITS_SQL + " SELECT question_id, rank, doc_id, chunk_no, score, matched FROM hits")
def _(t):
    return S.pick_hits(ranked(t)).drop("place")


SNIPPET_SQL = HITS_SQL + f""",
qt AS (SELECT t.question_id, list(stem ORDER BY term_no) AS ts, list(coalesce(short, '') ORDER BY term_no) AS hs FROM terms t LEFT JOIN shorts USING (stem) GROUP BY 1),
hw AS (SELECT h.*, c.text, d.path, d.title, regexp_extract_all(c.text, '{X.WORD}') AS ws, regexp_split_to_array(c.text, '{X.WORD}') AS gs, ts, hs
  FROM hits h JOIN chunks c USING (doc_id, chunk_no) JOIN documents_kb d USING (doc_id) JOIN qt USING (question_id)),
wd AS (SELECT question_id, rank, i, {stem_sql('w')} AS s FROM (SELECT question_id, rank, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM hw)),
wt AS (SELECT wd.question_id, wd.rank, i, list_filter(range(1, len(ts)+1), lambda k: starts_with(s, ts[k]) OR s = hs[k]) AS ks FROM wd JOIN hw USING (question_id, rank)),
wa AS (SELECT question_id, rank, list(ks ORDER BY i) AS kk FROM wt GROUP BY 1, 2),
st AS (SELECT question_id, rank, a, len(list_distinct(flatten(list_slice(kk, a+1, a+45)))) AS k FROM (SELECT *, unnest(range(0, len(kk), 5)) AS a FROM wa)),
bs AS (SELECT question_id, rank, min_by(a, (-k, a)) AS a FROM st GROUP BY 1, 2),
sn AS (SELECT hw.*, bs.a, least(bs.a+45, len(ws)) AS b, kk FROM hw JOIN bs USING (question_id, rank) JOIN wa USING (question_id, rank))
SELECT question_id, rank, doc_id, chunk_no, path, title, matched, score, (CASE WHEN a > 0 OR gs[1] <> '' THEN '…' ELSE '' END)
 || replace(array_to_string(list_transform(range(a+1, b+1), lambda i: (CASE WHEN i > a+1 THEN gs[i] ELSE '' END)||CASE WHEN len(kk[i]) > 0 THEN '['||ws[i]||']' ELSE ws[i] END), ''), chr(10), ' ')
 || (CASE WHEN b < len(ws) OR gs[len(ws)+1] <> '' THEN '…' ELSE '' END) AS snippet FROM sn"""


def kb_hits(t):
    return S.search(index_of(t), questions(t))


@query("kb_search", SNIPPET_SQL)
def _(t):
    return kb_hits(t).select("question_id", "rank", "doc_id", "chunk_no", "path", "title", "matched", "score", "snippet")


@query("snippet_window", SNIPPET_SQL.replace("SELECT question_id, rank, doc_id, chunk_no, path, title, matched, score, (CASE", "SELECT question_id, rank, (CASE"))
def _(t):
    return kb_hits(t).select("question_id", "rank", "snippet")
