"""Queries over whole documents, one per operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from deskmill.llm import bpe, divergence, line_dedup, packing, periodic_runs, secret_scan, sharding, simhash, token_counts, toxicity
from deskmill.llm.registry import query

# Fingerprints themselves need bit votes over XXH64 that DuckDB lacks, so op1 is compared with brute force in tests/llm.


@query("op1_simhash")
def op1(t):
    groups = simhash.near_groups(t.documents, words=3, distance=2, segments=2)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


@query("op2_secrets")
def op2(t):
    found = secret_scan.find_secrets(t.documents.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(secret_scan.span_text(F.col("secrets"), secret_scan.BASE), 256).alias("base_sha256"),
                        secret_scan.span_text(F.col("secrets")).alias("spans"))


@query("op8_byte_bpe")
def op8(t):
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(t.documents.select("doc_id", "text"), tokens, public_tokenizers.PATTERN).drop("text")
    both = bpe.decode(ids, tokens, public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_packing")
def op9(t):
    packed = packing.pack_documents(t.documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_toxicity")
def op3(t):
    return toxicity.score_toxicity(t.documents, t.labels).select("doc_id", "held_out", "score", "predicted", "evidence")


@query("op4_sharding")
def op4(t):
    sharded = sharding.shard_rows(t.documents, shards=8)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return sharded.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                          F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# Places are (document, unit); a unit is a line with the blank lines after it. Windows of at least 50 words are compared as text.
OP6_SQL = r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
), numbered AS (
  SELECT *, sum(CASE WHEN n > 1 AND regexp_matches(line, '\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS u FROM parts
), units AS (
  SELECT doc_id, u, string_agg(line, chr(10) ORDER BY n) AS unit FROM numbered GROUP BY doc_id, u
), counted AS (
  SELECT *, rtrim(unit, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line,
         len(regexp_extract_all(unit, '\S+')) AS words FROM units
), sums AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY u) AS after,
         sum(words) OVER (PARTITION BY doc_id ORDER BY u) - words AS before FROM counted
), whole AS (
  SELECT doc_id, list(line ORDER BY u) AS lines FROM sums GROUP BY doc_id
), ends AS (
  SELECT a.doc_id, 1 AS way, a.u AS s, min(b.u) AS e FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.after - a.before >= 50 AND b.u >= a.u
  WHERE a.words > 0 GROUP BY a.doc_id, a.u
  UNION ALL
  SELECT a.doc_id, 2, max(b.u), a.u FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND a.after - b.before >= 50 AND b.u <= a.u
  WHERE a.words > 0 GROUP BY a.doc_id, a.u
), runs AS (
  SELECT doc_id, way, s, e, array_to_string(list_slice(lines, (s + 1)::BIGINT, (e + 1)::BIGINT), chr(10)) AS content FROM ends JOIN whole USING (doc_id)
), later AS (
  SELECT *, row_number() OVER (PARTITION BY way, content ORDER BY doc_id, s) AS copy FROM runs
), gone AS (
  SELECT DISTINCT c.doc_id, c.u FROM sums c JOIN later l ON l.doc_id = c.doc_id AND l.copy > 1 AND c.u BETWEEN l.s AND l.e
)
SELECT s.doc_id, coalesce(string_agg(s.unit, chr(10) ORDER BY s.u) FILTER (WHERE g.u IS NULL), '') AS text,
       count(*)::BIGINT AS n_lines, count(g.u)::BIGINT AS n_deleted
FROM sums s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.u = s.u GROUP BY s.doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6(t):
    return line_dedup.drop_repeated_lines(t.documents).select("doc_id", "text", "n_lines", "n_deleted")


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), used AS (
  SELECT d, lang, source, unnest(words) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::BIGINT AS lang_n FROM used GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*)::BIGINT AS n FROM used JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS total,
         (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::BIGINT AS v FROM groups g
), langs AS (
  SELECT lang, sum(total)::BIGINT AS total FROM sizes GROUP BY lang
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) AS p,
         1 + (1000000000 * (k.lang_n + 2)) // (l.total + 2 * s.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM items
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op11_source_divergence", OP11_SQL)
def op11(t):
    return divergence.source_divergence(t.documents)


@query("op12_periodic_runs")
def op12(t):
    # a tenth of the documents is made periodic, as its id says, so that runs of every size occur
    docs = t.documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_seed"))
    found = periodic_runs.collapse_runs(docs, min_words=12, seed_col="_seed")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    rows = found.select("doc_id", "runs", best.alias("best"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period = -F.col("best.start"), -F.col("best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), F.col("best.length").alias("length"),
                       period.alias("period"), F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"),
                       F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), "collapsed_sha256")


@query("op13_token_counts")
def op13(t):
    counted = token_counts.count_tokens(t.documents.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
