"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.operators import code_search as C
from deskmill.operators import evaluation as E
from deskmill.operators import search as S
from deskmill.plans.code import CODE_SQL, code_blocks, code_index
from deskmill.plans.registry import query
from deskmill.plans.search import HITS_SQL, questions, ranked
from deskmill.session import materialise

# a hit is expected if its document holds the whole passage, white space aside
RANKS_SQL = HITS_SQL + r""",
flat AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS whole FROM documents),
asked AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS passage FROM benchmark),
er AS (SELECT b.item_id AS question_id, min(CASE WHEN contains(f.whole, b.passage) THEN h.rank END) AS rank FROM asked b
  LEFT JOIN hits h ON h.question_id = b.item_id LEFT JOIN flat f ON f.doc_id = h.doc_id GROUP BY 1)"""


def flat(text):
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ranks(t):
    # the hits are written, so that their size is known when the documents meet them; only the hits' texts are made flat
    hits = materialise(S.pick_hits(ranked(t)), "hits").join(t.documents.select("doc_id", "text"), "doc_id")
    wanted = questions(t).select("question_id", flat("text").alias("passage"))
    return E.expected_ranks(hits, wanted, F.contains(flat("text"), F.col("passage")), questions(t))


@query("expected_hits", RANKS_SQL + " SELECT question_id, rank FROM er")
def _(t):
    return ranks(t)


METRICS_SQL = """SELECT count(*) AS questions, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS top5,
  round(avg(CASE WHEN rank <= 8 THEN 1.0 ELSE 0 END), 6) AS top8, round(avg(coalesce(1.0/rank, 0)), 6) AS mrr FROM er"""


@query("retrieval_metrics", RANKS_SQL + METRICS_SQL)
def _(t):
    return E.metrics(ranks(t))


@query("quality_gate", RANKS_SQL + ", m AS (" + METRICS_SQL + ") SELECT top8, top8 >= 0.5 AS passed FROM m")
def _(t):
    return E.quality_gate(E.metrics(ranks(t)), 0.5)


@query("unique_proc", "SELECT p_partkey, p_name, p_size FROM part QUALIFY count(*) OVER (PARTITION BY p_name||p_size) = 1")
def _(t):
    named = t.part.withColumn("k", F.concat("p_name", F.col("p_size").cast("string")))
    return E.unique_names(named, "k").select("p_partkey", "p_name", "p_size")


POOL_SQL = CODE_SQL + r""",
u AS (SELECT * FROM code WHERE kind IN ('proc','func') QUALIFY count(*) OVER (PARTITION BY lower(name)) = 1),
tx AS (SELECT *, trim(regexp_replace(string_split(body, chr(10))[1], '^\s*/*', '')) AS c0 FROM u),
cm AS (SELECT *, CASE WHEN starts_with(trim(string_split(body, chr(10))[1]), '//') THEN c0 ELSE '' END AS c FROM tx),
ph AS (SELECT *, regexp_replace(trim(string_split(c, '. ')[1]), '\.+$', '') AS p0 FROM cm),
pp AS (SELECT *, lower(substr(p0,1,1))||substr(p0,2) AS phrase FROM ph),
pools AS (SELECT 0 AS pool, 'какая процедура '||phrase||'?' AS text, file_id, line_start, name FROM pp WHERE len(list_filter(regexp_split_to_array(phrase, '\s+'), lambda w: w<>'')) BETWEEN 4 AND 25
 UNION ALL SELECT 1, 'где '||array_to_string(list_transform(regexp_extract_all(name, '[A-Z]+|[a-z]+|[0-9]+'), lambda x: lower(x)), ' ')||' ('||array_to_string(list_transform(regexp_extract_all(object_name, '[A-Z]+|[a-z]+|[0-9]+'), lambda x: lower(x)), ' ')||')', file_id, line_start, name FROM pp
   WHERE len(regexp_extract_all(name, '[A-Z]+|[a-z]+|[0-9]+')) >= 3
 UNION ALL SELECT 2, 'что делает '||object_name||'.'||name, file_id, line_start, name FROM pp WHERE is_export AND object_type='ОбщийМодуль')"""


def pools(t, blocks=None):
    return E.question_pools(blocks if blocks is not None else code_blocks(t), C.KEY)


@query("make_questions", "WITH " + POOL_SQL + " SELECT * FROM pools")
def _(t):
    return pools(t)


@query("round_robin_pick", "WITH " + POOL_SQL + """,
sh AS (SELECT *, md5('1|'||pool||'|'||file_id||'|'||line_start) AS h FROM pools),
on1 AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY file_id, line_start ORDER BY h) = 1),
tn AS (SELECT *, CAST(row_number() OVER (PARTITION BY pool ORDER BY h) AS INTEGER) AS turn FROM on1)
SELECT file_id, line_start, pool, text, turn FROM tn ORDER BY turn, pool LIMIT 60""")
def _(t):
    return E.round_robin_pick(pools(t), C.KEY, 60, 1)


@query("evaluate")
def _(t):
    blocks = code_blocks(t)
    picked = materialise(E.round_robin_pick(pools(t, blocks), C.KEY, 60, 1).withColumn("question_id", F.xxhash64(*C.KEY))
                         .join(blocks.select(*C.KEY, F.col("path").alias("expect_path"), F.col("name").alias("expect_name")), C.KEY).drop(*C.KEY), "picked")
    hits = C.lexical_search(code_index(t), picked.select("question_id", "text"), 8).join(blocks.select(*C.KEY, "path", "name"), C.KEY).withColumnRenamed("place", "rank")
    ranks_ = E.expected_ranks(hits, picked.select("question_id", "expect_path", "expect_name"), E.path_and_name_fit("path", "name"), picked)
    return E.metrics(ranks_)
