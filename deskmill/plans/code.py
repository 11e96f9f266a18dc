"""Code search, fusion and vector queries over module texts made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.functions import fixed as X
from deskmill.functions.paths import is_object_file, path_meta
from deskmill.functions.text import stem_pattern
from deskmill.operators import code_search as C
from deskmill.operators import fusion as U
from deskmill.operators import vectors as V
from deskmill.operators.chunking import segment_blocks, toc
from deskmill.operators.metadata import object_blocks
from deskmill.plans.registry import query
from deskmill.session import kept, materialise
from deskmill.sources.views import BLOCKS_SQL, OBJECT_FILES_SQL, modules, object_files

OBJECT_SQL = """(CASE b.doc_id%4 WHEN 0 THEN 'Документ' WHEN 1 THEN 'ОбщийМодуль' WHEN 2 THEN 'Справочник' ELSE 'Отчет' END) AS object_type,
  (CASE b.doc_id%4 WHEN 0 THEN 'D' WHEN 1 THEN 'M' WHEN 2 THEN 'C' ELSE 'R' END)||(b.doc_id%50) AS object_name,
  CASE WHEN b.doc_id%4=1 THEN 'ОбщийМодуль' ELSE 'Модуль' END AS module_kind"""
CODE_SQL = BLOCKS_SQL + ",\n" + OBJECT_FILES_SQL + f""",
code AS MATERIALIZED (SELECT b.doc_id AS file_id, b.line_start, b.line_end, b.kind, b.name, b.is_export, b.doc, b.body, m.repo, m.path AS file_path, {OBJECT_SQL}
  FROM blocks b JOIN modules m USING (doc_id)
  UNION ALL SELECT file_id, 1, 2, 'object', name, false, '', body, repo, path, object_type, object_name, 'Структура' FROM object_blocks),
fts AS MATERIALIZED (SELECT *, repo||'/'||file_path||' '||object_type||'.'||object_name||' '||module_kind AS path FROM code)"""


def code_index(t):
    """The gram index of the code blocks; it is built once and kept until a file of the table changes."""
    blocks = _kept_blocks(t)
    return C.GramIndex(blocks, **kept(t.documents, "gram-lists", lambda write: C.index_grams(blocks, write)))


def code_blocks(t):
    return _kept_blocks(t).drop("len")


def _kept_blocks(t):
    """The blocks are kept apart from the grams, which only searches need."""
    return kept(t.documents, "code-blocks", lambda write: write("blocks", C.with_length(_blocks(t))))["blocks"]


def _blocks(t):
    """Blocks of modules and of object descriptions, with owner columns."""
    # dealt by document, as a table of few row groups would be read by as few tasks
    documents = t.documents.repartition("doc_id")
    files = modules(documents).withColumnRenamed("doc_id", "file_id").withColumn("m", path_meta(F.col("path")))
    cut = segment_blocks(files, ["file_id", "repo", "path", "m"], "text")
    label = F.array_join(F.filter(F.array(F.concat("m.object_type", F.lit("."), "m.object_name"), "m.module_kind", "m.sub_name"), lambda x: x != ""), " ")
    described = object_files(documents).filter(is_object_file(F.col("path"))).withColumn("m", path_meta(F.col("path")))
    objects = object_blocks(described, ["file_id", "repo", "path", "m"], "xml", F.endswith("path", F.lit(".mdo")), F.col("m.object_type"))
    return cut.unionByName(objects).select(
        "file_id", "line_start", "line_end", "kind", "name", F.when(F.col("kind") == "object", "").otherwise(F.col("name")).alias("proc_name"), "is_export", "doc", "body", "repo",
        F.col("path").alias("file_path"), F.col("m.object_type").alias("object_type"), F.col("m.object_name").alias("object_name"),
        F.col("m.module_kind").alias("module_kind"), F.col("m.sub_name").alias("sub_name"),
        F.concat("repo", F.lit("/"), "path", F.lit(" "), label).alias("path"))


def questions(t):
    return t.benchmark.select(F.col("item_id").alias("question_id"), "text")


STRUCTURE = ["thou", "heed", "ertion"]


def searched(t, asked, depth):
    return C.lexical_search(code_index(t), asked, depth, structure=STRUCTURE)


STOPS = ",".join(f"'{w}'" for w in X.CODE_STOP_WORDS)


def terms_sql(source: str) -> str:
    return rf"""cw AS (SELECT question_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT question_id, regexp_extract_all(text, '{X.CODE_WORD}') AS ws FROM {source})),
cb AS (SELECT question_id, i, lower(w) AS base, regexp_matches(w, '_|\d|^.+\p{{Lu}}') AS exact FROM cw),
cu AS (SELECT *, row_number() OVER (PARTITION BY question_id, base ORDER BY i) AS rn FROM cb WHERE base NOT IN ({STOPS}) AND length(base) >= 3),
cterms AS MATERIALIZED (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY i) - 1 AS INTEGER) AS term_no, base, exact FROM cu WHERE rn = 1),
said AS (SELECT question_id, list(base) AS said FROM cb GROUP BY 1)"""


def tf(c: str) -> str:
    return f"""(CASE WHEN NOT contains({c}, v) THEN 0 WHEN border THEN len(list_filter(range(1, length({c})-length(v)+2), lambda i: substr({c}, i, length(v)) = v))
  ELSE (length({c})-length(replace({c}, v, '')))//length(v) END)"""


def idf(df: str) -> str:
    return f"(CASE WHEN ln((n-{df}+0.5)/({df}+0.5)) <= 0 THEN 1e-6 ELSE ln((n-{df}+0.5)/({df}+0.5)) END)"


def lists_sql(source: str = "(SELECT item_id AS question_id, text FROM benchmark)") -> str:
    return CODE_SQL + ", " + terms_sql(source) + f""",
low AS MATERIALIZED (SELECT file_id, line_start, lower(path) AS p, lower(name) AS m, lower(doc) AS d, lower(body) AS b FROM fts),
sizes AS (SELECT file_id, line_start, greatest(length(p)-2,0)+greatest(length(m)-2,0)+greatest(length(d)-2,0)+greatest(length(b)-2,0) AS len FROM low),
cstats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM sizes),
vs AS (SELECT DISTINCT base AS v, len(list_filter(range(1, length(base)), lambda k: left(base, k) = right(base, k))) > 0 AS border FROM cterms),
occ AS MATERIALIZED (SELECT v, file_id, line_start, {tf('p')} AS tp, {tf('m')} AS tm, {tf('d')} AS td, {tf('b')} AS tb FROM vs JOIN low ON contains(p, v) OR contains(m, v) OR contains(d, v) OR contains(b, v)),
fq AS (SELECT v, file_id, line_start, 0 AS head, 3.0*tp+10.0*tm+4.0*td+tb AS f FROM occ UNION ALL SELECT v, file_id, line_start, 1, 10.0*tm+4.0*td FROM occ WHERE tm+td > 0),
dfq AS (SELECT v, head, count(*) AS df FROM fq GROUP BY 1, 2),
vsc AS MATERIALIZED (SELECT v, head, file_id, line_start, {idf('df')} * f*2.2/(f+1.2*(0.25+0.75*len/avg_len)) AS score FROM fq JOIN dfq USING (v, head) JOIN sizes USING (file_id, line_start), cstats),
nt AS (SELECT question_id, count(*) AS n_terms FROM cterms GROUP BY 1),
qs AS (SELECT question_id, head, file_id, line_start, round(sum(score), 6) AS score, count(*) AS held FROM cterms JOIN vsc ON vsc.v = base GROUP BY 1, 2, 3, 4),
lists AS (SELECT question_id, head AS list_no, CAST(row_number() OVER (PARTITION BY question_id, head ORDER BY score DESC, file_id, line_start) AS INTEGER) AS list_rank, file_id, line_start, score FROM qs
  UNION ALL SELECT question_id, head+2, CAST(row_number() OVER (PARTITION BY question_id, head ORDER BY score DESC, file_id, line_start) AS INTEGER), file_id, line_start, score
  FROM qs JOIN nt USING (question_id) WHERE n_terms > 1 AND held = n_terms),
kept_lists AS MATERIALIZED (SELECT * FROM lists WHERE list_rank <= CASE list_no WHEN 0 THEN 400 WHEN 1 THEN 200 WHEN 2 THEN 100 ELSE 150 END),
united AS MATERIALIZED (SELECT question_id, file_id, line_start, list_no, list_rank, score AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY question_id, file_id, line_start ORDER BY list_no) AS rn FROM kept_lists) WHERE rn = 1)"""


def quality_sql(text: str, v: str) -> str:
    return rf"""(CASE WHEN contains(lower({text}), {v}) THEN CASE WHEN regexp_matches({text}, '(?i)(^|[^\pL])'||{v})
  OR (upper(left({v},1)) <> left({v},1) AND regexp_matches({text}, upper(left({v},1))||'(?i:'||substr({v},2)||')')) THEN 1.0 ELSE 0.4 END ELSE 0.0 END)"""


def marked_sql(text: str) -> str:
    """Lower text with a mark wherever a word may begin."""
    return rf"chr(2)||lower(regexp_replace({text}, '[^\pL]', '\0'||chr(2), 'g'))"


def quick_quality_sql(text: str, marked: str, v: str) -> str:
    """As quality_sql; variants of letters alone are first looked for behind the marks, which needs no pattern."""
    return rf"""(CASE WHEN NOT contains(lower({text}), {v}) THEN 0.0 WHEN contains({marked}, chr(2)||{v}) THEN 1.0
  WHEN upper(left({v},1)) <> left({v},1) AND contains({text}, upper(left({v},1))) AND regexp_matches({text}, upper(left({v},1))||'(?i:'||substr({v},2)||')') THEN 1.0
  WHEN regexp_matches({v}, '^\pL+$') THEN 0.4 WHEN regexp_matches({text}, '(?i)(^|[^\pL])'||{v}) THEN 1.0 ELSE 0.4 END)"""


def rerank_sql(depth: int, source: str = "(SELECT item_id AS question_id, text FROM benchmark)") -> str:
    return lists_sql(source) + f""",
nb AS (SELECT DISTINCT file_id, line_start FROM united),
mk AS MATERIALIZED (SELECT f.file_id, f.line_start, {marked_sql('name')} AS mn, {marked_sql('doc')} AS md, {marked_sql('path')} AS mp, {marked_sql('body')} AS mb
  FROM fts f JOIN nb USING (file_id, line_start)),
vq AS MATERIALIZED (SELECT o.v, f.file_id, f.line_start, {quick_quality_sql('f.name', 'mn', 'o.v')} AS qn,
  greatest(0.7*{quick_quality_sql('f.doc', 'md', 'o.v')}, 0.6*{quick_quality_sql('f.path', 'mp', 'o.v')}, 0.35*{quick_quality_sql('f.body', 'mb', 'o.v')}) AS qo
  FROM occ o JOIN mk USING (file_id, line_start) JOIN fts f USING (file_id, line_start)),
qa AS (SELECT u.question_id, u.file_id, u.line_start, any_value(u.bm25) AS bm25, sum(greatest(qn, qo)) AS coverage, count(*) FILTER (greatest(qn, qo) > 0) AS matched,
  count(*) FILTER (qn = 1.0) AS in_name FROM united u JOIN cterms t USING (question_id) JOIN vq ON vq.v = t.base AND vq.file_id = u.file_id AND vq.line_start = u.line_start GROUP BY 1, 2, 3),
wn AS (SELECT question_id, bool_or(base IN ('thou','heed','ertion')) AS wants FROM cterms GROUP BY 1),
idn AS (SELECT question_id, list(base) AS ids FROM cterms WHERE exact GROUP BY 1),
rs AS (SELECT qa.question_id, qa.file_id, qa.line_start, matched, round(bm25 * (0.25+coverage/n_terms)**2 * (0.5+matched/n_terms) * (1+in_name/n_terms)**2
  * CASE WHEN coalesce(list_contains(ids, CASE WHEN f.kind='object' THEN '' ELSE lower(f.name) END), false) THEN 4 ELSE 1 END
  * CASE WHEN list_contains(said, lower(f.object_name)) THEN 2.5 ELSE 1 END * CASE WHEN f.kind='object' THEN CASE WHEN wants THEN 2.5 ELSE 0.6 END WHEN f.is_export THEN 1.3 ELSE 1 END, 5) AS score
  FROM qa JOIN fts f USING (file_id, line_start) JOIN said USING (question_id) JOIN nt USING (question_id) JOIN wn USING (question_id) LEFT JOIN idn ON idn.question_id = qa.question_id),
reranked AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_id, line_start) AS INTEGER) AS place FROM rs) WHERE place <= {depth})"""


@query("parse_query", "WITH " + terms_sql("(SELECT item_id AS question_id, text FROM benchmark)") + " SELECT question_id, term_no, base, exact, base AS variants FROM cterms")
def _(t):
    return C.parse_query(questions(t)).withColumn("variants", F.array_join("variants", "|"))


@query("structure_intent", "WITH " + terms_sql("(SELECT item_id AS question_id, text FROM benchmark)") + """
SELECT question_id, bool_or(base IN ('thou','heed','ertion')) AS wants_structure FROM cterms GROUP BY 1""")
def _(t):
    return C.structure_intent(C.parse_query(questions(t)), STRUCTURE)


@query("trigram_index", """
WITH g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text)-1), lambda i: substr(lower(text), i, 3))) AS gram FROM documents WHERE length(text) >= 3)
SELECT gram, count(*) AS df FROM g GROUP BY 1""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("file_id"), F.lit(1).alias("line_start"), F.col("text").alias("body"),
                              *[F.lit(None).cast("string").alias(c) for c in ("path", "name", "doc")])
    return C.trigram_index(rows).groupBy("gram").agg(F.count("*").alias("df"))


@query("substring_candidates", "WITH " + lists_sql() + " SELECT question_id, list_no, list_rank, file_id, line_start, score FROM kept_lists")
def _(t):
    return _lists(t)


def _lists(t):
    index, terms = code_index(t), C.parse_query(questions(t))
    hits = materialise(C.variant_hits(index, terms.select(F.explode("variants").alias("variant")).distinct()), "hits")
    return C.candidate_lists(terms, hits, index.stats)


@query("candidate_union", "WITH " + lists_sql() + " SELECT question_id, file_id, line_start, list_no, list_rank, bm25 FROM united")
def _(t):
    return C.candidate_union(_lists(t))


@query("match_quality", "SELECT doc_id, " + ", ".join(quality_sql("text", f"'{v}'") + f" AS q_{v}" for v in ("ere", "tion", "anon")) + " FROM documents")
def _(t):
    return t.documents.select("doc_id", *[C.match_quality(F.col("text"), F.array(F.lit(v))).alias(f"q_{v}") for v in ("ere", "tion", "anon")])


@query("rerank", "WITH " + rerank_sql(50) + " SELECT question_id, place, file_id, line_start, matched, score FROM reranked")
def _(t):
    return searched(t, questions(t), U.DEPTH).select("question_id", "place", "file_id", "line_start", "matched", "score")


SNIP_SQL = rerank_sql(8) + r""",
hl AS (SELECT r.question_id, r.place, f.kind, f.line_start, string_split(f.body, chr(10)) AS ls FROM reranked r JOIN fts f USING (file_id, line_start)),
tl AS (SELECT question_id, list(base) AS vs FROM cterms GROUP BY 1),
x AS (SELECT hl.*, list_filter(range(1, len(ls)+1), lambda i: regexp_matches(ls[i], '(?i)^[ \t]*(Procedure|Function)[ \t]+[A-Za-z_]\w*[ \t]*\('))[1:1] AS h,
  list_filter(range(1, len(ls)+1), lambda i: len(list_filter(vs, lambda v: contains(lower(ls[i]), v))) > 0) AS mt FROM hl JOIN tl USING (question_id)),
y AS (SELECT *, list_concat(h, list_filter(mt, lambda i: NOT list_contains(h, i)))[1:6] AS picked FROM x),
z AS (SELECT *, list_sort(list_distinct(CASE WHEN len(picked) < 2 THEN list_concat(picked, range(1, least(len(ls), 3)+1)) ELSE picked END)) AS chosen FROM y)
SELECT question_id, place, array_to_string(CASE WHEN kind='object' THEN list_transform(ls[1:6], lambda x: substr(x,1,480)) ELSE list_transform(chosen, lambda i: (line_start+i-1)||': '||substr(regexp_replace(ls[i], '^\s+|\s+$', '', 'g'),1,160)) END, chr(10)) AS lines FROM z"""


@query("snippet_lines", "WITH " + SNIP_SQL)
def _(t):
    blocks = code_blocks(t)
    terms = C.parse_query(questions(t))
    hits = searched(t, questions(t), 8).join(blocks.select(*C.KEY, "kind", "body"), C.KEY)
    return C.snippet_lines(hits, terms).select("question_id", "place", F.array_join("lines", "\n").alias("lines"))


@query("char_budget", "WITH " + rerank_sql(20) + """,
h AS (SELECT r.question_id, r.place, f.body, sum(length(f.body)+1) OVER (PARTITION BY question_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used
  FROM reranked r JOIN fts f USING (file_id, line_start)),
o AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS found, max(CASE WHEN coalesce(used,0)+length(body) > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS over FROM h)
SELECT question_id, place, found, count(*) OVER (PARTITION BY question_id) AS shown FROM o WHERE over = 0""")
def _(t):
    blocks = code_blocks(t)
    hits = searched(t, questions(t), 20).join(blocks.select(*C.KEY, "body"), C.KEY)
    return C.char_budget(hits, "question_id", "place", "body", 4000).select("question_id", "place", "found", "shown")


def formulations(t):
    """Each benchmark item asked in up to three ways: whole text, first sentence, last sentence."""
    s = F.split("text", r"\. ")
    texts = U.distinct_formulations(F.array(F.col("text"), F.element_at(s, 1), F.element_at(s, -1)))
    each = t.benchmark.select(F.col("item_id").alias("item_id"), F.posexplode(texts).alias("formulation", "text"))
    return each.withColumn("question_id", F.col("item_id") * 10 + F.col("formulation"))


FORM_SQL = r"""(SELECT item_id*10 + i - 1 AS question_id, text FROM (SELECT item_id, generate_subscripts(fs, 1) AS i, unnest(fs) AS text FROM (
  SELECT item_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS fs FROM (SELECT item_id, list_transform([text, string_split(text, '. ')[1], string_split(text, '. ')[-1]], lambda x: trim(x)) AS a FROM benchmark))))"""


@query("distinct_queries", r"""
WITH s AS (SELECT item_id, list_transform(regexp_split_to_array(text||'. '||text, '\.?\s+'), lambda x: trim(x)) AS a FROM benchmark)
SELECT item_id, array_to_string(list_filter(a, lambda x, i: x <> '' AND list_position(a, x) = i)[1:8], '|') AS texts FROM s""")
def _(t):
    texts = F.split(F.concat("text", F.lit(". "), "text"), r"\.?\s+")
    return t.benchmark.select("item_id", F.array_join(U.distinct_formulations(texts), "|").alias("texts"))


@query("distinct_terms", r"""
WITH s AS (SELECT item_id, regexp_extract_all(lower(string_split(text, '. ')[1]), '[a-z]+') AS a, regexp_extract_all(lower(text), '[a-z]+') AS b FROM benchmark),
d AS (SELECT item_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a, list_filter(b, lambda x, i: list_position(b, x) = i) AS b FROM s)
SELECT item_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ' ') AS terms FROM d""")
def _(t):
    first = F.array_distinct(F.regexp_extract_all(F.lower(F.element_at(F.split("text", r"\. "), 1)), F.lit("([a-z]+)"), F.lit(1)))
    whole = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    return t.benchmark.select("item_id", F.array_join(U.formulation_terms(first, whole), " ").alias("terms"))


def passages(blocks):
    return blocks.select(*C.KEY, V.passage_text(F.col("kind"), F.col("object_type"), F.col("object_name"), F.col("module_kind"), F.col("sub_name"),
                                                F.col("name"), F.col("doc"), F.col("body")).alias("passage"))


CAMEL = "[А-ЯЁA-Z]+|[а-яёa-z]+|[0-9]+"


def spoken_sql(c: str) -> str:
    # names of the test modules are a capital, digits, x and digits, so no look-ahead is needed
    return f"array_to_string(list_transform(regexp_extract_all({c}, '{CAMEL}'), lambda x: lower(x)), ' ')"


PASSAGE_SQL = CODE_SQL + rf""",
ps AS (SELECT *, trim(object_type||' '||{spoken_sql('object_name')}) AS owner, array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(x, '^\s*//')), chr(10)) AS src FROM fts),
passages AS (SELECT file_id, line_start, CASE WHEN kind='object' THEN substr(owner||'. '||body,1,1200) WHEN kind='module' THEN owner||'. '||module_kind||'. '||substr(body,1,600)
  ELSE owner||'. '||module_kind||'. '||CASE WHEN kind='func' THEN 'функция' ELSE 'процедура' END||' '||{spoken_sql('name')}||'. '||substr(doc,1,700)||CASE WHEN length(doc) < 80 THEN ' '||substr(src,1,400) ELSE '' END END AS passage FROM ps)"""


@query("passage_text", "WITH " + PASSAGE_SQL + " SELECT file_id, line_start, passage FROM passages")
def _(t):
    return passages(code_blocks(t))


def letters_sql(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_c AS (SELECT {key}, unicode(unnest(string_split(lower({text}), ''))) % 64 AS place FROM {source}),
{name}_n AS (SELECT {key}, place, count(*)::DOUBLE AS x FROM {name}_c GROUP BY ALL),
{name}_g AS (SELECT {key}, list({{'p': place, 'x': x}}) AS ps, sqrt(sum(x*x)) AS norm FROM {name}_n GROUP BY {key}),
{name} AS MATERIALIZED (SELECT {key}, list_transform(range(0, 64), lambda i: CAST(coalesce(list_filter(ps, lambda q: q.p = i)[1].x, 0) / norm AS FLOAT)) AS embedding FROM {name}_g)"""


@query("embed_missing", "WITH " + letters_sql("vec", "(SELECT doc_id, text FROM documents)", "doc_id", "text") + """
SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN 'kept' ELSE 'embedded' END AS state,
  round(CASE WHEN e.vec_id IS NOT NULL THEN list_sum(e.embedding::DOUBLE[]) ELSE list_sum(v.embedding::DOUBLE[]) END, 4) AS total
FROM documents d JOIN vec v USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def _(t):
    known = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    out = V.embed_missing(t.documents.select("doc_id", "text"), known, "doc_id", "text", V.letter_embedder, t.spark.sparkContext.defaultParallelism)
    return out.select("doc_id", "state", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    return V.missing_vectors(t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("orphan_vectors", "SELECT vec_id AS doc_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang='en')")
def _(t):
    return V.orphan_vectors(t.embeddings.select(F.col("vec_id").alias("doc_id")), t.documents.filter("lang = 'en'"), "doc_id").select("doc_id")


@query("length_sorted_batches")
def _(t):
    rows = V.length_sorted(t.documents.select("doc_id", "text"), "text", 16)
    return (rows.select(F.spark_partition_id().alias("batch_part"), F.length("text").alias("n")).groupBy("batch_part")
            .agg(F.count("*").alias("texts"), F.min("n").alias("shortest"), F.max("n").alias("longest")))


CENTROID_SQL = """cm AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
cn AS (SELECT label, sqrt(sum(m*m)) AS norm FROM cm GROUP BY 1)"""


@query("centroids", "WITH " + CENTROID_SQL + " SELECT label, pos - 1 AS pos, round(m/norm, 6) AS x FROM cm JOIN cn USING (label)")
def _(t):
    return V.centroids(t.embeddings, "label").select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("knn", "WITH " + CENTROID_SQL + """, c AS (SELECT label, list(m/norm ORDER BY pos) AS v FROM cm JOIN cn USING (label) GROUP BY 1),
d AS (SELECT c.label AS question_id, vec_id, round(list_distance(c.v, embedding::DOUBLE[]), 6) AS distance FROM c, embeddings)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS INTEGER) AS place FROM d) WHERE place <= 20""")
def _(t):
    asked = V.centroids(t.embeddings, "label").select(F.col("label").alias("question_id"), F.col("centroid").alias("embedding"))
    return V.knn(t.embeddings, asked, ["vec_id"], 20)


FUSE_SQL = "WITH " + rerank_sql(50, FORM_SQL) + PASSAGE_SQL.replace(CODE_SQL, "") + ", " + letters_sql("bv", "passages", "file_id, line_start", "passage") + ", " + letters_sql("qv", FORM_SQL, "question_id", "text") + """,
sd AS (SELECT q.question_id, b.file_id, b.line_start, round(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM qv q, bv b),
sl AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, file_id, line_start) AS place FROM sd),
al2 AS (SELECT question_id//10 AS q, question_id%10 AS f, false AS semantic, place, file_id, line_start FROM reranked
  UNION ALL SELECT question_id//10, question_id%10, true, place, file_id, line_start FROM sl WHERE place <= 50),
fu AS (SELECT q AS question_id, file_id, line_start, round(sum((CASE WHEN f=0 THEN 1.0 ELSE 0.7 END)*(CASE WHEN semantic THEN 0.6 ELSE 1.0 END)/(60+place)), 9) AS score,
  min((f, semantic, place)) AS seen FROM al2 GROUP BY 1, 2, 3),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen, file_id, line_start) AS INTEGER) AS rank FROM fu)
SELECT question_id, rank, file_id, line_start, score FROM fr WHERE rank <= """


def fused(t, limit: int, semantic: bool = True):
    blocks, asked = code_blocks(t), materialise(formulations(t), "formulations")
    split = {"question_id": (F.col("question_id") / 10).cast("long"), "formulation": (F.col("question_id") % 10).cast("int")}
    lexical = searched(t, asked, U.DEPTH).withColumns({"formulation": split["formulation"]}).withColumns({"question_id": split["question_id"]})
    near = None
    if semantic:
        vectors = V.embed(passages(blocks), C.KEY, "passage", V.letter_embedder)
        near = V.knn(vectors, V.embed(asked, ["question_id"], "text", V.letter_embedder), C.KEY, U.DEPTH)
        near = near.withColumns({"formulation": split["formulation"]}).withColumns({"question_id": split["question_id"]})
    lists, note = U.hybrid_lists(lexical, near, C.KEY)
    return U.rrf_fuse(lists, C.KEY, limit), note


@query("rrf_fuse", FUSE_SQL + "50")
def _(t):
    return fused(t, 50)[0].select("question_id", "rank", "file_id", "line_start", "score")


@query("fused_topk", FUSE_SQL + "8")
def _(t):
    return fused(t, 8)[0].select("question_id", "rank", "file_id", "line_start", "score")


SEMANTIC_SQL = """
  UNION ALL SELECT question_id//10, question_id%10, true, place, file_id, line_start FROM sl WHERE place <= 50"""


@query("degrade_without_vectors", FUSE_SQL.replace(SEMANTIC_SQL, "").replace(
    "SELECT question_id, rank, file_id, line_start, score FROM fr", "SELECT question_id, rank, file_id, line_start, score, 'semantic search is not available: there are no vectors' AS note FROM fr") + "8")
def _(t):
    hits, note = fused(t, 8, semantic=False)
    return hits.select("question_id", "rank", "file_id", "line_start", "score", F.lit(note).alias("note"))


@query("index_stats", "WITH " + CODE_SQL + """ SELECT count(DISTINCT file_id) AS files, count(*) AS chunks, count(*) FILTER (kind IN ('proc','func')) AS procedures,
  count(*) FILTER (kind='object') AS objects, (SELECT count(*) FROM embeddings) AS vectors FROM code""")
def _(t):
    vectors = t.embeddings.agg(F.count("*"))
    per_file = code_blocks(t).groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin("proc", "func")).alias("p"), F.count_if(F.col("kind") == "object").alias("o"))
    return per_file.agg(F.count("*").alias("files"), F.sum("n").alias("chunks"), F.sum("p").alias("procedures"), F.sum("o").alias("objects")).withColumn("vectors", vectors.scalar())


REQUEST = """CASE doc_id % 9 WHEN 0 THEN repo||'/'||path||':3-9' WHEN 1 THEN path WHEN 2 THEN 't/ObjectModule'||doc_id||'.bsl'
  WHEN 3 THEN 'Отчет.R'||(doc_id%50) WHEN 4 THEN 'm'||(doc_id%50) WHEN 5 THEN 'reports.r'||(doc_id%50) WHEN 6 THEN '«Отчеты.R'||(doc_id%50)||'.Form»'
  WHEN 7 THEN lower('T/OBJECTMODULE')||doc_id||'.bsl:7' ELSE 'CommonModule.M'||(doc_id%50) END"""

# how types may be written, as rows (word, type)
TYPE_SQL = "(VALUES " + ", ".join(f"('{w}', '{t}')" for w, t in {**X.PLURAL_TYPES, **{
    w.lower(): shown for *others, shown in X.OBJECT_KINDS for w in (*others, shown)}}.items()) + ") AS ty(word, type)"


def object_request_sql(source: str, column: str) -> str:
    """Rows of ``source`` with bare (the name asked for) and type."""
    clean = f"regexp_replace(trim({column}), '^[«»\"''`]+|[«»\"''`]+$', '', 'g')"
    return (f"SELECT s.*, ty.type, CASE WHEN ty.type IS NULL THEN clean ELSE split_part(clean, '.', 2) END AS bare FROM (SELECT *, {clean} AS clean FROM {source}) s "
            f"LEFT JOIN {TYPE_SQL} ON contains(clean, '.') AND ty.word = lower(split_part(clean, '.', 1))")


@query("resolve_module", "WITH " + BLOCKS_SQL.split(",\nml AS")[0] + f""",
fo AS (SELECT b.*, {OBJECT_SQL} FROM modules b), rq AS (SELECT DISTINCT {REQUEST} AS request FROM modules),
w0 AS (SELECT request, regexp_replace(request, ':[0-9]+(-[0-9]+)?$', '') AS wanted FROM rq), w AS ({object_request_sql("w0", "wanted")}),
al AS (SELECT request, 1 AS level, repo, path FROM w JOIN fo ON wanted = repo||'/'||path UNION ALL SELECT request, 2, repo, path FROM w JOIN fo ON wanted = path
 UNION ALL SELECT request, 3, repo, path FROM w JOIN fo ON contains(wanted, '/') AND ends_with(lower(path), lower(wanted))
 UNION ALL SELECT request, 4, repo, path FROM w JOIN fo ON (w.type IS NULL OR object_type = w.type) AND lower(object_name) = lower(bare)),
bs AS (SELECT request, min(level) AS level FROM al GROUP BY 1),
nr AS (SELECT al.*, row_number() OVER (PARTITION BY request ORDER BY path, repo) AS rn FROM al JOIN bs USING (request, level)),
ln AS (SELECT *, TRY_CAST(regexp_extract(request, ':([0-9]+)(-[0-9]+)?$', 1) AS INTEGER) AS line_from,
  TRY_CAST(regexp_extract(request, '-([0-9]+)$', 1) AS INTEGER) AS upto FROM nr)
SELECT request, level, repo, path, line_from, CASE WHEN line_from IS NOT NULL THEN coalesce(upto, line_from) END AS line_to
FROM ln WHERE rn <= CASE level WHEN 3 THEN 20 WHEN 4 THEN 40 ELSE 1000000 END""")
def _(t):
    # dealt by document, as a table of few row groups would be read by as few tasks
    documents = t.documents.repartition("doc_id")
    files = modules(documents).withColumn("m", path_meta(F.col("path"))).select("repo", "path", "doc_id", "m.object_type", "m.object_name")
    return C.resolve_module(files, files.select(F.expr(REQUEST).alias("request")))


OBJECT_REQUEST = """CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name,' ',2)||' '||left(split_part(p_name,' ',1),3) WHEN 2 THEN upper(p_name)||'x'
  WHEN 3 THEN 'Documents.'||p_name WHEN 4 THEN '«документ.'||p_name||'»' WHEN 5 THEN 'расходную накладную '||(p_partkey % 30) ELSE 'Справочники.'||split_part(p_name,' ',2) END"""
OBJECT_PARTS = "CASE WHEN p_partkey % 2 = 0 THEN 'Документ' ELSE 'Справочник' END", "CASE WHEN p_size % 5 = 0 THEN 'Расходная накладная '||(p_partkey % 30) ELSE '' END"
RU_PATTERN, RU_GROUPS = stem_pattern(X.RU_ENDINGS, None)
RU_STEM = f"regexp_replace(w, '{RU_PATTERN}', '" + "".join(f"\\{i + 1}" for i in range(RU_GROUPS)) + "')"


@query("find_object", f"""
WITH ob AS (SELECT *, {OBJECT_PARTS[0]} AS object_type, lower(p_name||' '||{OBJECT_PARTS[1]}) AS whole FROM part),
r0 AS (SELECT DISTINCT {OBJECT_REQUEST} AS request FROM part), rq AS ({object_request_sql("r0", "request")}),
sw AS (SELECT *, list_transform(list_filter(regexp_extract_all(lower(bare), '{X.CODE_WORD}'), lambda w: length(w) >= 3), lambda w: {RU_STEM}) AS stems FROM rq),
al AS (SELECT request, 1 AS level, p_partkey AS object_id, p_name AS object_name FROM sw JOIN ob ON lower(bare) = lower(p_name) AND (type IS NULL OR type = object_type)
 UNION ALL SELECT request, 2, p_partkey, p_name FROM sw JOIN ob ON len(stems) > 0 AND len(list_filter(stems, lambda w: NOT contains(whole, w))) = 0 AND (type IS NULL OR type = object_type)),
bs AS (SELECT request, min(level) AS level FROM al GROUP BY 1),
nr AS (SELECT al.*, CAST(row_number() OVER (PARTITION BY request ORDER BY length(object_name), object_id) AS INTEGER) AS rank FROM al JOIN bs USING (request, level))
SELECT request, level, object_id, object_name, rank FROM nr WHERE rank <= 5""")
def _(t):
    objects = t.part.select(F.col("p_partkey").alias("object_id"), F.col("p_name").alias("object_name"),
                            F.expr(OBJECT_PARTS[0]).alias("object_type"), F.expr(OBJECT_PARTS[1]).alias("synonym"))
    return C.find_object(objects, t.part.select(F.expr(OBJECT_REQUEST).alias("request")))


@query("object_modules", "WITH " + CODE_SQL + """,
ow AS (SELECT DISTINCT object_name, object_name||'/'||repo AS owner_id, CASE WHEN length(object_name)=2 THEN object_type END AS object_type, CASE WHEN repo<>'src1' THEN repo END AS repo FROM code WHERE kind <> 'object'),
md AS (SELECT object_name, object_type, repo, file_path AS path, count(*) FILTER (kind IN ('proc','func')) AS procedures FROM code WHERE kind <> 'object' GROUP BY 1, 2, 3, 4)
SELECT ow.owner_id, md.repo, md.path, md.procedures FROM ow JOIN md ON ow.object_name=md.object_name AND (ow.object_type IS NULL OR ow.object_type=md.object_type)
 AND (ow.repo IS NULL OR ow.repo=md.repo)""")
def _(t):
    # names and kinds alone are taken: no text is written, no gram index built, descriptions are not read
    blocks = materialise(_blocks(t).filter("kind <> 'object'").select("object_name", "object_type", "repo", F.col("file_path").alias("path"), "kind"), "module-names")
    owners = blocks.select("object_name", F.concat("object_name", F.lit("/"), "repo").alias("owner_id"),
                           F.when(F.length("object_name") == 2, F.col("object_type")).alias("object_type"), F.when(F.col("repo") != "src1", F.col("repo")).alias("repo")).distinct()
    return C.object_modules(owners, blocks)


@query("near_names", "WITH " + BLOCKS_SQL + """,
nm AS (SELECT doc_id, line_start||'-'||line_end||': '||CASE WHEN kind='func' THEN 'Функция' ELSE 'Процедура' END||' '||name||CASE WHEN is_export THEN ' Экспорт' ELSE '' END AS name,
  line_start FROM blocks WHERE kind <> 'module'),
rq AS (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 'X1' WHEN 1 THEN 'nothing' WHEN 2 THEN 'функция F' ELSE '8' END AS request FROM documents),
jn AS (SELECT doc_id AS request_id, name, line_start, contains(lower(name), lower(request)) AS near FROM rq JOIN nm USING (doc_id)),
kp AS (SELECT *, bool_or(near) OVER (PARTITION BY request_id) AS has FROM jn)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY line_start) AS INTEGER) AS rank, name FROM kp WHERE near OR NOT has""")
def _(t):
    blocks = segment_blocks(modules(t.documents), ["doc_id"], "text")
    names = toc(blocks, ["doc_id"]).select("doc_id", F.col("entry").alias("name"), F.col("line_start").alias("name_order"))
    asked = t.documents.select("doc_id", F.col("doc_id").alias("request_id"),
                               F.expr("CASE doc_id % 4 WHEN 0 THEN 'X1' WHEN 1 THEN 'nothing' WHEN 2 THEN 'функция F' ELSE '8' END").alias("request"))
    return C.near_names(names, asked, "doc_id")
