"""Files, chunks, blocks and manifests over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.functions import paths as P
from deskmill.functions import text as T
from deskmill.operators import chunking as C
from deskmill.operators import corpus as K
from deskmill.plans.registry import query
from deskmill.session import workspace
from deskmill.sources import files as S
from deskmill.sources.views import BLOCKS_SQL, FILES_SQL, files, modules

RULES = [("*7.txt", "drafts"), ("src1/*", "archive"), ("SRC?/1[0-3]*", "old")]
COPY_WORDS = ("копия", "copy")
PRODUCTS = [("first", ["the", "and", "der"]), ("second", ["que", "le ", "los"])]
REASON = r"""CASE WHEN regexp_matches(lower(regexp_extract(path,'[^/]*$')), '7\.txt$') THEN 'drafts'
  WHEN regexp_matches(lower(path), '^src1/') THEN 'archive' WHEN regexp_matches(lower(path), '^src./1[0-3]') THEN 'old' END"""

WRAP = """list_reduce({l}, lambda acc, w: CASE WHEN length(string_split(acc, chr(30))[-1]) + 1 + length(w) > 1200
  THEN acc||chr(30)||w ELSE acc||{sep}||w END)"""
CHUNK_LIST = """string_split({pack}, chr(30))"""
CHUNKS_SQL = r"""paras AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p<>'') AS ps FROM {src}),
pieces AS (SELECT *, flatten(list_transform(ps, lambda p: CASE WHEN length(p) > 2000 THEN string_split(list_reduce(regexp_split_to_array(p, '\s+'),
   lambda acc, w: CASE WHEN length(string_split(acc, chr(30))[-1]) + 1 + length(w) > 1200 THEN acc||chr(30)||w ELSE acc||' '||w END), chr(30)) ELSE [p] END)) AS pc FROM paras),
packed AS (SELECT *, string_split(list_reduce(pc, lambda acc, w: CASE WHEN length(string_split(acc, chr(30))[-1]) + 1 + length(w) > 1200
   THEN acc||chr(30)||w ELSE acc||chr(10)||w END), chr(30)) AS cs FROM pieces WHERE len(pc) > 0),
chunks AS (SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chunk_no, unnest(cs) AS text FROM packed)"""

KB_SQL = FILES_SQL + r""",
named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, """ + REASON + r""" AS reason, NOT ends_with(path, '.png') AS supported, sha256(text) AS digest FROM files),
usable AS (SELECT * FROM named WHERE reason IS NULL AND supported),
kept AS (SELECT *, first_value(path) OVER (PARTITION BY digest ORDER BY (contains(lower(name),'копия') OR contains(lower(name),'copy')), length(name), name, path) AS canonical FROM usable),
docs AS (SELECT *, regexp_replace(regexp_replace(name, '\.[^.]+$', ''), ' - copy$', '') AS bare FROM kept WHERE path = canonical),
documents_kb AS (SELECT *, bare AS title0, CASE WHEN regexp_replace(bare, '^[\s!+.\d]+', '') = '' THEN bare ELSE regexp_replace(bare, '^[\s!+.\d]+', '') END AS title FROM docs WHERE regexp_matches(text, '\S'))"""


def knowledge_of(documents):
    return K.knowledge_base(files(documents), RULES, COPY_WORDS, PRODUCTS)


def knowledge(t):
    return knowledge_of(t.documents)


@query("exclude_rules", "WITH " + KB_SQL + " SELECT doc_id, path, reason FROM named WHERE reason IS NOT NULL")
def _(t):
    return files(t.documents).select("doc_id", "path", P.exclude_reason(F.col("path"), RULES).alias("reason")).filter("reason is not null")


@query("split_supported", "WITH " + KB_SQL + " SELECT doc_id, path, supported FROM named")
def _(t):
    return files(t.documents).select("doc_id", "path", T.suffix(F.col("path")).isin(K.SUPPORTED).alias("supported"))


@query("canonical_copy", "WITH " + KB_SQL + " SELECT doc_id, path, canonical, path<>canonical AS duplicate FROM kept")
def _(t):
    return knowledge(t)["copies"].select("doc_id", "path", "canonical", (F.col("path") != F.col("canonical")).alias("duplicate"))


TITLE = r"regexp_replace(regexp_replace(regexp_extract({p}, '[^/]*$'), '\.[^.]+$', ''), ' - copy$', '')"


@query("alias_titles", "WITH " + KB_SQL + ", a AS (SELECT DISTINCT canonical, " + TITLE.format(p="path") + " AS alias, " + TITLE.format(p="canonical") + """ AS own
  FROM kept WHERE path<>canonical) SELECT canonical, alias FROM a WHERE alias<>own""")
def _(t):
    return knowledge(t)["aliases"]


@query("kb_chunks", "WITH " + CHUNKS_SQL.format(src="documents") + " SELECT doc_id, chunk_no, text FROM chunks")
def _(t):
    return C.kb_chunks(t.documents, ["doc_id"])


@query("read_slice", "WITH " + CHUNKS_SQL.format(src="documents") + """ SELECT doc_id, chunk_no, text FROM chunks
WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE length(text) = (SELECT max(length(text)) FROM documents)) AND chunk_no BETWEEN 2 AND 11""")
def _(t):
    longest = t.documents.orderBy(F.length("text").desc(), "doc_id").select("doc_id").first()[0]
    return K.read_slice(C.kb_chunks(t.documents, ["doc_id"]), longest, start=2, count=50)


COUNT = "(length(h)-length(replace(h,'{k}','')))//length('{k}')"
SCORE = {name: "(" + " + ".join(COUNT.format(k=k) for k in keys) + ")" for name, keys in PRODUCTS}
PRODUCT_SQL = ("SELECT *, CASE WHEN greatest({a},{b}) = 0 THEN 'Общее' WHEN {a} >= {b} THEN 'first' ELSE 'second' END AS product FROM ("
               "SELECT *, replace(lower(title||' '||substr(text,1,3000)), 'ё', 'е') AS h FROM documents_kb)").format(a=SCORE["first"], b=SCORE["second"])


@query("list_documents", "WITH " + KB_SQL + ", " + CHUNKS_SQL.format(src="documents_kb") + ", p AS (" + PRODUCT_SQL + """),
n AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1)
SELECT p.path, p.title, p.product, n.n_chunks FROM p JOIN n USING (doc_id) WHERE p.product = 'first' ORDER BY 3, 2, 1""")
def _(t):
    kb = knowledge(t)
    return K.list_documents(kb["documents"], kb["chunks"], "first")


@query("classify_product", "WITH " + KB_SQL + ", p AS (" + PRODUCT_SQL + ") SELECT doc_id, product FROM p")
def _(t):
    return knowledge(t)["documents"].select("doc_id", "product")


@query("kb_products", "WITH " + KB_SQL + ", p AS (" + PRODUCT_SQL + ") SELECT product, count(*) AS n FROM p GROUP BY 1")
def _(t):
    return knowledge(t)["documents"].groupBy("product").agg(F.count("*").alias("n"))


@query("build_report", "WITH " + KB_SQL + ", " + CHUNKS_SQL.format(src="documents_kb") + r""",
o AS (SELECT n.doc_id, n.path, CASE WHEN n.reason IS NOT NULL THEN 'excluded' WHEN NOT n.supported THEN 'unsupported' WHEN n.path<>k.canonical THEN 'duplicate'
  WHEN trim(n.text)='' THEN 'empty' ELSE 'indexed' END AS outcome FROM named n LEFT JOIN kept k USING (path)),
c AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY path) AS rn FROM o LEFT JOIN c USING (doc_id))
SELECT outcome, count(*) AS n, CAST(coalesce(sum(n_chunks), 0) AS BIGINT) AS chunks, string_agg(path, ' | ' ORDER BY path) FILTER (rn <= 20) AS examples FROM r GROUP BY 1""")
def _(t):
    return K.build_report(K.file_outcomes(knowledge(t)))


@query("folder_signature", "WITH " + FILES_SQL + """, d AS (SELECT sha1(path||'|'||n_chars||'|'||(doc_id%97)) AS d FROM files)
SELECT sha1('*7.txt|src1/*|'||count(*)||'|'||""" + "||'|'||".join(f"sum(('0x'||substr(d,{1 + 5 * i},5))::BIGINT)" for i in range(8)) + ") AS signature FROM d")
def _(t):
    rows = files(t.documents).select("path", F.col("n_chars").alias("size"), (F.col("doc_id") % 97).alias("mtime"))
    return K.folder_signature(rows, ["*7.txt", "src1/*"])


def snapshots(t):
    """Two states of the documents folder: files added, changed, removed, and one source not scanned the second time."""
    rows = t.documents.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "doc_id", "n_chars", "text")
    before = rows.filter("doc_id % 10 <> 3").select("repo", "path", "doc_id", F.lit(1).cast("long").alias("mtime"), F.col("n_chars").alias("size"), "text")
    grown = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))
    now = (rows.filter("doc_id % 9 <> 4 AND repo <> 'src2'").withColumn("text", grown)
           .select("repo", "path", "doc_id", F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).cast("long").alias("mtime"), F.length("text").cast("long").alias("size"), "text"))
    return before, now


SNAPSHOT_SQL = """old AS (SELECT source AS repo, doc_id::VARCHAR AS path, doc_id FROM documents WHERE doc_id%10<>3),
fresh AS (SELECT source AS repo, doc_id::VARCHAR AS path, doc_id FROM documents WHERE doc_id%9<>4 AND source<>'src2')"""


@query("manifest_diff", "WITH " + SNAPSHOT_SQL + """
SELECT coalesce(o.repo, f.repo) AS repo, coalesce(o.path, f.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'removed'
  WHEN f.doc_id%7=0 THEN 'changed' ELSE 'unchanged' END AS state
FROM (SELECT * FROM old WHERE repo<>'src2') o FULL JOIN fresh f ON o.repo=f.repo AND o.path=f.path""")
def _(t):
    before, now = snapshots(t)
    return K.manifest_diff(before, now)


@query("stale_sources", "WITH " + SNAPSHOT_SQL + " SELECT repo, path FROM old WHERE repo='src2'")
def _(t):
    before, now = snapshots(t)
    return K.stale_sources(before, now).select("repo", "path")


@query("index_health", "WITH " + KB_SQL + """ SELECT 'all' AS name, count(*) AS documents, count(*) > 0 AS ok, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS state FROM documents_kb
UNION ALL SELECT 'other language', count(*), count(*) > 0, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM documents_kb WHERE lang = 'none'
UNION ALL SELECT 'not built', NULL, false, 'unreadable' UNION ALL SELECT 'damaged', NULL, false, 'unreadable'""")
def _(t):
    damaged, docs = workspace(t.spark, "damaged"), knowledge(t)["documents"]
    t.documents.select("text").write.text(damaged)
    return K.index_health(t.spark, {
        "all": lambda: docs, "other language": lambda: docs.filter("lang = 'none'"), "not built": lambda: t.spark.read.parquet(damaged + "-none"),
        "damaged": lambda: t.spark.read.schema("text string").option("pathGlobFilter", "*.txt").parquet(damaged)})


@query("segment_blocks", "WITH " + BLOCKS_SQL + " SELECT doc_id, kind, line_start, line_end, body FROM blocks")
def _(t):
    return C.segment_blocks(modules(t.documents), ["doc_id"], "text").select("doc_id", "kind", "line_start", "line_end", "body")


@query("block_header", "WITH " + BLOCKS_SQL + " SELECT doc_id, line_start, kind, name, is_export, doc FROM blocks WHERE kind<>'module'")
def _(t):
    return C.segment_blocks(modules(t.documents), ["doc_id"], "text").filter("kind <> 'module'").select(
        "doc_id", "line_start", "kind", "name", "is_export", "doc")


@query("toc", "WITH " + BLOCKS_SQL + """ SELECT doc_id, line_start, line_start||'-'||line_end||': '||CASE WHEN kind='func' THEN 'Функция' ELSE 'Процедура' END
  ||' '||name||CASE WHEN is_export THEN ' Экспорт' ELSE '' END AS entry FROM blocks WHERE kind<>'module'""")
def _(t):
    return C.toc(C.segment_blocks(modules(t.documents), ["doc_id"], "text"), ["doc_id"])


@query("hit_link", "WITH " + BLOCKS_SQL + """ SELECT b.doc_id, m.repo||'/'||m.path||':'||line_start||'-'||line_end AS link,
  (CASE b.doc_id%4 WHEN 0 THEN 'Документ.D' WHEN 1 THEN 'ОбщийМодуль.M' WHEN 2 THEN 'Справочник.C' ELSE 'Отчет.R' END)||(b.doc_id%50)||' · '
  ||CASE WHEN b.doc_id%4=1 THEN 'ОбщийМодуль' ELSE 'Модуль' END||' · '
  ||CASE kind WHEN 'proc' THEN 'Процедура '||name WHEN 'func' THEN 'Функция '||name ELSE 'код вне процедур' END||CASE WHEN is_export THEN ' (Экспорт)' ELSE '' END AS title
FROM blocks b JOIN modules m USING (doc_id)""")
def _(t):
    b = C.segment_blocks(modules(t.documents).withColumn("m", P.path_meta(F.col("path"))), ["doc_id", "repo", "path", "m"], "text")
    return b.select("doc_id", C.hit_link(F.col("repo"), F.col("path"), F.col("line_start"), F.col("line_end")).alias("link"),
                    C.hit_title(F.col("m.object_type"), F.col("m.object_name"), F.col("m.module_kind"), F.col("m.sub_name"),
                                F.col("kind"), F.col("name"), F.col("is_export")).alias("title"))


PATH_EXPR = """CASE p_partkey % 10 WHEN 0 THEN 'conf/Documents/D'||p_size||'/Ext/ObjectModule.bsl' WHEN 1 THEN 'Catalogs/C'||p_size||'/Forms/F'||p_type||'/Ext/Form/Module.bsl'
 WHEN 2 THEN 'CommonModules/'||p_type||'/Ext/Module.bsl' WHEN 3 THEN 'Documents/D'||p_size||'.xml' WHEN 4 THEN 'Ext/SessionModule.bsl'
 WHEN 5 THEN 'a/b/Reports/R'||p_size||'/Commands/Run/Ext/CommandModule.bsl' WHEN 6 THEN 'HTTPServices/S'||p_size||'/Ext/Module.bsl' WHEN 7 THEN 'Enums/E'||p_size||'/E'||p_size||'.mdo'
 WHEN 8 THEN 'misc/readme'||p_size||'.xml' ELSE 'src/some'||p_size||'.bsl' END"""


@query("path_meta", """SELECT p_partkey,
 CASE p_partkey%10 WHEN 0 THEN 'Документ' WHEN 1 THEN 'Справочник' WHEN 2 THEN 'ОбщийМодуль' WHEN 3 THEN 'Документ' WHEN 5 THEN 'Отчет' WHEN 6 THEN 'HTTPСервис' WHEN 7 THEN 'Перечисление' ELSE 'Конфигурация' END AS object_type,
 CASE p_partkey%10 WHEN 0 THEN 'D'||p_size WHEN 1 THEN 'C'||p_size WHEN 2 THEN p_type WHEN 3 THEN 'D'||p_size WHEN 5 THEN 'R'||p_size WHEN 6 THEN 'S'||p_size WHEN 7 THEN 'E'||p_size ELSE '' END AS object_name,
 CASE p_partkey%10 WHEN 0 THEN 'МодульОбъекта' WHEN 1 THEN 'МодульФормы' WHEN 2 THEN 'ОбщийМодуль' WHEN 3 THEN 'Структура' WHEN 4 THEN 'МодульСеанса' WHEN 5 THEN 'МодульКоманды' WHEN 6 THEN 'МодульСервиса'
   WHEN 7 THEN 'Структура' WHEN 8 THEN 'Структура' ELSE 'Модуль' END AS module_kind,
 CASE p_partkey%10 WHEN 1 THEN 'F'||p_type WHEN 5 THEN 'Run' ELSE '' END AS sub_name FROM part""")
def _(t):
    return t.part.select("p_partkey", P.path_meta(F.expr(PATH_EXPR)).alias("m")).select("p_partkey", "m.*")


@query("object_file_filter", "SELECT p_partkey, p_partkey%10 IN (3,7) AS is_object FROM part")
def _(t):
    return t.part.select("p_partkey", P.is_object_file(F.expr(PATH_EXPR)).alias("is_object"))


def _written(t):
    """The documents as text files, one folder per source and language."""
    folder = workspace(t.spark, "folder")
    t.documents.select("source", "lang", "text").write.option("maxRecordsPerFile", 100000).partitionBy("source", "lang").text(folder)
    return folder


@query("scan_files", "SELECT source, lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, 'text' AS kind FROM documents GROUP BY 1, 2")
def _(t):
    found = S.scan_files(t.spark, _written(t), {".txt": "text", ".md": "text", ".docx": "word"})
    return found.groupBy(F.regexp_extract("rel_path", "source=([^/]*)", 1).alias("source"), F.regexp_extract("rel_path", "lang=([^/]*)", 1).alias("lang"), "kind").agg(
        F.sum("size").alias("bytes"))


@query("extract_text", "SELECT source, lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars, 0 AS failed FROM documents GROUP BY 1, 2")
def _(t):
    texts = S.extract_text(S.read_contents(t.spark, _written(t)))
    return texts.groupBy(F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang")).agg(
        F.sum(F.length("text")).alias("chars"), F.count_if(F.col("error").isNotNull()).cast("int").alias("failed"))


CYRILLIC = ("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувжшыз")


@query("decode_text", f"""
SELECT doc_id, CASE WHEN doc_id%3=0 AND regexp_matches(text, '^[[:ascii:]]*$') THEN translate(text, '{CYRILLIC[0]}', '{CYRILLIC[1]}')
  ELSE text END AS text FROM documents""")
def _(t):
    ascii_only = F.col("text").rlike(r"^\p{ASCII}*$") & (F.col("doc_id") % 3 == 0)
    content = (F.when(ascii_only, F.encode(F.translate("text", CYRILLIC[0], CYRILLIC[1].encode("cp1251").decode("latin-1")), "ISO-8859-1"))
               .when(F.col("doc_id") % 2 == 0, F.encode(F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n"))), "UTF-8"))
               .otherwise(F.encode("text", "UTF-8")))
    return t.documents.select("doc_id", content.alias("content")).select("doc_id", S.decode_text(F.col("content")).alias("text"))
