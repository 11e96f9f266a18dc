"""Views over the star-schema test tables that stand in for journal, messages and files.

Each view has its SQL twin below, so that check queries start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _k() -> F.Column:
    return F.regexp_extract("props", r"([0-9]+)", 1).cast("int")


def journal(events: DataFrame) -> DataFrame:
    k = _k()
    status = (F.when(F.col("event_type").isin("purchase", "view"), "ok")
              .when((F.col("event_type") == "error") & (k % 2 == 0), "error")
              .when(F.col("event_type") == "error", "send_error")
              .when(F.col("event_type") == "click", "limit")
              .otherwise("unknown_user"))
    return (events
            .withColumn("k", k).withColumn("status", status)
            .select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
                    F.col("event_type").alias("channel"), F.col("user_id").alias("user_key"),
                    F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_name"),
                    F.when(F.col("k") % 4 != 0, F.concat(F.lit("base_"), (F.col("k") % 4).cast("string"))).alias("base_id"),
                    F.col("props").alias("question"), "status",
                    F.when(F.col("status") == "ok", F.concat(F.lit("answer "), F.col("k").cast("string"))).alias("answer"),
                    F.when(F.col("status").isin("error", "send_error"),
                           F.concat(F.lit("Failure "), F.col("k").cast("string"))).alias("error"),
                    F.round(F.col("value") * 1000).cast("long").alias("duration_ms"),
                    (F.col("value") / 100).alias("cost_usd")))


JOURNAL_SQL = """journal_k AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
journal_s AS (
  SELECT *, CASE WHEN event_type IN ('purchase','view') THEN 'ok'
     WHEN event_type='error' AND k%2=0 THEN 'error' WHEN event_type='error' THEN 'send_error'
     WHEN event_type='click' THEN 'limit' ELSE 'unknown_user' END AS status FROM journal_k),
journal AS (
  SELECT event_id AS id, ts AS created_at, event_type AS channel, user_id AS user_key,
    'user_'||user_id AS user_name, CASE WHEN k%4<>0 THEN 'base_'||(k%4) END AS base_id, props AS question, status,
    CASE WHEN status='ok' THEN 'answer '||k END AS answer,
    CASE WHEN status IN ('error','send_error') THEN 'Failure '||k END AS error,
    CAST(round(value*1000) AS BIGINT) AS duration_ms, value/100 AS cost_usd FROM journal_s)"""


def messages(events: DataFrame) -> DataFrame:
    return (events.withColumn("k", _k())
            .select(F.col("event_id").alias("message_id"), "user_id", "ts",
                    F.when(F.col("event_type") == "click", "file")
                    .when(F.col("event_type") == "signup", "command").otherwise("text").alias("kind"),
                    F.when(F.col("event_type") == "purchase",
                           F.concat(F.lit("base_"), (F.col("k") % 3).cast("string"))).alias("base_ref"),
                    F.col("props").alias("body")))


MESSAGES_SQL = """messages AS (
  SELECT event_id AS message_id, user_id, ts,
    CASE event_type WHEN 'click' THEN 'file' WHEN 'signup' THEN 'command' ELSE 'text' END AS kind,
    CASE WHEN event_type='purchase'
      THEN 'base_'||(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)%3) END AS base_ref,
    props AS body FROM events)"""


def files(documents: DataFrame) -> DataFrame:
    name = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return documents.withColumn(
        "path", F.concat(name, F.when(F.col("doc_id") % 17 == 0, ".png")
                         .when(F.col("doc_id") % 13 == 0, " - copy.txt").otherwise(".txt")))


FILES_SQL = """files AS (
  SELECT *, source||'/'||doc_id||CASE WHEN doc_id%17=0 THEN '.png' WHEN doc_id%13=0 THEN ' - copy.txt' ELSE '.txt' END AS path
  FROM documents)"""


def modules(documents: DataFrame) -> DataFrame:
    """Documents turned into module texts: comments, procedure headers, ends, blank lines."""
    i1 = "(i + 1)"
    line = f"""CASE {i1} % 6 WHEN 1 THEN concat('// ', x)
      WHEN 2 THEN CASE WHEN {i1} % 4 = 2 THEN concat('Procedure P', doc_id, 'x', {i1}, '(a) Export') ELSE concat('Function F', doc_id, 'x', {i1}, '(a)') END
      WHEN 4 THEN CASE WHEN {i1} % 9 = 4 THEN '' ELSE 'EndProcedure' END WHEN 5 THEN '' ELSE x END"""
    return documents.select(
        F.col("source").alias("repo"), "doc_id",
        F.expr("concat(CASE doc_id % 4 WHEN 0 THEN 'Documents/D' WHEN 1 THEN 'CommonModules/M' WHEN 2 THEN 'Catalogs/C' ELSE 'Reports/R' END, doc_id % 50, "
               "CASE doc_id % 4 WHEN 1 THEN '/Ext/Module' ELSE '/Ext/ObjectModule' END, doc_id, '.bsl')").alias("path"),
        F.expr(f"array_join(transform(split(text, '\n'), (x, i) -> {line}), '\n')").alias("text"))


MODULES_SQL = """modules AS (SELECT source AS repo, doc_id,
  (CASE doc_id % 4 WHEN 0 THEN 'Documents/D' WHEN 1 THEN 'CommonModules/M' WHEN 2 THEN 'Catalogs/C' ELSE 'Reports/R' END)||(doc_id % 50)
   ||(CASE doc_id % 4 WHEN 1 THEN '/Ext/Module' ELSE '/Ext/ObjectModule' END)||doc_id||'.bsl' AS path,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE i % 6 WHEN 1 THEN '// '||x
      WHEN 2 THEN CASE WHEN i % 4 = 2 THEN 'Procedure P'||doc_id||'x'||i||'(a) Export' ELSE 'Function F'||doc_id||'x'||i||'(a)' END
      WHEN 4 THEN CASE WHEN i % 9 = 4 THEN '' ELSE 'EndProcedure' END WHEN 5 THEN '' ELSE x END), chr(10)) AS text FROM documents)"""

def object_files(documents: DataFrame) -> DataFrame:
    """Documents turned into descriptions of objects, in both layouts; their file ids lie below zero."""
    flat, found = F.col("doc_id") % 8 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([a-z]{3,})"), F.lit(1))
    rows = documents.filter("doc_id % 8 IN (0, 2)").select("source", "doc_id", flat.alias("flat"), found.alias("ws"))
    name = F.concat(F.when(F.col("flat"), "D").otherwise("C"), (F.col("doc_id") % 50).cast("string"))
    said, parts = F.array_join(F.slice("ws", 1, 2), " "), F.slice("ws", 3, 8)

    def listed(before, after):
        return F.array_join(F.transform(parts, lambda w: F.concat(F.lit(before), w, F.lit(after))), "")

    one = F.concat(F.lit('<MetaDataObject xmlns="http://x/md" xmlns:v8="http://x/v8"><Document uuid="u"><Properties><Name>'), name,
                   F.lit("</Name><Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>"), said, F.lit("</v8:content></v8:item></Synonym></Properties>\n<ChildObjects>"),
                   listed("<Attribute><Properties><Name>", "</Name><Type><v8:Type>xs:decimal</v8:Type></Type></Properties></Attribute>"),
                   F.lit("</ChildObjects></Document></MetaDataObject>\n"))
    two = F.concat(F.lit('<mdclass:Catalog xmlns:mdclass="http://x/m"><name>'), name, F.lit("</name><synonym><key>ru</key><value>"), said, F.lit("</value></synonym>\n"),
                   listed("<attributes><name>", "</name><type><types>xs:decimal</types></type></attributes>"), F.lit("</mdclass:Catalog>"))
    folder = F.concat(F.lit("o"), F.col("doc_id").cast("string"), F.when(F.col("flat"), "/Documents/").otherwise("/Catalogs/"), name)
    return rows.select((-1 - F.col("doc_id")).alias("file_id"), F.col("source").alias("repo"),
                       F.when(F.col("flat"), F.concat(folder, F.lit(".xml"))).otherwise(F.concat(folder, F.lit("/"), name, F.lit(".mdo"))).alias("path"),
                       F.when(F.col("flat"), one).otherwise(two).alias("xml"))


OBJECT_FILES_SQL = """object_words AS (SELECT doc_id, source, doc_id%8=0 AS flat, CASE WHEN doc_id%8=0 THEN 'D' ELSE 'C' END||(doc_id%50) AS object_name,
  CASE WHEN doc_id%8=0 THEN 'Документ' ELSE 'Справочник' END AS object_type, regexp_extract_all(coalesce(text, ''), '[a-z]{3,}') AS ws FROM documents WHERE doc_id%8 IN (0, 2)),
object_files AS (SELECT -1-doc_id AS file_id, source AS repo, 'o'||doc_id||CASE WHEN flat THEN '/Documents/'||object_name||'.xml' ELSE '/Catalogs/'||object_name||'/'||object_name||'.mdo' END AS path,
  object_type, object_name, array_to_string(ws[1:2], ' ') AS said, ws[3:10] AS parts FROM object_words),
object_blocks AS (SELECT *, object_name||CASE WHEN said='' THEN '' ELSE ' '||said END AS name, object_type||'.'||object_name||CASE WHEN said='' THEN '' ELSE ' — «'||said||'»' END
  ||CASE WHEN len(parts)=0 THEN '' ELSE chr(10)||'Реквизиты: '||array_to_string(list_transform(parts, lambda w: w||' (Число)'), '; ') END AS body FROM object_files)"""

BLOCKS_SQL = MODULES_SQL + r""",
ml AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS ls FROM modules),
ln AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM ml),
fl AS (SELECT *, regexp_matches(line, '(?i)^[ \t]*(Procedure|Function)[ \t]+[A-Za-z_]\w*[ \t]*\(') AS st,
  regexp_matches(line, '(?i)^[ \t]*(EndProcedure|EndFunction)\b') AS en, regexp_matches(line, '^\s*(//|&)') AS note,
  regexp_matches(line, '^\s*$') AS blank, NOT regexp_matches(line, '^\s*(//|#|$)') AS means FROM ln),
st AS (SELECT doc_id, i AS s, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM fl WHERE st),
bl AS (SELECT st.doc_id, s, coalesce(min(f.i) FILTER (f.en), max(f.i) FILTER (NOT f.blank)) AS e FROM st
  JOIN fl f ON f.doc_id=st.doc_id AND f.i>=s AND (nx IS NULL OR f.i<nx) GROUP BY 1, 2),
b2 AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS pe FROM bl),
b3 AS (SELECT b2.doc_id, s, e, pe, greatest(pe, coalesce(max(f.i) FILTER (NOT f.note), 0)) + 1 AS a FROM b2
  LEFT JOIN fl f ON f.doc_id=b2.doc_id AND f.i < s AND f.i > pe GROUP BY 1, 2, 3, 4),
gaps AS (SELECT doc_id, pe+1 AS lo, a-1 AS hi FROM b3
  UNION ALL SELECT b.doc_id, max(b.e)+1, max(len(ml.ls)) FROM b3 b JOIN ml USING (doc_id) GROUP BY 1),
gt AS (SELECT g.doc_id, min(f.i) FILTER (NOT blank) AS lo, max(f.i) FILTER (NOT blank) AS hi FROM gaps g
  JOIN fl f ON f.doc_id=g.doc_id AND f.i BETWEEN g.lo AND g.hi GROUP BY g.doc_id, g.lo HAVING bool_or(means)),
al AS (SELECT doc_id, 1 AS lo, max(i) AS hi FROM fl WHERE doc_id NOT IN (SELECT doc_id FROM st) GROUP BY 1 HAVING bool_or(NOT blank)),
spans AS (SELECT doc_id, s, a AS lo, e AS hi FROM b3 UNION ALL SELECT doc_id, NULL, lo, hi FROM gt UNION ALL SELECT doc_id, NULL, lo, hi FROM al),
blocks AS (SELECT sp.doc_id, CASE WHEN s IS NULL THEN 'module' WHEN regexp_matches(h.line, '^\s*Function') THEN 'func' ELSE 'proc' END AS kind,
  CASE WHEN s IS NULL THEN '' ELSE regexp_extract(h.line, '(?:Procedure|Function)[ \t]+(\w+)', 1) END AS name,
  coalesce(contains(h.line, 'Export'), false) AS is_export, CAST(lo AS INTEGER) AS line_start, CAST(hi AS INTEGER) AS line_end,
  array_to_string(list_slice(ml.ls, lo, hi), chr(10)) AS body,
  CASE WHEN s IS NULL THEN '' ELSE trim(regexp_replace(array_to_string(list_transform(list_slice(ml.ls, lo, s-1), lambda x: regexp_replace(x, '^\s*/+', '')), ' '), '\s+', ' ', 'g')) END AS doc
  FROM spans sp JOIN ml USING (doc_id) LEFT JOIN fl h ON h.doc_id=sp.doc_id AND h.i=sp.s)"""
