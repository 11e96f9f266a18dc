"""Text, link, number and payload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.functions import fixed as X
from deskmill.functions import links as L
from deskmill.functions import text as T
from deskmill.functions import values as V
from deskmill.operators.journal import shorten
from deskmill.operators.risk import counterparty_status
from deskmill.plans.registry import query
from deskmill.sources.views import FILES_SQL, files


def _raw_answer(t):
    turn = F.col("turn").cast("string")
    return t.conversations.select("conv_id", "turn", F.concat(
        F.lit("  # "), "role", F.lit("\n"), "text", F.lit("\n```sql\n**bold "), turn, F.lit("** see /tmp/a"), F.col("conv_id").cast("string"),
        F.lit(".txt and C:\\data\\x"), turn, F.lit(" `mcp__tool_"), turn, F.lit("` <thinking>\n\n\n\nend __u__ keep/tmp/this  ")).alias("raw"))


RAW_SQL = r"""raw AS (SELECT conv_id, turn, '  # '||role||chr(10)||text||chr(10)||'```sql'||chr(10)||'**bold '||turn||'** see /tmp/a'||conv_id
 ||'.txt and C:\data\x'||turn||' `mcp__tool_'||turn||'` <thinking>'||repeat(chr(10),4)||'end __u__ keep/tmp/this  ' AS raw FROM conversations)"""


@query("clean_answer", "WITH " + RAW_SQL + r""",
s1 AS (SELECT conv_id, turn, regexp_replace(raw, '(?i)</?(system-reminder|thinking|antml:[\w-]+)[^>]*>', '', 'g') AS x FROM raw),
s2 AS (SELECT conv_id, turn, regexp_replace(x, '(?:[A-Za-z]:\\|\\\\)[^\s"''<>|]*', '[путь скрыт]', 'g') AS x FROM s1),
s3 AS (SELECT conv_id, turn, regexp_replace(x, '(^|[^\pL\pN_/])/(?:home|tmp|var|usr|etc|Users|opt|root|mnt)/[^\s"''<>|]*', '\1[путь скрыт]', 'g') AS x FROM s2),
s4 AS (SELECT conv_id, turn, regexp_replace(x, '`?mcp__[\pL\pN_]+`?', '', 'g') AS x FROM s3),
s5 AS (SELECT conv_id, turn, regexp_replace(x, '(?m)^```[\w-]*\s*$', '', 'g') AS x FROM s4),
s6 AS (SELECT conv_id, turn, regexp_replace(x, '(?m)^\s{0,3}#{1,6}\s+', '', 'g') AS x FROM s5),
s7 AS (SELECT conv_id, turn, regexp_replace(x, '(?s)\*\*(.+?)\*\*|__(.+?)__', '\1\2', 'g') AS x FROM s6)
SELECT conv_id, turn, regexp_replace(regexp_replace(x, '\n{3,}', chr(10)||chr(10), 'g'), '^\s+|\s+$', '', 'g') AS answer FROM s7""")
def _(t):
    return _raw_answer(t).select("conv_id", "turn", T.clean_answer(F.col("raw")).alias("answer"))


@query("split_message")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.concat("text", F.lit("\n\n"), "text").alias("text"))
    return rows.select("conv_id", "turn", F.posexplode(T.split_message(F.col("text"), 300)).alias("part_no", "part"))


@query("find_links", """
WITH b AS (SELECT page_id, url, 'Open '||url||', then  compare '||url||'/x?y=1. Thanks' AS msg FROM pages)
SELECT page_id, 1 AS link_no, rtrim(url, '.,;:!?)') AS link, 'Open then compare '||url||'/x?y=1. Thanks' AS rest FROM b
UNION ALL SELECT page_id, 2, url||'/x?y=1', 'Open '||url||', then compare Thanks' FROM b""")
def _(t):
    msg = F.concat(F.lit("Open "), "url", F.lit(", then  compare "), "url", F.lit("/x?y=1. Thanks"))
    return L.find_links(t.pages.select("page_id", msg.alias("msg")), "msg", ["page_id"])


RAW_LINK = """CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://bob:pw@') WHEN 2 THEN upper(url)||').'
 WHEN 3 THEN {sub} ELSE {sub}||'#e1cib/list' END"""
RAW_LINK_SQL = RAW_LINK.format(sub="regexp_replace(url, '/(en|fr|de|es)/', '/Base1/Sub/ru_RU/')")
RAW_LINK_SPARK = RAW_LINK.format(sub="regexp_replace(url, '/(en|fr|de|es)/', '/Base1/Sub/ru_RU/')")
PUBLICATION_SQL = "link AS (SELECT page_id, url, " + RAW_LINK_SQL + r""" AS raw FROM pages),
c AS (SELECT *, regexp_replace(raw, '[.,;:!?)]+$', '') AS u FROM link),
p AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
  list_filter(string_split(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s<>'') AS segs FROM c),
q AS (SELECT *, list_position(list_transform(segs, lambda s: lower(s) IN ('hs','odata','ws','ru_ru','en_us','ru','en','e1cib','e1csys')), true) AS stop FROM p),
pub AS (SELECT *, CASE WHEN contains(host, '@') OR coalesce(stop, 99)=1 OR len(segs)=0 THEN NULL
  ELSE scheme||'://'||host||'/'||array_to_string(list_slice(segs, 1, coalesce(stop, 1000)-1), '/') END AS publication FROM q)"""


def _links(t):
    return t.pages.select("page_id", "url", F.expr(RAW_LINK_SPARK).alias("raw"))


@query("publication_url", "WITH " + PUBLICATION_SQL + " SELECT page_id, raw, publication FROM pub")
def _(t):
    return _links(t).select("page_id", "raw", L.publication_url(F.col("raw")).alias("publication"))


NORM_SQL = r"lower(regexp_extract({u}, '^([A-Za-z]+)://', 1)||'://'||regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)||regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''))"


@query("norm_url", "SELECT page_id, " + NORM_SQL.format(u="trim(url)") + " AS norm FROM pages")
def _(t):
    return t.pages.select("page_id", L.norm_url(F.col("url")).alias("norm"))


@query("link_to_base", "WITH " + PUBLICATION_SQL + ", bases AS (SELECT " + NORM_SQL.format(u="publication") + """ AS norm, min(page_id) AS base_no
  FROM pub WHERE publication IS NOT NULL GROUP BY 1)
SELECT DISTINCT pub.page_id, b.base_no FROM pub JOIN bases b ON b.norm = """ + NORM_SQL.format(u="pub.raw")
       + " OR b.norm = " + NORM_SQL.format(u="pub.publication"))
def _(t):
    rows = _links(t).select("page_id", "raw", L.publication_url(F.col("raw")).alias("publication"))
    bases = (rows.filter("publication is not null").groupBy(L.norm_url(F.col("publication")).alias("norm"))
             .agg(F.min("page_id").alias("base_no")))
    forms = (rows.select("page_id", F.explode(F.array_distinct(F.array(
        L.norm_url(F.col("raw")), L.norm_url(F.coalesce("publication", F.lit("")))))).alias("norm")))
    return forms.join(bases, "norm").select("page_id", "base_no").distinct()


TRANSLIT_SQL = "translate(" + "".join("replace(" for v in X.TRANSLIT.values() if len(v) != 1) + "{x}" + "".join(
    f", '{k}', '{v}')" for k, v in X.TRANSLIT.items() if len(v) != 1) + ", '" + "".join(
    k for k, v in X.TRANSLIT.items() if len(v) == 1) + "', '" + "".join(v for v in X.TRANSLIT.values() if len(v) == 1) + "')"
SLUG_SQL = r"""named AS (SELECT page_id, CASE WHEN page_id%3=0 THEN 'http://h.kz/База Щёки'||page_id%7 ELSE url END AS link FROM pages),
n AS (SELECT page_id, lower(regexp_extract(regexp_replace(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '[^/]*$')) AS name FROM named),
k AS (SELECT page_id, substr(trim(regexp_replace(""" + TRANSLIT_SQL.format(x="name") + r""", '[^a-z0-9]+', '_', 'g'), '_'), 1, 30) AS c FROM n),
slugs AS (SELECT page_id, CASE WHEN c='' THEN 'base' WHEN regexp_matches(c, '^[a-z]') THEN c ELSE 'b_'||c END AS slug FROM k)"""


def _slugs(t):
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://h.kz/База Щёки"), (F.col("page_id") % 7).cast("string"))).otherwise(F.col("url"))
    return t.pages.select("page_id", L.slug(link).alias("slug"))


@query("slug", "WITH " + SLUG_SQL + " SELECT * FROM slugs")
def _(t):
    return _slugs(t)


@query("unique_slug", "WITH " + SLUG_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM slugs)
SELECT page_id, slug, CASE WHEN n=1 THEN slug ELSE slug||'_'||n END AS unique_code FROM r""")
def _(t):
    return L.unique_slugs(_slugs(t), "slug", "page_id", F.floor(F.col("page_id") / 1000))


LIMIT_TEXT = """CASE k % 6 WHEN 0 THEN 'usage limit reached|'||CAST(1700000000 + k*1000 AS {s}) WHEN 1 THEN 'Limit reached, resets 6:20pm'
 WHEN 2 THEN 'out of usage - Resets at '||CAST(k % 13 AS {s})||'am' WHEN 3 THEN 'limit will reset, resets 14:05' WHEN 4 THEN 'лимит исчерпан' ELSE 'fine, resets 5pm' END"""


@query("limit_reset", "WITH e AS (SELECT event_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events), x AS (SELECT *, date_trunc('day', ts) AS d,"
       + LIMIT_TEXT.format(s="VARCHAR") + """ AS msg FROM e),
a AS (SELECT *, CASE k%6 WHEN 1 THEN d + INTERVAL 18 HOUR + INTERVAL 20 MINUTE
   WHEN 2 THEN d + CAST((CASE WHEN k%13=12 THEN 0 ELSE k%13 END) AS INTEGER) * INTERVAL 1 HOUR WHEN 3 THEN d + INTERVAL 14 HOUR + INTERVAL 5 MINUTE END AS due FROM x)
SELECT event_id, k%6 <> 5 AS hit, CASE WHEN k%6=0 THEN make_timestamp((1700000000 + k*1000)::BIGINT * 1000000)
  WHEN due > ts THEN due ELSE due + INTERVAL 1 DAY END AS reset FROM a""")
def _(t):
    rows = t.events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    return rows.select("event_id", T.limit_reset(F.expr(LIMIT_TEXT.format(s="string")), F.col("ts")).alias("r")).select("event_id", "r.*")


NUMBER_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {s}), '.', ',') WHEN 1 THEN '1 '||CAST(o_orderkey AS {s})||',50'
 WHEN 2 THEN 'true' WHEN 3 THEN CAST(o_orderkey AS {s}) WHEN 4 THEN '-'||CAST(o_orderkey AS {s})||'.0' ELSE o_orderpriority END"""


@query("lenient_number", "WITH x AS (SELECT o_orderkey, " + NUMBER_TEXT.format(s="VARCHAR") + r""" AS v FROM orders),
n AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches(translate(v, ' ,', '.'), '^x') THEN NULL ELSE replace(replace(replace(v,' ',''),' ',''),',','.') END AS DOUBLE) AS d FROM x)
SELECT o_orderkey, CASE WHEN v='true' THEN NULL ELSE d END AS number, CASE WHEN v<>'true' AND d=floor(d) THEN CAST(d AS BIGINT) END AS whole FROM n""")
def _(t):
    rows = t.orders.select("o_orderkey", F.expr(NUMBER_TEXT.format(s="string")).alias("v"))
    return rows.select("o_orderkey", V.lenient_number(F.col("v")).alias("number"), V.lenient_int(F.col("v")).alias("whole"))


def payloads(t):
    """One service answer per customer: plain, nested under result or data, in a one-element list, or with fields missing."""
    owed = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("decimal(18,2)"))).alias("debt"),
        F.count_if(F.col("o_orderstatus") == "P").alias("unsigned"))
    rows = t.customer.select("c_custkey").join(owed, "c_custkey", "left")
    debt = F.translate(F.coalesce("debt", F.lit(0)).cast("decimal(18,2)").cast("string"), ".", ",")
    plain = F.concat(F.lit('{"debtAmount": "'), debt, F.lit('", "unsignedEavrCount": '), F.col("unsigned").cast("string"), F.lit("}"))
    snake = F.concat(F.lit('{"debt_amount": -5.5, "unsigned_eavr_count": '), F.col("unsigned").cast("string"), F.lit("}"))
    k = F.col("c_custkey") % 6
    body = (F.when(F.col("unsigned").isNull(), F.lit('{"message": "no data"}')).when(k == 0, plain)
            .when(k == 1, F.concat(F.lit('{"code": 1, "result": '), snake, F.lit("}")))
            .when(k == 2, F.concat(F.lit("["), plain, F.lit("]"))).when(k == 3, F.concat(F.lit('{"data": '), plain, F.lit("}")))
            .when(k == 4, F.lit('{"debtAmount": true, "unsignedEavrCount": 1}')).otherwise(F.lit("[1, 2]")))
    number = F.when(F.col("c_custkey") % 25 == 7, F.lit("12 34")).otherwise(F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return rows.select("c_custkey", "debt", "unsigned", number.alias("id_text"), body.alias("payload"))


OWED_SQL = """owed AS (SELECT c_custkey, c_custkey%6 AS k, (SELECT 1) AS one, o.* FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus='O') AS debt,
  count(*) FILTER (o_orderstatus='P') AS unsigned FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
flat AS (SELECT c_custkey, k, unsigned IS NOT NULL AND k < 4 AS usable,
  CASE WHEN unsigned IS NOT NULL THEN CASE WHEN k IN (0,2,3) THEN CAST(coalesce(debt,0) AS DOUBLE) WHEN k=1 THEN -5.5 END END AS debt,
  CASE WHEN unsigned IS NOT NULL THEN CASE WHEN k < 4 THEN unsigned WHEN k=4 THEN 1 END END AS unsigned FROM owed)"""


@query("payload_body", "WITH " + OWED_SQL + " SELECT c_custkey, debt, unsigned FROM flat")
def _(t):
    rows = payloads(t).withColumn("body", V.payload_body(F.col("payload")))
    return rows.select("c_custkey", V.lenient_number(V.pick(F.col("body"), "debt_amount")).alias("debt"),
                       V.lenient_int(V.pick(F.col("body"), "unsigned_eavr_count")).alias("unsigned"))


@query("counterparty_status", "WITH " + OWED_SQL + """
SELECT c_custkey, CASE WHEN c_custkey%25=7 THEN '1234' ELSE lpad(c_custkey::VARCHAR, 12, '0') END AS bin,
 CASE WHEN c_custkey%25=7 OR NOT usable THEN 'error' WHEN debt > 0 OR unsigned > 0 THEN 'needs_manager' ELSE 'ok' END AS status,
 CASE WHEN c_custkey%25=7 THEN 'invalid_bin' WHEN NOT usable THEN 'invalid_response' END AS error FROM flat""")
def _(t):
    return counterparty_status(payloads(t).drop("debt", "unsigned"), "id_text", "payload").select("c_custkey", "bin", "status", "error")


@query("http_error_kind", """
SELECT p_partkey, CASE code WHEN 400 THEN 'bad_request' WHEN 401 THEN 'unauthorized' WHEN 403 THEN 'forbidden' ELSE
  CASE WHEN code >= 500 THEN 'server_error' WHEN code BETWEEN 200 AND 299 THEN NULL ELSE 'http_error' END END AS kind
FROM (SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN 399+p_size ELSE 190+p_size*8 END AS code FROM part)""")
def _(t):
    code = F.when(F.col("p_partkey") % 2 == 0, 399 + F.col("p_size")).otherwise(190 + F.col("p_size") * 8)
    return t.part.select("p_partkey", V.http_error_kind(code).alias("kind"))


@query("redact", r"""
SELECT doc_id, replace(replace(text, 'tion', '***'), source, '***') AS clean, 'http://h.kz:80/'||doc_id AS link FROM documents WHERE source='src1'
UNION ALL SELECT doc_id, replace(text, 'tion', '***'), 'http://h.kz:80/'||doc_id FROM documents WHERE source<>'src1'""")
def _(t):
    link = F.concat(F.lit("http://bob:pw@h.kz:80/"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", T.redact(F.col("text"), ["tion", "", "src1"]).alias("c1"), T.redact(F.col("text"), ["tion"]).alias("c2"), "source",
                              L.safe_url(link).alias("link")).select(
        "doc_id", F.when(F.col("source") == "src1", F.col("c1")).otherwise(F.col("c2")).alias("clean"), "link")


@query("shown_type", """
SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN 'СправочникСсылка.'||p_type WHEN 1 THEN 'Строка' WHEN 2 THEN 'ДокументОбъект.'||p_brand
  WHEN 3 THEN 'РегистрСведений' WHEN 4 THEN 'Unknown.'||p_type ELSE 'decimal.x' END AS shown FROM part""")
def _(t):
    k = F.col("p_partkey") % 6
    raw = (F.when(k == 0, F.concat(F.lit("cfg:CatalogRef."), "p_type")).when(k == 1, F.lit("xs:string"))
           .when(k == 2, F.concat(F.lit(" d:DocumentObject."), "p_brand")).when(k == 3, F.lit("InformationRegister"))
           .when(k == 4, F.concat(F.lit("Unknown."), "p_type")).otherwise(F.lit("decimal.x")))
    return t.part.select("p_partkey", V.shown_type(raw).alias("shown"))


@query("title_from_name", "WITH " + FILES_SQL + r"""
SELECT doc_id, CASE WHEN doc_id%17=0 THEN doc_id::VARCHAR WHEN doc_id%13=0 THEN doc_id::VARCHAR||'' ELSE 'Отчет '||lang END AS title FROM files""")
def _(t):
    name = F.when((F.col("doc_id") % 17 == 0) | (F.col("doc_id") % 13 == 0), T.base_name(F.col("path"))).otherwise(
        F.concat(F.lit("1.2 +! Отчет "), "lang", F.lit(" (3) — копия.docx")))
    return files(t.documents).select("doc_id", T.title_from_name(name, ("копия", "copy")).alias("title"))


@query("camel_words", r"""
SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN lower(split_part(p_name,' ',1))||' '||lower(split_part(p_name,' ',2))||' '||p_partkey||' xml'
 ELSE 'значение '||lower(p_type) END AS words FROM part""")
def _(t):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.initcap(first), F.initcap(second), F.col("p_partkey").cast("string"), F.lit("XML"))
                  ).otherwise(F.concat(F.lit("Значение_"), "p_type"))
    return t.part.select("p_partkey", F.array_join(T.camel_words(name), " ").alias("words"))


@query("first_comment", r"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(trim(s), '^/+', ''))) AS ls FROM documents),
b AS (SELECT doc_id, regexp_extract(array_to_string(ls, chr(10)), '(?s)^\n*(.*?)(?:\n\n|\n*\z)', 1) AS block FROM l)
SELECT doc_id, regexp_replace(lower(substr(p,1,1))||substr(p,2), '\.+$', '') AS phrase FROM (
  SELECT doc_id, trim(string_split(replace(block, chr(10), ' '), '. ')[1]) AS p FROM b)""")
def _(t):
    lines = F.transform(F.split("text", "\n"), lambda s: F.concat(F.lit("// "), s))
    body = F.concat(F.array_join(lines, "\n"), F.lit("\n// Parameters:\n//  a\nProcedure X()"))
    return t.documents.select("doc_id", T.first_comment(body).alias("phrase"))


@query("short_text", r"""
SELECT doc_id, CASE WHEN length(x) > 120 THEN substr(x,1,119)||'…' ELSE x END AS short FROM (
  SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)""")
def _(t):
    return t.documents.select("doc_id", shorten(F.col("text"), 120).alias("short"))
