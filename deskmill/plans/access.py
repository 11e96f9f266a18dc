"""Guarded reads, exports, rights and typed cells."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from deskmill.functions.text import safe_file_name
from deskmill.functions.values import coerce_param, json_value, typed_cell
from deskmill.operators import access as A
from deskmill.operators.chunking import segment_blocks
from deskmill.plans.registry import query
from deskmill.session import workspace
from deskmill.sources.views import BLOCKS_SQL, modules

START, END = dt.date(1996, 1, 15), dt.date(1998, 3, 10)
RANGE_SQL = "o_orderdate >= TIMESTAMP '1996-01-15' AND o_orderdate < TIMESTAMP '1998-03-11'"


@query("event_log", """
SELECT event_id, ts, user_id, event_type, value FROM events
WHERE ts >= TIMESTAMP '2024-01-13 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND event_type IN ('error','purchase')
  AND (CASE WHEN value > 20 THEN 'high' ELSE 'low' END) = 'low' ORDER BY ts DESC, event_id DESC LIMIT 200""")
def _(t):
    log = t.events.withColumn("level", F.when(F.col("value") > 20, "high").otherwise("low"))
    return A.event_log(log, dt.datetime(2024, 1, 20, 12), level="low", levels=["low", "high"], events=["error", "purchase"],
                       limit=200).select("event_id", "ts", "user_id", "event_type", "value")


PARAM_TEXT = """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM {lineitem}
WHERE l_shipdate >= :since AND l_returnflag = :flag ORDER BY l_orderkey, l_linenumber"""


@query("param_query", """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-06-01' AND l_returnflag = 'R' ORDER BY 1, 2 LIMIT 1001""")
def _(t):
    return A.param_query(t.spark, PARAM_TEXT, {"since": dt.datetime(1996, 6, 1), "flag": "R"}, {"lineitem": t.lineitem}, limit=5000)


@query("validate_only")
def _(t):
    texts = [PARAM_TEXT, "SELECT no_such_column FROM {lineitem}", "DELETE FROM {lineitem}", "SELECT FROM WHERE"]
    args = {"since": dt.datetime(1996, 6, 1), "flag": "R"}
    seen = [(i, A.validate_query(t.spark, s, args if ":since" in s else {}, {"lineitem": t.lineitem})) for i, s in enumerate(texts)]
    checks = t.spark.createDataFrame([(i, e is None, e) for i, e in seen], "query_no int, ok boolean, error string")
    n = A.param_query(t.spark, "SELECT count(*) AS n FROM {lineitem}", {}, {"lineitem": t.lineitem})
    return checks.withColumn("table_rows", n.scalar())


@query("capped_result", """
SELECT l_orderkey, l_linenumber, l_quantity, (SELECT count(*) FROM lineitem WHERE l_quantity > 30) AS total_rows, true AS truncated
FROM lineitem WHERE l_quantity > 30 ORDER BY 1, 2 LIMIT 200""")
def _(t):
    rows = t.lineitem.filter(F.col("l_quantity") > 30).select("l_orderkey", "l_linenumber", "l_quantity")
    return A.capped_result(rows, ["l_orderkey", "l_linenumber"])


@query("export_by_month", f"""
WITH m AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1998-03-01', INTERVAL 1 MONTH)) AS DATE) AS m),
n AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE {RANGE_SQL} GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS month, CAST(greatest(m, DATE '1996-01-15') AS DATE) AS first_day,
  CAST(least(m + INTERVAL 1 MONTH - INTERVAL 1 DAY, DATE '1998-03-10') AS DATE) AS last_day,
  CAST(coalesce(least(n.n, 190), 0) AS BIGINT) AS n, coalesce(n.n > 190, false) AS truncated
FROM m LEFT JOIN n ON n.month = strftime(m, '%Y-%m')""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return A.export_by_month(rows, "o_orderdate", START, END, ["o_orderkey"], 190, workspace(t.spark, "export"))


EXPORT_TEXT = """SELECT o_orderkey, o_totalprice FROM {orders}
WHERE o_orderdate BETWEEN :period_start AND :period_end AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey"""


@query("export_query", f"""
WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_totalprice FROM orders WHERE {RANGE_SQL} AND o_totalprice > 1000),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS row_no, count(*) OVER (PARTITION BY month) AS held FROM r)
SELECT month, row_no, o_orderkey, o_totalprice, held > 150 AS truncated FROM n WHERE row_no <= 150""")
def _(t):
    done = A.export_query(t.spark, EXPORT_TEXT, {"orders": t.orders}, START, END, workspace(t.spark, "query-export"), 150)
    return done.rows.join(done.report.select("month", "truncated"), "month")


@query("capped_partitions", f"""
SELECT month, row_no, o_orderkey, n > 100 AS truncated FROM (
 SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, row_number() OVER w AS row_no,
   count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS n
 FROM orders WHERE {RANGE_SQL} WINDOW w AS (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey)) WHERE row_no <= 100""")
def _(t):
    rows = A.in_period(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", START, END)
    return A.capped_partitions(rows, "month", ["o_orderkey"], 100).select("month", "row_no", "o_orderkey", "truncated")


@query("period_union", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_totalprice FROM orders WHERE {RANGE_SQL}""")
def _(t):
    return A.in_period(t.orders, "o_orderdate", START, END).select("month", "o_orderkey", "o_totalprice")


CELLS = """CASE o_orderkey % 9 WHEN 0 THEN {date} WHEN 1 THEN {moment} WHEN 2 THEN {zeros} WHEN 3 THEN {whole}
 WHEN 4 THEN {comma} WHEN 5 THEN {dot} WHEN 6 THEN o_orderpriority WHEN 7 THEN '2024-13-45' ELSE '-12' END"""
CELL_SPARK = CELLS.format(date="date_format(o_orderdate, 'yyyy-MM-dd')", moment="date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")",
                          zeros="lpad(cast(o_orderkey as string), 12, '0')", whole="cast(o_orderkey as string)",
                          comma="replace(cast(cast(o_totalprice as decimal(18,2)) as string), '.', ',')",
                          dot="cast(cast(o_totalprice as decimal(18,2)) as string)")
CELL_SQL = CELLS.format(date="strftime(o_orderdate, '%Y-%m-%d')", moment="strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')",
                        zeros="lpad(o_orderkey::VARCHAR, 12, '0')", whole="o_orderkey::VARCHAR",
                        comma="replace(o_totalprice::DECIMAL(18,2)::VARCHAR, '.', ',')", dot="o_totalprice::DECIMAL(18,2)::VARCHAR")


@query("typed_cells", f"""
WITH c AS (SELECT o_orderkey, o_orderkey % 9 AS m, o_orderdate, o_totalprice, {CELL_SQL} AS cell FROM orders)
SELECT o_orderkey, CASE WHEN m=0 THEN 'date' WHEN m=1 THEN 'datetime' WHEN m IN (3,8) THEN 'int' WHEN m IN (4,5) THEN 'float' ELSE 'text' END AS kind,
  CASE WHEN m=0 THEN CAST(o_orderdate AS DATE) END AS d, CASE WHEN m=1 THEN date_trunc('second', o_orderdate) END AS ts,
  CASE WHEN m=3 THEN o_orderkey WHEN m=8 THEN -12 END AS i,
  CASE WHEN m IN (4,5) THEN CAST(o_totalprice::DECIMAL(18,2) AS DOUBLE) END AS n, CASE WHEN m IN (2,6,7) THEN cell END AS s FROM c""")
def _(t):
    return t.orders.select("o_orderkey", typed_cell(F.expr(CELL_SPARK)).alias("c")).select("o_orderkey", "c.*")


@query("coerce_params", f"""
WITH c AS (SELECT o_orderkey, o_orderkey % 9 AS m, o_orderdate, {CELL_SQL} AS cell FROM orders)
SELECT o_orderkey, CASE WHEN m=0 THEN date_trunc('day', o_orderdate) WHEN m=1 THEN date_trunc('second', o_orderdate) END AS as_date,
  CASE WHEN m NOT IN (0,1) THEN cell END AS as_text FROM c""")
def _(t):
    return (t.orders.select("o_orderkey", F.expr(CELL_SPARK).alias("cell")).withColumn("as_date", coerce_param(F.col("cell")))
            .select("o_orderkey", "as_date", F.when(F.col("as_date").isNull(), F.col("cell")).alias("as_text")))


@query("json_values", """
SELECT c_custkey, coalesce(CASE WHEN c_custkey%3<>0 THEN c_name END, '') AS name, c_acctbal,
  coalesce(CASE WHEN c_custkey%5<>0 THEN c_mktsegment END, '') AS segment FROM customer""")
def _(t):
    return t.customer.select("c_custkey", json_value(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))).alias("name"), "c_acctbal",
                             json_value(F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))).alias("segment"))


@query("people_search", """
WITH f AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0
  AND contains(lower(c_name||' '||c_mktsegment), '7') AND contains(lower(c_name||' '||c_mktsegment), 'build'))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY c_custkey LIMIT 40""")
def _(t):
    people = t.customer.filter(F.col("c_custkey") % 10 != 0).select("c_custkey", "c_name", "c_mktsegment")
    return A.people_search(people, "7 Build", ["c_name", "c_mktsegment"], "c_custkey")


@query("grep_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
h AS (SELECT doc_id, CAST(line AS INTEGER) AS line, substr(trim(line_text),1,300) AS hit FROM l WHERE contains(lower(line_text), 'tion of'))
SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY doc_id, line LIMIT 200""")
def _(t):
    return A.grep_lines(t.documents, "doc_id", "text", "tion OF", 1000)


READ_SQL = r"""
WITH n AS (SELECT doc_id, array_to_string(list_transform(list_slice(string_split(text, chr(10)), 3, 40), lambda x, i: (i+2)||': '||x), chr(10)) AS w FROM documents),
s AS (SELECT doc_id, w, CASE WHEN length(w) > 600 THEN regexp_replace(substr(w,1,600), '\n[^\n]*$', '') ELSE w END AS shown FROM n)
SELECT doc_id, shown, CASE WHEN length(w) > 600 THEN CAST(length(shown)-length(replace(shown, chr(10), '')) + 4 AS INTEGER) END AS next_start FROM s"""


@query("read_lines", READ_SQL)
def _(t):
    return A.read_lines(t.documents.select("doc_id", "text"), "text", 3, 40, 600).drop("text")


PROCEDURE_REQUEST = "CASE WHEN doc_id % 3 = 0 THEN 'NoSuchName' ELSE upper(name) END"


@query("read_procedure", "WITH " + BLOCKS_SQL + f""",
pr AS (SELECT doc_id, name, line_start, line_end FROM blocks WHERE kind <> 'module'),
rq AS (SELECT DISTINCT doc_id, {PROCEDURE_REQUEST} AS procedure FROM pr),
ft AS (SELECT doc_id, lower(name) AS low, min((line_start, line_end)) AS f FROM pr GROUP BY 1, 2),
pl AS (SELECT rq.*, ft.f[1] AS a, ft.f[2] AS b FROM rq LEFT JOIN ft ON ft.doc_id = rq.doc_id AND ft.low = lower(procedure)),
n AS (SELECT doc_id, procedure, a, b, array_to_string(list_transform(list_slice(string_split(text, chr(10)), a, b), lambda x, i: (i + a - 1)||': '||x), chr(10)) AS w
  FROM pl JOIN modules USING (doc_id) WHERE a IS NOT NULL),
s AS (SELECT *, CASE WHEN length(w) > 300 THEN regexp_replace(substr(w,1,300), '\n[^\n]*$', '') ELSE w END AS shown FROM n)
SELECT doc_id, procedure, CAST(a AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end, shown,
  CASE WHEN length(w) > 300 THEN CAST(length(shown)-length(replace(shown, chr(10), '')) + a + 1 AS INTEGER) END AS next_start FROM s
UNION ALL SELECT pl.doc_id, procedure, NULL, NULL, string_agg(name, chr(10) ORDER BY line_start), NULL FROM pl JOIN pr USING (doc_id) WHERE a IS NULL GROUP BY 1, 2""")
def _(t):
    docs = modules(t.documents)
    blocks = segment_blocks(docs, ["doc_id"], "text").select("doc_id", "kind", "name", "line_start", "line_end")
    asked = blocks.filter("kind <> 'module'").select("doc_id", F.expr(PROCEDURE_REQUEST).alias("procedure"))
    return A.read_procedures(docs, blocks, asked, "text", 300)


@query("line_numbers", """
SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS line_text FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line_text")).select(
        "doc_id", (F.col("at") + 1).alias("line"), "line_text")


@query("attachment_preview", """
SELECT doc_id, substr(text, 1, 20000) AS shown, length(text) > 20000 AS truncated FROM documents""")
def _(t):
    return A.preview(t.documents.select("doc_id", "text"), "text").drop("text")


@query("result_rows", """
SELECT o_orderkey // 100 AS part_no, o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders""")
def _(t):
    cells = F.array(F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus")
    results = t.orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("part_no")).agg(F.to_json(F.struct(
        F.array(F.lit("o_orderkey"), F.lit("o_orderpriority"), F.lit("o_orderstatus")).alias("columns"), F.collect_list(cells).alias("rows"))).alias("json"))
    return A.result_rows(results, "json", ["part_no"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("allowed_rows", """
WITH users AS (SELECT c_custkey, c_custkey%7=0 AS star, c_nationkey FROM customer WHERE c_custkey%11<>0)
SELECT o_orderkey, o_custkey, base FROM (SELECT o_orderkey, o_custkey, CAST(o_orderkey%25 AS INTEGER) AS base FROM orders) o
JOIN users u ON u.c_custkey = o.o_custkey
WHERE (u.star OR base IN (u.c_nationkey, (u.c_nationkey+1)%25, (u.c_nationkey+2)%25))
  AND (base%3<>1 OR u.c_nationkey = base)""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 25).cast("int").alias("base"))
    known = t.customer.filter(F.col("c_custkey") % 11 != 0).withColumnRenamed("c_custkey", "o_custkey")
    users = known.select("o_custkey", (F.col("o_custkey") % 7 == 0).alias("star"))
    rights = known.select("o_custkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("c_nationkey") + i) % 25)).alias("base"))
    owners = known.filter(F.col("c_nationkey") % 3 == 1).select(F.col("c_nationkey").alias("base"), "o_custkey")
    nobody = t.nation.filter(F.col("n_nationkey") % 3 == 1).select(F.col("n_nationkey").alias("base"), F.lit(-1).cast("long").alias("o_custkey"))
    return A.allowed_rows(rows, users, rights, owners.unionByName(nobody), user="o_custkey", base="base")


@query("notify_targets", """
SELECT entry, c_custkey::VARCHAR AS receiver FROM customer, (VALUES ('#00000007'), ('11')) e(entry)
WHERE contains(lower(c_name), entry) AND c_custkey%10<>0
UNION ALL SELECT '6f9619ff-8b86-d011-b42d-00c04fc964ff', '6f9619ff-8b86-d011-b42d-00c04fc964ff'""")
def _(t):
    people = t.customer.filter(F.col("c_custkey") % 10 != 0)
    return A.notify_targets(people, ["6F9619FF-8B86-D011-B42D-00C04FC964FF", "#00000007", " 11 "], "c_custkey", "c_name")


@query("safe_file_name", r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '[^\w\s.,()№-]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS b FROM pages)
SELECT page_id, substr(regexp_replace(CASE WHEN b='' THEN 'файл' ELSE b END, '([^.])\.[^.]+$', '\1'), 1, 100)||'.xlsx' AS file_name FROM b""")
def _(t):
    return t.pages.select("page_id", safe_file_name(F.col("url"), ".xlsx").alias("file_name"))
