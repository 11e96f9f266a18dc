"""Metadata queries: descriptions made of orders, trees made of regions, nations and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.operators import metadata as M
from deskmill.plans.registry import query


def descriptions(t):
    """One description per order, its lines as attributes and a tabular part; every second one in the nested layout."""
    def listed(part):
        return F.array_join(F.transform("ls", lambda line: part(line.cast("string"), F.when(line % 2 == 0, "xs:decimal").otherwise("cfg:CatalogRef.Parts"))), "")

    f = listed(lambda no, typ: F.concat(
        F.lit("<Attribute><Properties><Name>L"), no, F.lit("</Name><Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>l "), no,
        F.lit("</v8:content></v8:item></Synonym><Type><v8:Type>"), typ, F.lit("</v8:Type></Type></Properties></Attribute>")))
    n = listed(lambda no, typ: F.concat(
        F.lit("<attributes><name>L"), no, F.lit("</name><synonym><key>ru</key><value>Line "), no, F.lit("</value></synonym><type><types>"), typ, F.lit("</types></type></attributes>")))
    # only the numbers of the lines are shuffled, the texts are made of them
    per = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ls"))
    k = F.col("l_orderkey").cast("string")
    one = F.concat(F.lit('<MetaDataObject xmlns="http://x/md" xmlns:v8="http://x/v8"><Document uuid="u"><Properties><Name>Order'), k,
                   F.lit("</Name><Comment>c "), k, F.lit("</Comment><RegisterRecords><xr:Item xmlns:xr='http://x/r'>AccumulationRegister.Sales</xr:Item><xr:Item xmlns:xr='http://x/r'>AccumulationRegister.Stock"), k,
                   F.lit("</xr:Item></RegisterRecords></Properties><ChildObjects>"), f, F.lit("<TabularSection><Properties><Name>Lines</Name></Properties><ChildObjects>"), f,
                   F.lit("</ChildObjects></TabularSection><Form>Main</Form><Command><Properties><Name>Run</Name></Properties></Command><Subsystem>Trade</Subsystem></ChildObjects></Document></MetaDataObject>"))
    two = F.concat(F.lit('<mdclass:Document xmlns:mdclass="http://x/m"><name>Order'), k, F.lit("</name><synonym><key>ru</key><value>No "), k, F.lit("</value></synonym>"), n,
                   F.lit("<forms><name>Main</name></forms><operations><name>Post</name></operations><registerRecords>AccumulationRegister.Sales</registerRecords><event>OnWrite</event></mdclass:Document>"))
    return per.select("l_orderkey", (F.col("l_orderkey") % 2 == 1).alias("nested"), F.when(F.col("l_orderkey") % 2 == 1, two).otherwise(one).alias("xml"))


def objects(t):
    return M.object_structure(descriptions(t), ["l_orderkey"], "xml", F.col("nested"))


TYPE = "CASE WHEN l_linenumber%2=0 THEN 'Число' ELSE 'СправочникСсылка.Parts' END"


REGISTERS = "CASE WHEN l_orderkey%2=0 THEN 'Движения по регистрам: РегистрНакопления.Sales, РегистрНакопления.Stock'||l_orderkey ELSE 'Событие: OnWrite | Движения по регистрам: РегистрНакопления.Sales' END"


@query("object_structure", f"""SELECT l_orderkey, 'Order'||l_orderkey AS name, CASE WHEN l_orderkey%2=1 THEN 'No '||l_orderkey ELSE '' END AS synonym,
 CASE WHEN l_orderkey%2=0 THEN 'c '||l_orderkey ELSE '' END AS comment, CAST(count(*) + 1 AS INTEGER) AS attributes, CASE WHEN l_orderkey%2=0 THEN 1 ELSE 0 END AS parts, 'Main' AS forms,
 CASE WHEN l_orderkey%2=0 THEN 'Run' ELSE '' END AS commands, {REGISTERS} AS extra FROM lineitem GROUP BY 1""")
def _(t):
    return objects(t).select("l_orderkey", "name", "synonym", "comment", F.size("attributes").alias("attributes"), F.size("tabular").alias("parts"), F.array_join("forms", ",").alias("forms"),
                             F.array_join("commands", ",").alias("commands"), F.array_join(F.transform("extra", lambda e: F.concat(e["label"], F.lit(": "), e["value"])), " | ").alias("extra"))


@query("attributes_table", f"""SELECT l_orderkey, '' AS section, 'Реквизиты' AS "group", 'L'||l_linenumber AS name, {TYPE} AS type FROM lineitem
UNION ALL SELECT l_orderkey, 'Lines', 'Реквизиты', 'L'||l_linenumber, {TYPE} FROM lineitem WHERE l_orderkey%2=0
UNION ALL SELECT DISTINCT l_orderkey, '', CASE WHEN l_orderkey%2=0 THEN 'Подсистемы' ELSE 'Операции' END, CASE WHEN l_orderkey%2=0 THEN 'Trade' ELSE 'Post' END, '' FROM lineitem""")
def _(t):
    return M.attributes_table(objects(t), ["l_orderkey"])


@query("render_object", f"""
WITH a AS (SELECT l_orderkey, string_agg('L'||l_linenumber||' ('||{TYPE}||')'||CASE WHEN l_orderkey%2=1 THEN ' — «Line '||l_linenumber||'»' ELSE '' END, '; ' ORDER BY l_linenumber) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'Документ.Order'||l_orderkey||CASE WHEN l_orderkey%2=1 THEN ' — «No '||l_orderkey||'»' ELSE chr(10)||'Комментарий: c '||l_orderkey END||chr(10)||replace({REGISTERS}, ' | ', chr(10))
  ||chr(10)||'Реквизиты: '||s||chr(10)||CASE WHEN l_orderkey%2=0 THEN 'Подсистемы: Trade'||chr(10)||'Табличная часть Lines: '||s ELSE 'Операции: Post' END||chr(10)||'Формы: Main'
  ||CASE WHEN l_orderkey%2=0 THEN chr(10)||'Команды: Run' ELSE '' END AS text FROM a""")
def _(t):
    return objects(t).select("l_orderkey", M.render_object(F.concat(F.lit("Документ."), "name")).alias("text"))


@query("table_of_values", """
SELECT c_custkey//50 AS part_no, NULL AS error, c_custkey::VARCHAR AS "Id", CASE WHEN c_custkey%4=0 THEN '' ELSE c_name END AS "Name", c_mktsegment AS "Post" FROM customer WHERE (c_custkey//50)%5 NOT IN (3, 4)
UNION ALL SELECT DISTINCT c_custkey//50, CASE (c_custkey//50)%5 WHEN 3 THEN 'ResultCode=DENIED' ELSE 'SOAP fault: no access' END, '', '', '' FROM customer WHERE (c_custkey//50)%5 IN (3, 4)""")
def _(t):
    row = F.concat(F.lit("<row><Value>"), F.col("c_custkey").cast("string"), F.lit("</Value>"), F.when(F.col("c_custkey") % 4 == 0, "<Value/>").otherwise(
        F.concat(F.lit("<Value>"), "c_name", F.lit("</Value>"))), F.lit("<Value>"), "c_mktsegment", F.lit("</Value></row>"))
    per = t.customer.groupBy(F.floor(F.col("c_custkey") / 50).alias("part_no")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    head = "".join(f"<column><Name>{n}</Name></column>" for n in ("Id", "Name", "Post"))
    code = F.when(F.col("part_no") % 5 == 3, "DENIED").otherwise("SUCCESS")
    good = F.concat(F.lit('<s:Envelope xmlns:s="http://x"><s:Body><Answer><Property name="ResultCode"><Value>'), code, F.lit('</Value></Property><Property name="Data"><Value>' + head), "rows",
                    F.lit("</Value></Property></Answer></s:Body></s:Envelope>"))
    fault = F.lit('<s:Envelope xmlns:s="http://x"><s:Body><s:Fault><faultstring xml:lang="ru"> no access </faultstring></s:Fault></s:Body></s:Envelope>')
    return M.table_of_values(per.select("part_no", F.when(F.col("part_no") % 5 == 4, fault).otherwise(good).alias("xml")), ["part_no"], "xml", ["Id", "Name", "Post"])


TREE_SQL = """WITH RECURSIVE edges AS (SELECT 'r'||r_regionkey AS node, NULL AS parent, r_name AS name FROM region
 UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey, n_name FROM nation UNION ALL SELECT 'c'||c_custkey, 'n'||c_nationkey, c_name FROM customer),
tree AS (SELECT node, name, name AS path, 0 AS depth FROM edges WHERE parent IS NULL
 UNION ALL SELECT e.node, e.name, t.path||'.'||e.name, t.depth+1 FROM tree t JOIN edges e ON e.parent = t.node)"""


def tree(t):
    edges = (t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
             .unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
             .unionByName(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"))))
    return M.subsystem_tree(edges)


@query("subsystem_tree", TREE_SQL + " SELECT * FROM tree")
def _(t):
    return tree(t)


@query("find_by_full_name", TREE_SQL + " SELECT * FROM tree WHERE path = (SELECT min(path) FROM tree WHERE depth=2)")
def _(t):
    whole = tree(t)
    first = whole.filter("depth = 2").agg(F.min("path")).first()[0]
    return M.find_by_full_name(whole, first.upper())


@query("ambiguous_names", """SELECT p_name, p_partkey AS full_name, count(*) OVER (PARTITION BY p_name) AS bearers FROM part QUALIFY count(*) OVER (PARTITION BY p_name) > 1""")
def _(t):
    return M.ambiguous_names(t.part.select("p_name", F.col("p_partkey").alias("full_name")), "p_name", "full_name")


@query("containing", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem JOIN part ON p_partkey=l_partkey WHERE p_type='PROMO'")
def _(t):
    return M.containing(t.lineitem, t.part.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey")), "l_suppkey", "l_partkey")


@query("unassigned_objects", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    content = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return M.unassigned_objects(t.part.select("p_partkey"), content, "p_partkey")


def counted(t):
    failing = t.part.filter("p_size > 49").select("p_type").distinct()
    return M.object_counts(t.part.filter("p_type <> 'SMALL' or p_size < 60"), "p_type", "p_name", failing.filter("p_type in ('PROMO','LARGE')"))


@query("object_counts", "SELECT p_type, count(DISTINCT p_name) AS names FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 49 AND p_type IN ('PROMO','LARGE')) GROUP BY 1")
def _(t):
    return counted(t)[0]


@query("object_names", "SELECT DISTINCT p_type, p_name FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 49 AND p_type IN ('PROMO','LARGE'))")
def _(t):
    failing = t.part.filter("p_size > 49").select("p_type").distinct()
    return M.object_names(t.part, "p_type", "p_name", failing.filter("p_type in ('PROMO','LARGE')"))


@query("warnings", "SELECT DISTINCT p_type, 'could not be read: '||p_type AS message FROM part WHERE p_size > 49 AND p_type IN ('PROMO','LARGE')")
def _(t):
    return counted(t)[1]


@query("base_kinds", """SELECT count(*) AS bases, count(*) FILTER (s_nationkey%3=0) AS toolkit, count(*) FILTER (s_nationkey%3=1) AS extension,
 count(*) FILTER (s_nationkey%3=2) AS other, count(*) FILTER (s_acctbal < 0) AS writable FROM supplier""")
def _(t):
    k = F.col("s_nationkey") % 3
    return t.supplier.agg(F.count("*").alias("bases"), F.count_if(k == 0).alias("toolkit"), F.count_if(k == 1).alias("extension"),
                          F.count_if(k == 2).alias("other"), F.count_if(F.col("s_acctbal") < 0).alias("writable"))
