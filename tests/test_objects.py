"""Object descriptions in code search, contents lines, object names, health of indexes, exports of a query."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from deskmill.operators import access as A
from deskmill.operators import code_search as C
from deskmill.operators import corpus as K
from deskmill.operators import metadata as M
from deskmill.session import workspace

FLAT = """<MetaDataObject xmlns="http://x/md" xmlns:v8="http://x/v8"><Document uuid="u"><Properties><Name>Order</Name>
<Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>Sales order</v8:content></v8:item></Synonym></Properties>
<ChildObjects><Attribute><Properties><Name>Customer</Name><Type><v8:Type>xs:decimal</v8:Type></Type></Properties></Attribute></ChildObjects></Document></MetaDataObject>
"""
NESTED = '<mdclass:Catalog xmlns:mdclass="http://x/m"><name>Goods</name></mdclass:Catalog>'


def blocks_of_objects(spark):
    files = spark.createDataFrame([(1, FLAT, False, "Документ"), (2, NESTED, True, "Справочник"), (3, "", False, "Документ"), (4, "<a/>", False, "Документ"),
                                   (5, None, False, "Документ")], "file_id long, xml string, nested boolean, type string")
    return M.object_blocks(files, ["file_id"], "xml", F.col("nested"), F.col("type"))


def test_descriptions_become_blocks(spark):
    got = {r.file_id: r for r in blocks_of_objects(spark).collect()}
    assert set(got) == {1, 2}
    assert (got[1].kind, got[1].name, got[1].line_start, got[1].line_end) == ("object", "Order Sales order", 1, 3)
    assert got[1].body == "Документ.Order — «Sales order»\nРеквизиты: Customer (Число)"
    assert (got[2].name, got[2].line_end, got[2].body) == ("Goods", 1, "Справочник.Goods")


def test_attributes_are_listed_from_one_reading(spark):
    """Each layout's descriptions are parsed once, and the rows are those of both lists; missing lists give no rows."""
    text = FLAT.replace("</ChildObjects>", "<TabularSection><Properties><Name>Lines</Name></Properties><ChildObjects><Attribute><Properties><Name>Sum</Name></Properties></Attribute>"
                        "</ChildObjects></TabularSection><TabularSection><Properties><Name>None</Name></Properties></TabularSection></ChildObjects>")
    files = spark.createDataFrame([(1, text, False), (1, text, False), (2, NESTED, True), (3, None, False), (None, text, False)], "file_id long, xml string, nested boolean")
    objects = M.object_structure(files, ["file_id"], "xml", F.col("nested"))
    got = M.attributes_table(objects, ["file_id"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Generate explode(") == 2
    want = [(k, s, "Реквизиты", n, t) for k in (1, 1, None) for s, n, t in (("", "Customer", "Число"), ("Lines", "Sum", ""))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.columns == ["file_id", "section", "group", "name", "type"]
    bare = objects.filter("file_id = 1").withColumn("attributes", F.expr("if(true, null, attributes)")).withColumn("tabular", F.expr("if(true, null, tabular)"))
    assert M.attributes_table(bare, ["file_id"]).count() == 0


def test_a_question_about_structure_raises_the_description(spark):
    code = [(10, 1, 3, "proc", "Sum", False, "Procedure Sum()\ncustomer\nEndProcedure", "")]
    code += [(20 + i, 1, 2, "module", "", False, f"other{i} text", "") for i in range(8)]
    modules = spark.createDataFrame(code, "file_id long, line_start int, line_end int, kind string, name string, is_export boolean, body string, doc string")
    blocks = modules.unionByName(blocks_of_objects(spark)).withColumns({
        "path": F.lit("p"), "object_name": F.when(F.col("kind") == "object", "Order").otherwise(""),
        "proc_name": F.when(F.col("kind") == "proc", F.col("name")).otherwise("")})
    index = C.build_gram_index(blocks)

    def scores(structure):
        asked = spark.createDataFrame([(1, "attributes of customer")], "question_id long, text string")
        return {r.file_id: r.score for r in C.lexical_search(index, asked, 5, structure=structure).collect()}

    asked, not_asked = scores(["attributes"]), scores(["nothing"])
    assert set(asked) == set(not_asked) == {1, 10} and asked[10] == not_asked[10]
    assert abs(asked[1] / not_asked[1] - 2.5 / 0.6) < 0.01


def test_object_snippets_are_first_lines(spark):
    found = spark.createDataFrame([(1, 1, "object", "one\ntwo\n" + "x" * 900)], "question_id long, line_start int, kind string, body string")
    terms = spark.createDataFrame([(1, ["two"])], "question_id long, variants array<string>")
    assert C.snippet_lines(found, terms).first().lines == ["one", "two", "x" * 480]


def test_near_names_next_to_all_pairs(spark):
    rnd = random.Random(3)
    lines = [(g, "".join(rnd.choice("abcД: ") for _ in range(rnd.randrange(0, 9))), i) for g in range(4) for i in range(40)]
    asked = [(100 * g + k, g, r) for g in range(5) for k, r in enumerate(["a", "AB", "abc", "дa", "zz", "", "abcabcabc", "c: "])]
    names = spark.createDataFrame(lines, "g int, name string, name_order int")
    got = {}
    for r in C.near_names(names, spark.createDataFrame(asked, "request_id int, g int, request string"), "g", 15).collect():
        got.setdefault(r.request_id, {})[r.rank] = r.name
    for key, g, request in asked:
        own = [n for h, n, _ in lines if h == g]
        want = ([n for n in own if request and request.lower() in n.lower()] or own)[:15]
        assert [n for _, n in sorted(got.get(key, {}).items())] == want, (g, request)


def test_health_of_indexes(spark):
    rows = K.index_health(spark, {"full": lambda: spark.range(3), "none": lambda: spark.range(0), "lost": lambda: spark.read.parquet(workspace(spark, "lost")),
                                  "late": lambda: spark.range(2).select(F.raise_error(F.lit("broken")).alias("x")).filter("x is null")})
    assert [tuple(r) for r in rows.collect()] == [("full", 3, True, "ok"), ("none", 0, False, "empty"), ("lost", None, False, "unreadable"), ("late", None, False, "unreadable")]


def test_object_names_without_failing_kinds(spark):
    objects = spark.createDataFrame([("b", "y"), ("a", "z"), ("a", "x"), ("a", "x"), ("c", "q")], "kind string, name string")
    failing = spark.createDataFrame([("c",)], "kind string")
    assert [tuple(r) for r in M.object_names(objects, "kind", "name", failing).collect()] == [("a", "x"), ("a", "z"), ("b", "y")]


def test_export_of_a_query(spark):
    rows = spark.sql("select id, timestamp_ntz'2024-01-30 00:00:00' + make_dt_interval(0, id * 6) as ts from range(200)")
    text = "SELECT id FROM {rows} WHERE ts BETWEEN :period_start AND :period_end ORDER BY id DESC"
    done = A.export_query(spark, text, {"rows": rows}, dt.date(2024, 1, 31), dt.date(2024, 4, 2), workspace(spark, "x"), cap=60, preview=2)
    assert done.columns == ["id"]
    assert {tuple(r) for r in done.report.collect()} == {("2024-01", 4, False), ("2024-02", 60, True), ("2024-03", 60, True), ("2024-04", 0, False)}
    assert [(r.month, r.row_no, r.id) for r in done.preview.collect()] == [("2024-01", 1, 7), ("2024-01", 2, 6)]
    feb = [r.id for r in done.rows.filter("month = '2024-02'").orderBy("row_no").collect()]
    assert feb == list(range(123, 63, -1))
    for bad, word in ((text.replace(":period_end", ":until"), "parameters"), (text.replace("id FROM", "nothing FROM"), "cannot be run"), ("DELETE " + text, "cannot be run")):
        with pytest.raises(ValueError, match=word):
            A.export_query(spark, bad, {"rows": rows}, dt.date(2024, 1, 1), dt.date(2024, 2, 1), workspace(spark, "x"))


def test_owners_meet_only_modules_that_fit(spark):
    """An owner without type or repo fits any; the join itself makes no row for a module that does not fit."""
    blocks = spark.createDataFrame([("M1", t, r, f"{t}/{r}/{i}", "proc") for t in ("A", None, "") for r in ("x", "y", None) for i in range(5)],
                                   "object_name string, object_type string, repo string, path string, kind string")
    owners = spark.createDataFrame([(i, "m1", t, r) for i, (t, r) in enumerate([("A", "x"), ("A", None), (None, "y"), (None, None), ("", None), ("B", "x")])],
                                   "owner_id int, object_name string, object_type string, repo string")
    found = C.object_modules(owners, blocks)
    want = [(o.owner_id, b.repo, b.path, 1) for o in owners.collect() for b in blocks.collect()
            if o.object_type in (None, b.object_type) and o.repo in (None, b.repo)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert len(want) == 5 * (1 + 3 + 3 + 9 + 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "OR" not in plan.replace("ORDER", "") and " <=> " not in plan


def test_modules_of_objects_need_no_index(spark, monkeypatch):
    """Neither texts nor grams are written for the names of modules."""
    from deskmill.plans import QUERIES
    monkeypatch.setattr(C, "index_grams", None)
    monkeypatch.setattr(C, "with_length", None)
    assert QUERIES["object_modules"](spark, "/root/testdata/sf0.001").count() > 0


def test_line_numbers_alone_are_shuffled_for_descriptions(spark):
    from deskmill.plans.metadata import descriptions

    class Tables:
        lineitem = spark.createDataFrame([(1, 2), (1, 1), (1, 2), (2, None), (2, 3), (4, None)], "l_orderkey long, l_linenumber int")

    rows = {r.l_orderkey: r.xml for r in descriptions(Tables).collect()}
    assert rows[1].count("<name>L2</name>") == 2 and rows[1].index("L1") < rows[1].index("L2")
    assert rows[2].count("<Name>L3</Name>") == 2 and "<Name>L</Name>" not in rows[2] and "<ChildObjects><TabularSection>" in rows[4]
    plan = descriptions(Tables)._jdf.queryExecution().executedPlan().toString()
    assert "Attribute" not in plan.split("Exchange hashpartitioning")[1]
