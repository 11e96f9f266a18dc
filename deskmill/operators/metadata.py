"""Objects and their structure: parsing of descriptions, rendering, trees, membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.functions.values import shown_type
from deskmill.session import materialise

# Shown names of attribute groups, by tag in either layout.
GROUPS = [line.split(maxsplit=2) for line in """
Attribute attributes Реквизиты
Dimension dimensions Измерения
Resource resources Ресурсы
EnumValue enumValues Значения
AccountingFlag accountingFlags Признаки учета
ExtDimensionAccountingFlag extDimensionAccountingFlags Признаки учета субконто
AddressingAttribute addressingAttributes Реквизиты адресации
Column columns Графы
Operation operations Операции
URLTemplate urlTemplates Шаблоны URL
Subsystem subsystems Подсистемы
""".strip().split("\n")]

# Shown names of further properties, by tag in either layout.
EXTRAS = [line.split(maxsplit=2) for line in """
MethodName methodName Метод
Handler handler Обработчик
Event event Событие
Type type Тип
RegisterRecords registerRecords Движения по регистрам
Source source Источники
""".strip().split("\n")]

# a text in place of sub-elements is read into _VALUE; parts are read with the properties that are shown of them only
_SHOWN = "Name:string, Type:struct<Type:array<string>>, Synonym:struct<item:array<struct<content:string>>>"
_PROPS = (f"Properties:struct<{_SHOWN}, Comment:string, MethodName:string, Handler:string, Event:string, RegisterRecords:struct<Item:array<struct<_VALUE:string>>, Type:array<string>>, "
          "Source:struct<Item:array<struct<_VALUE:string>>, Type:array<string>>>")
_ITEM = f"array<struct<Properties:struct<{_SHOWN}>, _VALUE:string>>"
_NAMED = "array<struct<Properties:struct<Name:string>, _VALUE:string>>"
FLAT_SCHEMA = (f"Object struct<{_PROPS}, ChildObjects:struct<"
               + ", ".join(f"{tag}:{_ITEM}" for tag, _, _ in GROUPS)
               + f", TabularSection:array<struct<Properties:struct<{_SHOWN}>, ChildObjects:struct<Attribute:{_ITEM}>>>"
               + f", Form:{_NAMED}, Command:{_NAMED}, Template:{_NAMED}>>")
_PART = "array<struct<name:string, type:struct<types:array<string>>, synonym:array<struct<value:string>>, _VALUE:string>>"
_REFS = "array<struct<types:array<string>, _VALUE:string>>"
NESTED_SCHEMA = ("name string, synonym array<struct<value:string>>, comment string, " + ", ".join(f"{tag} {_PART}" for _, tag, _ in GROUPS)
                 + ", tabularSections array<struct<name:string, synonym:array<struct<value:string>>, attributes:" + _PART + ">>"
                 + ", forms array<struct<name:string, _VALUE:string>>, commands array<struct<name:string, _VALUE:string>>, templates array<struct<name:string, _VALUE:string>>"
                 + f", methodName string, handler string, event string, type struct<types:array<string>>, registerRecords {_REFS}, source {_REFS}")
OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def _types(col: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(F.coalesce(col, F.expr("cast(array() as array<string>)")), shown_type), lambda x: x != "")), ", ")


def _text(col: Column) -> Column:
    return F.coalesce(F.trim(col), F.lit(""))


def _attributes(items: Column, group: str, get) -> Column:
    none = F.expr("cast(array() as array<struct<`group`:string,name:string,type:string,synonym:string>>)")
    return F.coalesce(F.transform(items, lambda x: F.struct(F.lit(group).alias("group"), *[c.alias(n) for n, c in zip(("name", "type", "synonym"), get(x))])), none)


def _name_or_text(name: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(_text(name), F.lit("")), _text(text))


def _extras(values: list[Column]) -> Column:
    """The further properties that are there, as (label, value)."""
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(v, F.lit("")).alias("value")) for (_, _, label), v in zip(EXTRAS, values)])
    return F.filter(pairs, lambda p: p["value"] != "")


def _flat(x):
    p = x["Properties"]
    return _name_or_text(p["Name"], x["_VALUE"]), _types(p["Type"]["Type"]), _text(F.get(p["Synonym"]["item"], F.lit(0))["content"])


def _nested(x):
    return _name_or_text(x["name"], x["_VALUE"]), _types(x["type"]["types"]), _text(F.get(x["synonym"], F.lit(0))["value"])


def object_structure(files: DataFrame, keep: list[str], xml: str, nested: Column) -> DataFrame:
    """One record per description in either layout: name, synonym, comment, attributes, tabular parts, forms, commands,
    templates and further properties (registers, sources, method, handler, event, own type).

    ``nested`` tells the second layout. A description without a name gives no record.
    """
    # the first layout names the element after the object's kind; it is given one name
    root = r"(?s)(<(?:\w+:)?MetaDataObject[^>]*>\s*<)(?:\w+:)?(\w+)(.*)</(?:\w+:)?\2(\s*>\s*</(?:\w+:)?MetaDataObject>)"
    one = F.regexp_replace(F.col(xml), root, "$1Object$3</Object$4")
    # exploding a one-element array keeps the parser from running once per field
    flat = files.filter(~nested).select(*keep, F.explode(F.array(F.from_xml(one, FLAT_SCHEMA, OPTIONS)["Object"])).alias("o"))
    child = F.col("o.ChildObjects")
    tab = "cast(array() as array<struct<name:string,synonym:string,columns:array<struct<`group`:string,name:string,type:string,synonym:string>>>>)"
    names = "cast(array() as array<string>)"
    first = flat.select(
        *keep, _text(F.col("o.Properties.Name")).alias("name"), _text(F.get("o.Properties.Synonym.item", F.lit(0))["content"]).alias("synonym"),
        _text(F.col("o.Properties.Comment")).alias("comment"),
        F.concat(*[_attributes(child[tag], shown, _flat) for tag, _, shown in GROUPS]).alias("attributes"),
        F.coalesce(F.transform(child["TabularSection"], lambda s: F.struct(
            _text(s["Properties"]["Name"]).alias("name"), _text(F.get(s["Properties"]["Synonym"]["item"], F.lit(0))["content"]).alias("synonym"),
            _attributes(s["ChildObjects"]["Attribute"], "Реквизиты", _flat).alias("columns"))), F.expr(tab)).alias("tabular"),
        *[F.coalesce(F.transform(child[tag], lambda x: _name_or_text(x["Properties"]["Name"], x["_VALUE"])), F.expr(names)).alias(out)
          for tag, out in (("Form", "forms"), ("Command", "commands"), ("Template", "templates"))],
        _extras([_text(F.col(f"o.Properties.{n}")) for n in ("MethodName", "Handler", "Event")] + [_types(F.col("o.Properties.Type.Type"))]
                + [_types(F.concat(F.coalesce(F.transform(F.col(f"o.Properties.{n}.Item"), lambda x: x["_VALUE"]), F.expr(names)),
                                   F.coalesce(F.col(f"o.Properties.{n}.Type"), F.expr(names)))) for n in ("RegisterRecords", "Source")]).alias("extra"))
    other = files.filter(nested).select(*keep, F.explode(F.array(F.from_xml(F.col(xml), NESTED_SCHEMA, OPTIONS))).alias("o"))
    second = other.select(
        *keep, _text(F.col("o.name")).alias("name"), _text(F.get("o.synonym", F.lit(0))["value"]).alias("synonym"), _text(F.col("o.comment")).alias("comment"),
        F.concat(*[_attributes(F.col(f"o.{tag}"), shown, _nested) for _, tag, shown in GROUPS]).alias("attributes"),
        F.coalesce(F.transform("o.tabularSections", lambda s: F.struct(
            _text(s["name"]).alias("name"), _text(F.get(s["synonym"], F.lit(0))["value"]).alias("synonym"),
            _attributes(s["attributes"], "Реквизиты", _nested).alias("columns"))), F.expr(tab)).alias("tabular"),
        *[F.coalesce(F.transform(F.col(f"o.{tag}"), lambda x: _name_or_text(x["name"], x["_VALUE"])), F.expr(names)).alias(tag) for tag in ("forms", "commands", "templates")],
        _extras([_text(F.col(f"o.{n}")) for n in ("methodName", "handler", "event")] + [_types(F.col("o.type.types"))]
                + [_types(F.flatten(F.transform(F.col(f"o.{n}"), lambda x: F.coalesce(x["types"], F.array(x["_VALUE"]))))) for n in ("registerRecords", "source")]).alias("extra"))
    return first.unionByName(second).filter("name <> ''")


def attributes_table(objects: DataFrame, keep: list[str]) -> DataFrame:
    """(…, section, group, name, type): attributes of the object and of its tabular parts, one per row.

    Both lists are put together in the row, so that a description is read once.
    """
    none = F.expr("cast(array() as array<struct<section:string,`group`:string,name:string,type:string>>)")

    def listed(items, section):
        return F.coalesce(F.transform(items, lambda a: F.struct(section.alias("section"), a["group"].alias("group"), a["name"].alias("name"), a["type"].alias("type"))), none)

    parts = F.coalesce(F.flatten(F.transform("tabular", lambda t: listed(t["columns"], t["name"]))), none)
    return objects.select(*keep, F.inline(F.concat(listed(F.col("attributes"), F.lit("")), parts)))


def _shown(a):
    tail = F.when((a["synonym"] != "") & (F.lower(F.replace(a["synonym"], F.lit(" "), F.lit(""))) != F.lower(a["name"])),
                  F.concat(F.lit(" — «"), a["synonym"], F.lit("»"))).otherwise("")
    return F.concat(a["name"], F.when(a["type"] != "", F.concat(F.lit(" ("), a["type"], F.lit(")"))).otherwise(""), tail)


def render_object(full_name: Column) -> Column:
    """The record as text lines; a synonym is shown only if it says more than the name."""
    def listed(items):
        return F.array_join(F.transform(F.filter(items, lambda a: a["name"] != ""), _shown), "; ")

    head = F.concat(full_name, F.when(F.col("synonym") != "", F.concat(F.lit(" — «"), "synonym", F.lit("»"))).otherwise(""))
    lines = [F.array(head), F.when(F.col("comment") != "", F.array(F.concat(F.lit("Комментарий: "), "comment"))),
             F.transform("extra", lambda e: F.concat(e["label"], F.lit(": "), e["value"]))]
    for shown in dict.fromkeys(g[2] for g in GROUPS):
        items = _of_group(shown)
        lines.append(F.when(F.size(items) > 0, F.array(F.concat(F.lit(f"{shown}: "), listed(items)))))
    lines.append(F.transform("tabular", lambda t: F.concat(
        F.lit("Табличная часть "), t["name"], F.when(t["synonym"] != "", F.concat(F.lit(" («"), t["synonym"], F.lit("»)"))).otherwise(""), F.lit(": "), listed(t["columns"]))))
    for col, label in (("forms", "Формы"), ("commands", "Команды"), ("templates", "Макеты")):
        lines.append(F.when(F.size(col) > 0, F.array(F.concat(F.lit(f"{label}: "), F.array_join(F.filter(col, lambda x: x != ""), ", ")))))
    none = F.expr("cast(array() as array<string>)")
    return F.array_join(F.concat(*[F.coalesce(x, none) for x in lines]), "\n")


def _of_group(shown: str) -> Column:
    return F.filter("attributes", lambda a: a["group"] == shown)


def object_blocks(files: DataFrame, keep: list[str], xml: str, nested: Column, object_type: Column) -> DataFrame:
    """Descriptions as blocks of kind ``object`` for code search: name and synonym are the block's name, the rendered record is its body.

    Lines are those of the description's file. A description without a name gives no block.
    """
    lines = F.size(F.split(F.regexp_replace(xml, r"\n\z", ""), "\n"))
    records = object_structure(files.withColumn("line_end", lines).withColumn("_type", object_type), [*keep, "line_end", "_type"], xml, nested)
    return records.select(*keep, F.lit("object").alias("kind"), F.concat_ws(" ", "name", F.nullif(F.col("synonym"), F.lit(""))).alias("name"),
                          F.lit(False).alias("is_export"), F.lit(1).alias("line_start"), "line_end",
                          render_object(F.concat_ws(".", "_type", "name")).alias("body"), F.lit("").alias("doc"))


# Where an answer says how it went.
RESULT_CODE = r"(?s)<(?:\w+:)?Property\b[^>]*\bname=[\"']ResultCode[\"'][^>]*>\s*<(?:\w+:)?Value[^>]*>([^<]*)<"
FAULT = r"(?s)<(?:\w+:)?faultstring[^>]*>([^<]*)<"


def table_of_values(results: DataFrame, keep: list[str], xml: str, names: list[str]) -> DataFrame:
    """Rows of a result with named columns and positional cells, at any depth of the answer; empty cells keep their place.

    A fault, or a result code that is not SUCCESS, gives one row with ``error`` set.
    """
    code, fault = F.trim(F.regexp_extract(xml, RESULT_CODE, 1)), F.trim(F.regexp_extract(xml, FAULT, 1))
    error = (F.when(F.col(xml).rlike(FAULT), F.concat(F.lit("SOAP fault: "), F.substring(fault, 1, 300)))
             .when(~code.isin("", "SUCCESS"), F.concat(F.lit("ResultCode="), code)))
    # columns and rows are taken out of their surroundings; an empty cell gets a mark, since the parser would take it for a missing one
    parts = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<(?:\w+:)?(column|row)\b.*?</(?:\w+:)?\2\s*>)"), F.lit(1))
    bare = F.regexp_replace(F.concat(F.lit("<R>"), F.array_join(parts, ""), F.lit("</R>")), r"(</?)\w+:", "$1")
    filled = F.regexp_replace(bare, r"<Value\s*/>|<Value>\s*</Value>", "<Value>\ue000</Value>")
    parsed = results.select(*keep, error.alias("error"), F.explode(F.array(F.from_xml(
        filled, "column array<struct<Name:string>>, row array<struct<Value:array<string>>>", OPTIONS))).alias("x"))
    rows = parsed.select(*keep, F.transform("x.column", lambda c: F.trim(c["Name"])).alias("_names"), "error",
                         F.explode_outer(F.when(F.col("error").isNull(), F.col("x.row"))).alias("_row"))
    cells = [F.coalesce(F.nullif(F.trim(F.try_element_at("_row.Value", F.nullif(F.array_position("_names", F.lit(n)), F.lit(0)).cast("int"))), F.lit("\ue000")), F.lit("")).alias(n) for n in names]
    return rows.select(*keep, "error", *cells)


def subsystem_tree(edges: DataFrame) -> DataFrame:
    """(node, name, path, depth) for edges (node, parent, name), any depth: one join per level, each level written out.

    A node that would lie below itself is not followed further, so a cycle ends the walk instead of keeping it up.
    """
    top = edges.filter("parent IS NULL").select("node", "name", F.col("name").alias("path"), F.lit(0).alias("depth"), F.array("node").alias("_line"))
    levels = [materialise(top, "level")]
    while True:
        above = levels[-1].select(F.col("node").alias("parent"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), "_line")
        below = edges.join(above, "parent").filter(~F.array_contains("_line", F.col("node"))).select(
            "node", "name", F.concat_ws(".", "_path", "name").alias("path"), (F.col("_depth") + 1).alias("depth"),
            F.array_append("_line", F.col("node")).alias("_line"))
        level = materialise(below, "level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("_line")


def find_by_full_name(tree: DataFrame, path: str) -> DataFrame:
    return tree.filter(F.lower("path") == path.lower())


def ambiguous_names(objects: DataFrame, name: str, full: str) -> DataFrame:
    """(name, full name) of all objects whose short name is not unique, one row each."""
    many = objects.groupBy(name).agg(F.count("*").alias("bearers")).filter("bearers > 1")
    return objects.join(many, name).select(name, full, "bearers")


def containing(content: DataFrame, objects: DataFrame, group: str, obj: str) -> DataFrame:
    return content.select(group, obj).distinct().join(objects.select(obj).distinct(), obj, "left_semi")


def unassigned_objects(objects: DataFrame, content: DataFrame, obj: str) -> DataFrame:
    return objects.join(content.select(obj).distinct(), obj, "left_anti")


def object_names(objects: DataFrame, kind: str, name: str, failing: DataFrame) -> DataFrame:
    """(kind, name) of the collections that could be read, each name once, in order. Rows, not an array: a collection has any size."""
    good = objects.join(failing.select(kind), kind, "left_anti")
    return good.select(kind, name).distinct().orderBy(kind, name)


def object_counts(objects: DataFrame, kind: str, name: str, failing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, names) of the collections that could be read, and the warnings (kind, message) for the others."""
    good = objects.join(failing.select(kind), kind, "left_anti")
    counts = good.select(kind, name).distinct().groupBy(kind).agg(F.count("*").alias("names"))
    warnings = failing.select(kind, F.concat(F.lit("could not be read: "), kind).alias("message"))
    return counts, warnings
