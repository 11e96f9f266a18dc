"""Documents to chunks, modules to blocks. All of it happens inside the row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.functions.text import bind, chunk_text, strip

# How a procedure starts and ends, and what its header ends with.
NAME = r"[A-Za-zА-Яа-яЁё_][0-9A-Za-zА-Яа-яЁё_]*"
START = rf"(?iu)^[ \t]*(?:(?:Асинх|Async)[ \t]+)?(Процедура|Функция|Procedure|Function)[ \t]+({NAME})[ \t]*\("
END = r"(?iu)^[ \t]*(?:КонецПроцедуры|КонецФункции|EndProcedure|EndFunction)(?![0-9A-Za-zА-Яа-яЁё_])"
HEADER_END = r"(?iu)\)[ \t]*(Экспорт|Export)?[ \t]*;?[ \t]*(//.*)?$"
FUNCTION_WORDS = ["функция", "function"]
HEADER_LINES = 60


def kb_chunks(docs: DataFrame, keep: list[str], text: str = "text", target: int = 1200, hard: int = 2000) -> DataFrame:
    return docs.select(*keep, F.posexplode(chunk_text(F.col(text), target, hard)).alias("chunk_no", "text"))


def _spans(lines: Column, start: str, end: str, above: str) -> Column:
    """array<struct(first, head, last)> of 0-based line numbers of the blocks, by one fold over the lines.

    A block is the run of ``above`` lines directly before a start line, and all up to the
    end line; without end line it goes to the last non-blank line before the next start.
    """
    span = "struct<first:int,head:int,last:int>"
    state = F.struct(F.expr(f"cast(array() as array<{span}>)").alias("out"), F.lit(-1).alias("first"), F.lit(-1).alias("head"),
                     F.lit(-1).alias("run"), F.lit(-1).alias("full"))

    def closed(s, last):
        return F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), s["head"].alias("head"), last.alias("last")).cast(span)))

    def step(s, x):
        is_open = s["head"] >= 0
        starts, ends, blank, note = x["starts"], x["ends"], x["blank"], x["note"]
        shut = is_open & ends
        cut = is_open & ~ends & starts
        opens = starts & ~shut
        return F.struct(
            F.when(shut, closed(s, x["i"])).when(cut, closed(s, s["full"])).otherwise(s["out"]).alias("out"),
            F.when(opens, F.when(~is_open & (s["run"] >= 0), s["run"]).otherwise(x["i"])).when(shut, -1).otherwise(s["first"]).alias("first"),
            F.when(opens, x["i"]).when(shut, -1).otherwise(s["head"]).alias("head"),
            F.when(note & ~is_open, F.when(s["run"] >= 0, s["run"]).otherwise(x["i"])).otherwise(-1).alias("run"),
            F.when(blank, s["full"]).otherwise(x["i"]).alias("full"))

    def finish(s):
        return F.when(s["head"] >= 0, closed(s, s["full"])).otherwise(s["out"])

    flags = F.transform(lines, lambda line, i: F.struct(
        i.alias("i"), line.rlike(start).alias("starts"), line.rlike(end).alias("ends"),
        (strip(line) == "").alias("blank"), line.rlike(above).alias("note")))
    return F.aggregate(flags, state, step, finish)


def segment_blocks(files: DataFrame, keep: list[str], text: str, start: str = START, end: str = END,
                   above: str = r"^\s*(//|&)", idle: str = r"^\s*(//|#|$)") -> DataFrame:
    """Blocks of each text with kind, name, export flag, description and 1-based line range.

    What lies between blocks is a ``module`` block if a line of it means something;
    a text without start lines is one ``module`` block.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n")
    def pieces_of(lines, spans):
        # a mark behind the last line lets every gap be written as what precedes a span
        n = F.size(lines)
        fence = F.struct(n.alias("first"), n.alias("head"), (n - 1).alias("last"))
        pairs = F.flatten(F.transform(F.concat(spans, F.array(fence)), lambda s, i: F.array(
            F.struct(F.lit(False).alias("is_block"), F.when(i > 0, F.get(spans, i - 1)["last"] + 1).otherwise(0).alias("a"),
                     F.lit(0).alias("h"), (s["first"] - 1).alias("b")),
            F.struct(F.lit(True).alias("is_block"), s["first"].alias("a"), (s["head"] - s["first"]).alias("h"), s["last"].alias("b")))))
        # each piece takes its own lines along, so that exploding does not repeat the whole text
        return F.transform(F.filter(pairs, lambda p: p["a"] <= p["b"]), lambda p: F.struct(
            p["is_block"].alias("is_block"), p["a"].alias("a"), p["h"].alias("h"), p["b"].alias("b"), (F.size(spans) == 0).alias("alone"),
            F.slice(lines, p["a"] + 1, p["b"] - p["a"] + 1).alias("body")))

    pieces = bind(lines, lambda ls: bind(_spans(ls, start, end, above), lambda spans: pieces_of(ls, spans)))
    each = files.select(*keep, F.explode(pieces).alias("_p")).withColumn("_body", F.col("_p.body")).withColumn("_alone", F.col("_p.alone"))
    whole = F.col("_p.is_block") | F.col("_alone")
    # gaps lose blank lines on both ends
    full = F.filter(F.transform("_body", lambda line, i: F.when(strip(line) != "", i)), lambda i: i.isNotNull())
    each = (each.withColumn("_lo", F.when(whole, 0).otherwise(F.coalesce(F.array_min(full), F.lit(0))))
            .withColumn("_hi", F.when(whole, F.size("_body") - 1).otherwise(F.coalesce(F.array_max(full), F.lit(-1))))
            .filter(F.col("_p.is_block") | F.when(F.col("_alone"), F.exists("_body", lambda line: strip(line) != ""))
                    .otherwise(F.exists("_body", lambda line: ~line.rlike(idle)))))
    header = F.get("_body", F.col("_p.h"))
    kind = (F.when(~F.col("_p.is_block"), "module")
            .when(F.lower(F.regexp_extract(header, start, 1)).isin(FUNCTION_WORDS), "func").otherwise("proc"))
    # the first line that ends the header tells whether the block is exported
    head = F.filter(F.slice("_body", F.col("_p.h") + 1, HEADER_LINES), lambda line: line.rlike(HEADER_END))
    notes = F.filter(F.slice("_body", 1, F.col("_p.h")), lambda line: line.rlike(r"^\s*//"))
    doc = strip(F.regexp_replace(F.array_join(F.transform(notes, lambda line: F.regexp_replace(line, r"^\s*/+", "")), " "), r"\s+", " "))
    return each.select(
        *keep, kind.alias("kind"),
        F.when(F.col("_p.is_block"), F.regexp_extract(header, start, 2)).otherwise("").alias("name"),
        F.when(F.col("_p.is_block"), F.coalesce(F.regexp_extract(F.get(head, F.lit(0)), HEADER_END, 1) != "", F.lit(False)))
        .otherwise(False).alias("is_export"),
        (F.col("_p.a") + F.col("_lo") + 1).alias("line_start"), (F.col("_p.a") + F.col("_hi") + 1).alias("line_end"),
        F.array_join(F.slice("_body", F.col("_lo") + 1, F.col("_hi") - F.col("_lo") + 1), "\n").alias("body"),
        F.when(F.col("_p.is_block"), doc).otherwise("").alias("doc"))


def toc(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """Table of contents lines of a module's procedures."""
    line = F.format_string("%d-%d: %s %s%s", "line_start", "line_end", F.when(F.col("kind") == "func", "Функция").otherwise("Процедура"),
                           "name", F.when(F.col("is_export"), " Экспорт").otherwise(""))
    return blocks.filter(F.col("kind").isin("proc", "func")).select(*keep, "line_start", line.alias("entry"))


def hit_link(repo: Column, path: Column, first: Column, last: Column) -> Column:
    return F.concat(F.concat_ws("/", repo, path), F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))


def hit_title(object_type: Column, object_name: Column, module_kind: Column, sub_name: Column, kind: Column,
              name: Column, is_export: Column) -> Column:
    """Readable title: owner, module, what it is."""
    owner = F.when(object_name != "", F.concat(object_type, F.lit("."), object_name)).otherwise(object_type)
    module = F.when(sub_name != "", F.concat(module_kind, F.lit(" "), sub_name)).otherwise(module_kind)
    named = F.concat(F.lit(" "), name, F.when(is_export, " (Экспорт)").otherwise(""))
    what = (F.when(kind == "proc", F.concat(F.lit("Процедура"), named)).when(kind == "func", F.concat(F.lit("Функция"), named))
            .when(kind == "object", "структура объекта").otherwise("код вне процедур"))
    return F.array_join(F.filter(F.array(owner, module, what), lambda p: p != ""), " · ")
