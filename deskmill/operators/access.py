"""Guarded reads and exports: parameters, caps, months, filters, rights."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.operators.journal import clamp
from deskmill.operators.ordered import newest

# Row limits of guarded reads.
QUERY_DEFAULT, QUERY_CAP, SHOWN_ROWS, MAX_MONTHS = 100, 1000, 200, 60
LOG_DEFAULT, LOG_CAP, LOG_DAYS = 50, 500, 7
GREP_DEFAULT, GREP_CAP = 50, 200
PEOPLE_SHOWN = 40


def check_select(text: str) -> None:
    if not text.lstrip().upper().startswith("SELECT"):
        raise ValueError("only SELECT queries are accepted")


def param_query(spark: SparkSession, text: str, args: dict, tables: dict[str, DataFrame],
                limit: int | None = None) -> DataFrame:
    """A SELECT with bound parameters, at most the cap plus one row (the extra row tells truncation)."""
    check_select(text)
    cap = clamp(limit or QUERY_DEFAULT, 1, QUERY_CAP)
    return spark.sql(text, args=args, **tables).limit(cap + 1)


def validate_query(spark: SparkSession, text: str, args: dict, tables: dict[str, DataFrame]) -> str | None:
    """None when the query can be planned, else the error text. Nothing is run."""
    try:
        check_select(text)
        spark.sql(text, args=args, **tables).schema  # noqa: B018
    except (ValueError, AnalysisException, ParseException) as exc:
        return str(exc).split("\n", 1)[0]
    return None


def capped_result(df: DataFrame, order: list[str], shown: int = SHOWN_ROWS) -> DataFrame:
    """First rows with the total count and whether more exist."""
    total = df.agg(F.count("*").alias("n"))
    return (df.orderBy(*order).limit(shown).withColumn("total_rows", total.scalar())
            .withColumn("truncated", F.col("total_rows") > shown))


def months(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """Calendar months of a range, the first and last cut to it."""
    if end < start:
        raise ValueError("the range ends before it starts")
    out, first = [], start
    while first <= end:
        following = (first.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        out.append((first, min(end, following - dt.timedelta(days=1))))
        first = following
    if len(out) > MAX_MONTHS:
        raise ValueError(f"more than {MAX_MONTHS} months")
    return out


def in_period(df: DataFrame, ts: str, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of whole days start…end; a plain range filter, so it reaches the scan."""
    months(start, end)
    return (df.filter((F.col(ts) >= F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz"))
                      & (F.col(ts) < F.lit(dt.datetime.combine(end + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")))
            .withColumn("month", F.date_format(ts, "yyyy-MM")))


def capped_partitions(df: DataFrame, period: str, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows per period; ``truncated`` marks periods that had more.

    Each map task keeps cap + 1 rows per period, so a hot period does not travel whole.
    """
    first = newest(df, [period], cap + 1, *[F.col(c) for c in order], rank="row_no")
    more = first.filter(F.col("row_no") == cap + 1).select(period, F.lit(True).alias("truncated"))
    return (first.filter(F.col("row_no") <= cap).join(more, period, "left")
            .withColumn("truncated", F.coalesce("truncated", F.lit(False))))


def export_by_month(df: DataFrame, ts: str, start: dt.date, end: dt.date, order: list[str], cap: int, path: str) -> DataFrame:
    """Write the period partitioned by month, and report rows and truncation per month.

    The whole period is one range scan.
    """
    capped = capped_partitions(in_period(df, ts, start, end), "month", order, cap)
    capped.write.mode("overwrite").partitionBy("month").parquet(path)
    spark = df.sparkSession
    written = spark.read.schema(capped.schema).parquet(path)
    spine = spark.createDataFrame([(a.strftime("%Y-%m"), a, b) for a, b in months(start, end)],
                                  "month string, first_day date, last_day date")
    facts = written.groupBy("month").agg(F.count("*").alias("n"), F.bool_or("truncated").alias("truncated"))
    return spine.join(facts, "month", "left").select(
        "month", "first_day", "last_day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


@dataclass
class Export:
    """rows(month, row_no, …) as written, report(month, n, truncated), the first rows, and the query's columns."""

    rows: DataFrame
    report: DataFrame
    preview: DataFrame
    columns: list[str]


PERIOD = ("period_start", "period_end")


def export_query(spark: SparkSession, text: str, tables: dict[str, DataFrame], start: dt.date, end: dt.date, path: str,
                 cap: int = QUERY_CAP, preview: int = 5) -> Export:
    """Run a SELECT once per month of the period and write its rows partitioned by month.

    The query has to use both period parameters, and it has to be plannable; otherwise nothing is run. Months are branches of one
    job. A month gives at most ``cap`` rows in the order of the query; the row behind them tells that there were more.
    """
    lacking = [p for p in PERIOD if not re.search(rf":{p}\b", text)]
    if lacking:
        raise ValueError(f"the query does not use the parameters {lacking}")
    periods = months(start, end)
    args = [dict(zip(PERIOD, (dt.datetime.combine(a, dt.time.min), dt.datetime.combine(b, dt.time.max)))) for a, b in periods]
    problem = validate_query(spark, text, args[0], tables)
    if problem:
        raise ValueError(f"the query cannot be run: {problem}")

    def month(a, values):
        # the limit leaves one task, in which rows are numbered in their order
        found = spark.sql(text, args=values, **tables).limit(cap + 1)
        return found.withColumns({"month": F.lit(a.strftime("%Y-%m")), "row_no": (F.monotonically_increasing_id() % (1 << 33) + 1).cast("int")})

    found = [month(a, values) for (a, _), values in zip(periods, args)]
    reduce(DataFrame.unionByName, found).write.partitionBy("month").parquet(path)
    written = spark.read.schema(found[0].schema).parquet(path)
    rows = written.filter(F.col("row_no") <= cap)
    spine = spark.createDataFrame([(a.strftime("%Y-%m"),) for a, _ in periods], "month string")
    counts = written.groupBy("month").agg(F.count("*").alias("held"))
    held = F.coalesce("held", F.lit(0))
    report = spine.join(counts, "month", "left").select("month", F.least(held, F.lit(cap)).alias("n"), (held > cap).alias("truncated"))
    return Export(rows, report, rows.orderBy("month", "row_no").limit(preview), [c for c in found[0].columns if c not in ("month", "row_no")])


def _must_exist(df: DataFrame, col: str, wanted: list, what: str) -> None:
    found = {r[0] for r in df.filter(F.col(col).isin(wanted)).select(col).distinct().collect()}
    missing = [w for w in wanted if w not in found]
    if missing:
        raise ValueError(f"unknown {what}: {missing}")


def event_log(log: DataFrame, now: dt.datetime, *, start: dt.datetime | None = None, end: dt.datetime | None = None,
              level: str | None = None, levels: list[str] = (), events: str | list[str] | None = None,
              user=None, limit: int | None = None) -> DataFrame:
    """Newest log rows of a period under filters. A filter that cannot apply is an error, never left out."""
    if level is not None and level not in levels:
        raise ValueError(f"unknown level: {level}")
    names = [events] if isinstance(events, str) else list(events or [])
    if names:
        _must_exist(log, "event_type", names, "event")
    if user is not None:
        _must_exist(log, "user_id", [user], "user")
    begin = start or (end or now) - dt.timedelta(days=LOG_DAYS)
    rows = log.filter(F.col("ts") >= F.lit(begin).cast("timestamp_ntz"))
    rows = rows.filter(F.col("ts") <= F.lit(end or now).cast("timestamp_ntz"))
    if level is not None:
        rows = rows.filter(F.col("level") == level)
    if names:
        rows = rows.filter(F.col("event_type").isin(names))
    if user is not None:
        rows = rows.filter(F.col("user_id") == user)
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(clamp(limit or LOG_DEFAULT, 1, LOG_CAP))


def people_search(people: DataFrame, text: str, fields: list[str], order: str, shown: int = PEOPLE_SHOWN) -> DataFrame:
    """People whose fields hold every word of the text, with the total found."""
    hay = F.translate(F.lower(F.concat_ws(" ", *fields)), "ё", "е")
    for w in text.lower().replace("ё", "е").split():
        people = people.filter(F.contains(hay, F.lit(w)))
    total = people.agg(F.count("*"))
    return people.orderBy(order).limit(shown).withColumn("total", total.scalar())


def grep_lines(docs: DataFrame, key: str, text: str, needle: str, limit: int = GREP_DEFAULT) -> DataFrame:
    """Lines that hold the needle in any case: number, trimmed text up to 300 characters, total found."""
    low = needle.lower().strip()
    if len(low) < 3:
        raise ValueError("the needle needs 3 characters")
    lines = (docs.filter(F.contains(F.lower(text), F.lit(low)))
             .select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("_at", "_line"))
             .filter(F.contains(F.lower("_line"), F.lit(low)))
             .select(key, (F.col("_at") + 1).alias("line"), F.substring(F.trim("_line"), 1, 300).alias("hit")))
    total = lines.agg(F.count("*"))
    return lines.orderBy(key, "line").limit(clamp(limit, 1, GREP_CAP)).withColumn("total", total.scalar())


def read_lines(docs: DataFrame, text: str, first: int | Column, last: int | Column, budget: int) -> DataFrame:
    """Numbered lines first…last of each text, cut at whole lines to the budget; ``next_start`` where reading goes on.

    The lines may be columns, such as those of a link or of a procedure.
    """
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    lines = F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0)))
    numbered = F.transform(lines, lambda line, i: F.concat((i + first).cast("string"), F.lit(": "), line))
    whole = F.array_join(numbered, "\n")
    cut = F.regexp_replace(F.substring(F.col("_whole"), 1, budget), r"\n[^\n]*\z", "")
    shown = F.when(F.length("_whole") > budget, cut).otherwise(F.col("_whole"))
    lines_shown = F.length("shown") - F.length(F.replace("shown", F.lit("\n"), F.lit("")))
    return (docs.withColumn("_whole", whole).withColumn("shown", shown)
            .withColumn("next_start", F.when(F.length("_whole") > budget, (lines_shown + first + 1).cast("int")))
            .drop("_whole"))


def read_procedures(docs: DataFrame, blocks: DataFrame, requests: DataFrame, text: str, budget: int) -> DataFrame:
    """(doc_id, procedure, line_start, line_end, shown, next_start) for requests (doc_id, procedure), names in any case.

    Of several procedures of that name the first one is read; a module without it gives its contents in ``shown`` and no lines:
    the names that hold the request, else all names.
    """
    asked = requests.select("doc_id", "procedure", F.lower(F.trim("procedure")).alias("_low")).distinct()
    procs = blocks.filter(F.col("kind").isin("proc", "func")).select("doc_id", F.lower("name").alias("_low"), "name", "line_start", "line_end")
    firsts = procs.groupBy("doc_id", "_low").agg(F.min(F.struct("line_start", "line_end")).alias("f"))
    placed = asked.join(firsts, ["doc_id", "_low"], "left")
    read = read_lines(placed.filter("f IS NOT NULL").join(docs.select("doc_id", text), "doc_id"), text, F.col("f.line_start"), F.col("f.line_end"), budget)
    lacking = placed.filter("f IS NULL").select("doc_id", "procedure", "_low").join(procs.withColumnRenamed("_low", "_own"), "doc_id")
    near = F.contains("_own", F.col("_low"))
    lists = lacking.groupBy("doc_id", "procedure").agg(
        F.sort_array(F.collect_list(F.when(near, F.struct("line_start", "name")))).alias("near"), F.sort_array(F.collect_list(F.struct("line_start", "name"))).alias("all"))
    shown = F.array_join(F.when(F.size("near") > 0, F.col("near.name")).otherwise(F.col("all.name")), "\n")
    none = F.lit(None).cast("int")
    return read.select("doc_id", "procedure", "f.line_start", "f.line_end", "shown", "next_start").unionByName(
        lists.select("doc_id", "procedure", none.alias("line_start"), none.alias("line_end"), shown.alias("shown"), none.alias("next_start")))


def preview(docs: DataFrame, text: str, chars: int = 20000) -> DataFrame:
    return docs.withColumn("shown", F.substring(text, 1, chars)).withColumn("truncated", F.length(text) > chars)


def result_rows(results: DataFrame, json: str, keep: list[str], names: list[str]) -> DataFrame:
    """``{"columns": [...], "rows": [[...]]}`` to named columns; cells are found by column name."""
    parsed = results.select(*keep, F.from_json(json, "columns array<string>, rows array<array<string>>").alias("_r"))
    rows = parsed.select(*keep, F.col("_r.columns").alias("_c"), F.explode("_r.rows").alias("_row"))
    return rows.select(*keep, *[F.when(F.array_position("_c", F.lit(n)) > 0, F.try_element_at(
        "_row", F.array_position("_c", F.lit(n)).cast("int"))).alias(n) for n in names])


def allowed_rows(rows: DataFrame, users: DataFrame, rights: DataFrame, owners: DataFrame, *,
                 user: str, base: str, open_to_all: bool = False) -> DataFrame:
    """Rows a user may see: known user (or open mode), base listed for the user or ``*``, and base unowned or owned by the user.

    users: user, star · rights: user, base · owners: base, user (bases without rows here are unowned)
    """
    known = rows.join(users.select(user, "star"), user, "left")
    known = known.withColumn("star", F.coalesce("star", F.lit(open_to_all)))
    listed = rights.select(user, base).distinct().withColumn("_listed", F.lit(True))
    owned = owners.select(base).distinct().withColumn("_owned", F.lit(True))
    own = owners.select(base, user).distinct().withColumn("_own", F.lit(True))
    out = known.join(listed, [user, base], "left").join(owned, base, "left").join(own, [base, user], "left")
    return (out.filter((F.col("star") | F.col("_listed")) & (F.col("_owned").isNull() | F.col("_own")))
            .select(*rows.columns))


def notify_targets(people: DataFrame, entries: list[str], key: str, name: str) -> DataFrame:
    """Receivers: an id is taken as it is, other entries pick everybody whose name holds them."""
    ids = [e.strip().lower() for e in entries if len(e.strip()) == 36 and e.strip().count("-") == 4]
    parts = [e.strip() for e in entries if e.strip().lower() not in ids]
    spark = people.sparkSession
    given = spark.createDataFrame([(e, e) for e in ids], "entry string, receiver string")
    hits = F.filter(F.array(*[F.when(F.contains(F.lower(name), F.lit(p.lower())), F.lit(p)) for p in parts]) if parts
                    else F.expr("cast(array() as array<string>)"), lambda x: x.isNotNull())
    found = people.select(F.explode(hits).alias("entry"), F.col(key).cast("string").alias("receiver"))
    return given.unionByName(found)


