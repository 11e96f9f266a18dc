"""Journal of questions and answers: pages, summaries, daily series, people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.operators.ordered import newest, running, time_segment, value_at

# Named status groups of the journal, and limits of the stored texts and pages.
STATUS_GROUPS = {"ok": ["ok"], "error": ["error", "send_error"], "limit": ["limit"],
                 "other": ["denied", "unknown_user"]}
QUESTION_CHARS, ANSWER_CHARS, MAX_PAGE = 2000, 20000, 500
PAGE_COLUMNS = ["id", "created_at", "channel", "user_key", "user_name", "base_id", "question", "status",
                "duration_ms", "cost_usd", "error"]


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def to_stored(journal: DataFrame) -> DataFrame:
    """Texts cut to what the journal keeps; an empty answer is stored as null."""
    return (journal.withColumn("question", F.substring("question", 1, QUESTION_CHARS))
            .withColumn("answer", F.when(F.length("answer") > 0, F.substring("answer", 1, ANSWER_CHARS))))


def append_journal(journal: DataFrame, path: str) -> None:
    to_stored(journal).write.mode("append").parquet(path)


def contains_folded(col: str, needle: str) -> Column:
    """Case-insensitive substring; wildcards in the needle have no meaning."""
    return F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(needle.lower()))


def page(journal: DataFrame, *, limit: int = 50, before: int | None = None, statuses: list[str] | None = None,
         user: int | str | None = None, needle: str | None = None) -> DataFrame:
    """Newest entries first without the answer text; ``more`` says that the page is full."""
    rows = journal
    if before:
        rows = rows.filter(F.col("id") < before)
    if statuses:
        rows = rows.filter(F.col("status").isin(statuses))
    if user is not None:
        rows = rows.filter(F.col("user_key") == user)
    if needle:
        rows = rows.filter(contains_folded("question", needle) | contains_folded("answer", needle)
                           | contains_folded("error", needle))
    size = clamp(limit, 1, MAX_PAGE)
    top = rows.select(*PAGE_COLUMNS).orderBy(F.col("id").desc()).limit(size)
    full = top.agg(F.count("*") == size)
    return top.withColumn("more", full.scalar())


def status_group(status: str = "status") -> Column:
    out = F.lit(None).cast("string")
    for name, members in STATUS_GROUPS.items():
        out = F.when(F.col(status).isin(members), name).otherwise(out)
    return out


def since(journal: DataFrame, start) -> DataFrame:
    return (journal.filter(F.col("created_at") >= start)
            .select("created_at", "user_key", "status", "duration_ms", "cost_usd", "channel"))


def day_spine(spark, last: str, days: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(
        f"sequence(date'{last}' - {days - 1}, date'{last}', interval 1 day)")).alias("day"))


def daily_facts(journal: DataFrame) -> DataFrame:
    return journal.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status").isin(STATUS_GROUPS["error"])).alias("error"),
        F.count_if(F.col("status") == "limit").alias("limit_hits"),
        F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"))


def daily_series(journal: DataFrame, last: str, days: int = 14) -> DataFrame:
    """One row per calendar day up to ``last``, days without questions included."""
    inside = journal.filter((F.col("created_at") >= F.expr(f"date'{last}' - {days - 1}"))
                            & (F.col("created_at") < F.expr(f"date'{last}' + 1")))
    facts = daily_facts(inside)
    spine = day_spine(journal.sparkSession, last, days)
    return spine.join(facts, "day", "left").select(
        "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("questions", "ok", "error", "limit_hits")],
        F.bround(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"))


def period_summary(journal: DataFrame, starts: dict[str, str]) -> DataFrame:
    """Figures per named period, each from its start to the end of the journal.

    The median is the upper one: the value at place n div 2 of the sorted seconds.
    """
    rows = journal.filter(F.col("created_at") >= F.lit(min(starts.values())).cast("timestamp_ntz"))
    per = rows.select("*", F.explode(F.filter(
        F.array(*[F.when(F.col("created_at") >= F.lit(s).cast("timestamp_ntz"), F.lit(p)) for p, s in starts.items()]),
        lambda p: p.isNotNull())).alias("period"))
    answered = F.col("status").isin("ok", "error", "send_error")
    ok = F.col("status") == "ok"
    users = (per.filter(answered).select("period", "user_key").distinct()
             .groupBy("period").agg(F.count("*").alias("users")))
    figures = per.groupBy("period").agg(
        F.count_if(answered).alias("questions"), F.count_if(ok).alias("ok"),
        F.bround(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 4).alias("cost"),
        F.count_if(F.col("status") == "limit").alias("limits"))
    median = (value_at(per.filter(ok & (F.col("duration_ms") != 0)), ["period"], "duration_ms",
                       F.expr("n div 2"), width=1000)
              .select("period", (F.col("duration_ms") / 1000).alias("median_seconds")))
    return (figures.join(users, "period", "left").join(median, "period", "left")
            .select("period", "questions", "ok",
                    F.when(F.col("questions") > 0, F.bround(100 * F.col("ok") / F.col("questions"), 0).cast("long")).alias("ok_rate"),
                    "median_seconds", "cost", F.coalesce("users", F.lit(0)).alias("users"), "limits"))


def report(journal: DataFrame) -> DataFrame:
    """One row over the whole journal: dates, share answered, true median and longest seconds, costs."""
    answered = F.col("status").isin("ok", "error")
    ok = F.col("status") == "ok"
    figures = journal.groupBy(F.lit(1).alias("one")).agg(
        F.to_date(F.min("created_at")).alias("first_day"), F.to_date(F.max("created_at")).alias("last_day"),
        F.count_if(answered).alias("answered"),
        F.bround(100 * F.count_if(ok) / F.count_if(answered), 0).cast("long").alias("ok_percent"),
        (F.max(F.when(ok & (F.col("duration_ms") != 0), F.col("duration_ms"))) / 1000).alias("max_seconds"),
        F.bround(F.avg(F.when(ok, F.col("cost_usd"))), 4).alias("mean_cost"),
        F.bround(F.sum(F.when(ok, F.col("cost_usd"))), 4).alias("total_cost"),
        F.count_if(F.col("status") == "limit").alias("limits"))
    timed = journal.filter(ok & (F.col("duration_ms") != 0)).select(F.lit(1).alias("one"), "duration_ms")
    low = value_at(timed, ["one"], "duration_ms", F.expr("(n - 1) div 2"), 1000).select("one", F.col("duration_ms").alias("lo"))
    high = value_at(timed, ["one"], "duration_ms", F.expr("n div 2"), 1000).select("one", F.col("duration_ms").alias("hi"))
    return (figures.join(low, "one", "left").join(high, "one", "left")
            .withColumn("median_seconds", (F.col("lo") + F.col("hi")) / 2000)
            .drop("one", "lo", "hi"))


def top_bases(journal: DataFrame, missing: str) -> DataFrame:
    return (journal.filter(F.col("status").isin("ok", "error"))
            .groupBy(F.coalesce("base_id", F.lit(missing)).alias("base"))
            .agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "base"))


def top_users(journal: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent users; equal counts in order of first appearance."""
    return (journal.filter(F.col("status").isin("ok", "error")).groupBy("user_name")
            .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
            .orderBy(F.col("n").desc(), "first_id").limit(n))


def recent_people(journal: DataFrame, n: int = MAX_PAGE) -> DataFrame:
    """People among the newest n entries, each under the newest name, sorted without case."""
    last = journal.select("id", "user_key", "user_name").orderBy(F.col("id").desc()).limit(n)
    return (last.groupBy("user_key").agg(F.max_by("user_name", "id").alias("user_name"))
            .orderBy(F.lower("user_name")))


def recent_dialog(journal: DataFrame, start: str, end: str, n: int = 6) -> DataFrame:
    """Last n answered questions per user in a time range, ``place`` 1 is the oldest shown."""
    rows = journal.filter((F.col("status") == "ok") & F.col("created_at").between(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    top = newest(rows, ["user_key"], n, F.col("id").desc())
    return top.select(
        "user_key", F.row_number().over(Window.partitionBy("user_key").orderBy("id")).alias("place"),
        "id", "created_at", "base_id", shorten(F.col("question"), 400).alias("question"),
        shorten(F.col("answer"), 700).alias("answer"))


def shorten(col: Column, n: int) -> Column:
    """White space collapsed; longer texts end in an ellipsis, n characters in all."""
    flat = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def cost_delta(totals: DataFrame, session: list[str], ts: str = "created_at", total: str = "cost_total") -> DataFrame:
    """Growth of a cumulated cost per session; never negative, the first total counts in full."""
    out = running(totals, session, [ts, "id"], time_segment(ts), prev={"before": F.col(total)})
    return out.withColumn("delta", F.greatest(F.lit(0.0), F.col(total) - F.coalesce("before", F.lit(0.0)))).drop("before")


def failure_streaks(journal: DataFrame, keys: list[str], ends_at: int = 2) -> DataFrame:
    """Consecutive errors per key, reset by a success. Every ``ends_at``-th one ends the session and starts afresh."""
    bad = F.col("status") == "error"
    seg = time_segment("created_at")
    counted = running(journal.filter(F.col("status").isin("ok", "error")), keys, ["created_at", "id"], seg,
                      sums={"errors": bad.cast("long")})
    marked = running(counted, keys, ["created_at", "id"], seg,
                     last={"at_ok": F.when(F.col("status") == "ok", F.col("errors"))})
    run = F.col("errors") - F.coalesce("at_ok", F.lit(0))
    fails = F.when(run > 0, (run - 1) % ends_at + 1).otherwise(0)
    return (marked.withColumn("fails", fails.cast("long"))
            .withColumn("ends_session", F.col("fails") >= ends_at).drop("errors", "at_ok"))


def recent_success(journal: DataFrame, ticks: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per tick, whenever it lies: was a question answered in the ``seconds`` up to it?

    Of every bucket of that length only the first and the last answer matter: the tick's own bucket holds one in time if
    its first is not later than the tick, the bucket before if its last is not too old.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    good = journal.filter(F.col("status") == "ok").groupBy(bucket("created_at").alias("b")).agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    own = good.select("b", "first")
    before = good.select((F.col("b") + 1).alias("b"), "last")
    since = F.col("tick") - F.make_dt_interval(secs=F.lit(seconds))
    return (ticks.withColumn("b", bucket("tick")).join(own, "b", "left").join(before, "b", "left")
            .select("tick", F.coalesce((F.col("first") <= F.col("tick")) | (F.col("last") >= since), F.col("first") <= F.col("tick"),
                                       F.col("last") >= since, F.lit(False)).alias("ok")))


def display_name(rows: DataFrame, people: DataFrame, key: str, stored: str, placeholder: str) -> DataFrame:
    """Directory name, else the stored one unless it is the placeholder, else placeholder or key."""
    named = rows.join(people.select(key, F.col("name").alias("_dir")), key, "left")
    return named.withColumn("display", F.coalesce(
        F.nullif(F.col("_dir"), F.lit("")), F.nullif(F.nullif(F.col(stored), F.lit(placeholder)), F.lit("")),
        F.nullif(F.col(stored), F.lit("")), F.col(key).cast("string"))).drop("_dir")


def alert_text(checks: DataFrame) -> DataFrame:
    """Failed checks of a tick as one text, a line each, in the order the checks ran."""
    line = F.concat(F.lit("• "), "name", F.lit(": "), "text")
    return (checks.filter(~F.col("ok")).groupBy("tick")
            .agg(F.sort_array(F.collect_list(F.struct("check_no", line.alias("line")))).alias("l"))
            .select("tick", F.array_join(F.col("l.line"), "\n").alias("text")))


def n_of_n_failure(attempts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A check is bad only when none of its first n attempts passed."""
    return (attempts.filter(F.col("attempt") <= n).groupBy(*keys)
            .agg(F.count("*").alias("tried"), (~F.bool_or("ok")).alias("bad")))
