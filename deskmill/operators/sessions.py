"""Conversations out of message events: idle sessions, bursts, late files, alerts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.operators.ordered import newest, running, time_segment
from deskmill.session import materialise


def micros(col: str | Column) -> Column:
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def age_within(newer: str, older: str, seconds: float) -> Column:
    return micros(newer) - micros(older) <= int(seconds * 1_000_000)


def number_sessions(rows: DataFrame, user: str, ts: str, tie: str, base: str, idle_seconds: int) -> DataFrame:
    """Add ``is_new`` and ``session_no`` (from 1 per user).

    A session ends after more than the idle time, or when a base is named that
    is not the session's base. A row without base stays in the current one.
    """
    seg = time_segment(ts)
    order = [ts, tie]
    gaps = running(rows, [user], order, seg, prev={"_before": F.col(ts)})
    cold = F.col("_before").isNull() | ~age_within(ts, "_before", idle_seconds)
    # the newest earlier row that was cold or named a base tells the current base
    mark = F.when(F.col("_cold") | F.col(base).isNotNull(), F.struct(F.col(base).alias("base")))
    marked = running(gaps.withColumn("_cold", cold), [user], order, seg, earlier={"_current": mark})
    fresh = F.col("_cold") | (F.col(base).isNotNull() & ~F.col(base).eqNullSafe(F.col("_current.base")))
    out = running(marked.withColumn("is_new", fresh), [user], order, seg, sums={"session_no": F.col("is_new").cast("long")})
    return out.drop("_before", "_cold", "_current")


def session_table(numbered: DataFrame, user: str, ts: str, base: str) -> DataFrame:
    return numbered.groupBy(user, "session_no").agg(
        F.max(base).alias("base_id"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def current_session(sessions: DataFrame, user: str, now: str, idle_seconds: int) -> DataFrame:
    """The last session per user, if it is not older than the idle time at ``now``."""
    at = F.lit(now).cast("timestamp_ntz")
    last = sessions.filter(F.col("last_ts") <= at).groupBy(user).agg(
        F.max_by(F.struct("session_no", "base_id", "last_ts"), "session_no").alias("s"))
    return last.select(user, "s.*").filter(micros(at) - micros("last_ts") <= idle_seconds * 1_000_000)


def recent_conversations(sessions: DataFrame, current: DataFrame, user: str, n: int = 5) -> DataFrame:
    others = sessions.join(current.select(user, "session_no"), [user, "session_no"], "left_anti")
    return newest(others, [user], n, F.col("last_ts").desc(), F.col("session_no").desc(), rank="place")


def conversation_archive(numbered: DataFrame, user: str, ts: str, tie: str) -> DataFrame:
    """Per session: first title, start, last activity, last base and last known cost."""
    at = F.struct(ts, tie)
    return numbered.groupBy(user, "session_no").agg(
        F.substring(F.min_by("question", at), 1, 200).alias("title"),
        F.min(ts).alias("started_at"), F.max(ts).alias("last_active"),
        F.max_by("base_id", at).alias("base_id"),
        F.max_by("cost_usd", F.when(F.col("cost_usd").isNotNull(), at)).alias("cost_total"))


def followup_files(messages: DataFrame, seconds: int = 180) -> DataFrame:
    """Files that follow the same user's latest text within the given time."""
    text = F.col("kind") == "text"
    seen = running(messages, ["user_id"], ["ts", "message_id"], time_segment("ts"),
                   last={"text_at": F.when(text, F.struct("ts", "message_id"))})
    return (seen.filter((F.col("kind") == "file") & F.col("text_at").isNotNull())
            .filter(micros("ts") - micros(F.col("text_at.ts")) <= seconds * 1_000_000)
            .select("user_id", F.col("message_id").alias("file_id"), F.col("text_at.message_id").alias("text_id")))


def pending_files(messages: DataFrame, minutes: int = 30) -> DataFrame:
    """Every file with the next text of its user: attached if young enough, else discarded; waiting without one."""
    text = F.col("kind") == "text"
    ahead = running(messages, ["user_id"], ["ts", "message_id"], time_segment("ts"),
                    last={"next_text": F.when(text, F.struct("ts", "message_id"))}, reverse=True)
    young = micros(F.col("next_text.ts")) - micros("ts") <= minutes * 60_000_000
    return ahead.filter(F.col("kind") == "file").select(
        "user_id", F.col("message_id").alias("file_id"), F.col("next_text.message_id").alias("text_id"),
        F.when(F.col("next_text").isNull(), "waiting").when(young, "attached").otherwise("discarded").alias("state"))


def limit_blackout(journal: DataFrame, reset: Column) -> DataFrame:
    """Questions asked while the newest limit hit before them has not been reset. The limit is one for all users, so a minute is one segment."""
    rows = journal.withColumn("_all", F.lit(1))
    known = running(rows, ["_all"], ["created_at", "id"], time_segment("created_at", 60),
                    last={"limit_until": F.when(F.col("status") == "limit", reset)})
    return known.filter((F.col("status") != "limit") & (F.col("created_at") < F.col("limit_until"))).drop("_all")


def number_bursts(messages: DataFrame, seconds: float) -> DataFrame:
    """Number the bursts of a user: pauses shorter than the window join, a command stands alone."""
    seg = time_segment("ts")
    order = ["ts", "message_id"]
    seen = running(messages, ["user_id"], order, seg, prev={"_before": F.struct("ts", "kind")})
    opens = (F.col("_before").isNull() | (F.col("kind") == "command") | (F.col("_before.kind") == "command")
             | (micros("ts") - micros(F.col("_before.ts")) >= int(seconds * 1_000_000)))
    return running(seen.withColumn("_opens", opens.cast("long")), ["user_id"], order, seg,
                   sums={"burst_no": F.col("_opens")}).drop("_before", "_opens")


def burst_questions(numbered: DataFrame) -> DataFrame:
    """One row per burst: texts joined by newline in order of arrival, and the files."""
    part = F.sort_array(F.collect_list(F.struct("ts", "message_id", "kind", "body")))
    pieces = numbered.groupBy("user_id", "burst_no").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), part.alias("p"))
    texts = F.filter("p", lambda x: x["kind"] != "file")
    files = F.filter("p", lambda x: x["kind"] == "file")
    return pieces.select(
        "user_id", "burst_no", "first_ts", "last_ts", F.size("p").alias("n"),
        F.array_join(F.transform(texts, lambda x: x["body"]), "\n").alias("question"),
        F.array_join(F.transform(files, lambda x: x["message_id"].cast("string")), ",").alias("files"))


def first_deliveries(messages: DataFrame, key: str, *order: Column) -> DataFrame:
    return newest(messages, [key], 1, *order).drop("rank")


def latest_record(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last record per key; aggregated, so a hot key is cut down before the shuffle."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")


def alert_machine(ticks: DataFrame, repeat_seconds: int, spans: int = 64) -> DataFrame:
    """Messages of each monitor over its ticks (one row per monitor and tick: ts, bad, problems, sent).

    Alert when bad and: it was good, or the problem set changed, or the last alert that was sent is ``repeat_seconds`` old.
    One recovery message. A failed send does not count as an alert.

    A monitor's ticks are cut into segments of ``spans`` repeats. All that a segment does to the time of the last sent message is
    a small table: a change that was sent sets it whatever it was before; else only ticks of the first repeat can be the first
    to fire, and where their chain of repeats ends is found for all of them together. The tables are gone through per monitor,
    which gives the time each segment begins with; then the segments are worked on by themselves.
    """
    width = repeat_seconds * spans
    columns = ["at", "bad", "problems", "sent"]
    rows = ticks.select("monitor", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "bad", "problems", "sent")
    seen = running(rows, ["monitor"], columns, F.floor(F.col("at") / width), prev={"_before": F.struct("bad", "problems")})
    was_bad, before = F.coalesce(F.col("_before.bad"), F.lit(False)), F.coalesce(F.col("_before.problems"), F.lit(""))
    changed = (F.col("bad") & (~was_bad | (before != F.col("problems")))) | (~F.col("bad") & was_bad)
    marked = materialise(seen.withColumn("changed", changed).filter(F.col("bad") | F.col("changed"))
                         .select("monitor", F.floor(F.col("at") / width).alias("seg"), *columns, "changed"), "ticks")

    def table(key, part):
        sent = part[part["sent"]].sort_values("at")
        times, set_ = sent["at"].to_numpy(), sent["changed"].to_numpy()
        cut = np.flatnonzero(set_)
        quiet = times[cut[-1]:] if len(cut) else times  # what comes before the last change is forgotten
        if len(cut):
            first = np.zeros(1, np.int64)
        else:
            first = np.arange(min(len(quiet), np.searchsorted(quiet, key[1] * width + repeat_seconds) + 1))
        last = first.copy()
        while len(last):
            after = np.searchsorted(quiet, quiet[last] + repeat_seconds)
            on = after < len(quiet)
            if not on.any():
                break
            last[on] = after[on]
        made = pd.DataFrame({"monitor": key[0], "seg": key[1], "need": quiet[first], "until": quiet[last], "always": bool(len(cut))})
        # a segment without such ticks changes nothing, but has to be told its beginning
        return made if len(made) else pd.DataFrame({"monitor": [key[0]], "seg": [key[1]], "need": [-1], "until": [-1], "always": [False]})

    def carry(key, part):
        alerted, out = 0, []
        for seg, rows_ in part.sort_values(["seg", "need"]).groupby("seg"):
            out.append((key[0], seg, alerted))
            if rows_["always"].iloc[0]:
                alerted = int(rows_["until"].iloc[0])
            else:
                at = int(np.searchsorted(rows_["need"].to_numpy(), alerted + repeat_seconds))
                alerted = int(rows_["until"].iloc[at]) if at < len(rows_) else alerted
        return pd.DataFrame(out, columns=["monitor", "seg", "alerted"])

    def messages(key, part):
        alerted, out = int(part["alerted"].iloc[0]), []
        for r in part.sort_values(columns).itertuples():
            if r.changed or r.at - alerted >= repeat_seconds:
                out.append((key[0], r.at, "alert" if r.bad else "recovered", r.problems))
                alerted = r.at if r.sent else alerted
        return pd.DataFrame(out, columns=["monitor", "at", "message", "problems"])

    part = ["monitor", "seg"]
    tables = marked.groupBy(*part).applyInPandas(table, "monitor string, seg bigint, need bigint, until bigint, always boolean")
    begins = tables.groupBy("monitor").applyInPandas(carry, "monitor string, seg bigint, alerted bigint")
    said = marked.join(begins, part).groupBy(*part).applyInPandas(messages, "monitor string, at bigint, message string, problems string")
    return said.select("monitor", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "message", "problems")
