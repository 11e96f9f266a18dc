"""Message streams: routing, deduplication, joins, keyed state, daily figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.streaming import processors as P


def route_events(stream: DataFrame, line: str) -> DataFrame:
    """Texts and files of one line, written by the user, with a message id."""
    return stream.filter((F.col("event_type") == "line") & (F.col("line_id") == line) & F.col("message_type").isin(1, 70)
                         & F.col("user_id").isNotNull() & (F.col("author_id") == F.col("user_id")) & F.col("message_id").isNotNull())


def first_deliveries(stream: DataFrame, key: str) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark([key])


def _keyed(stream: DataFrame, key: str, processor, schema: str, time_mode: str = "EventTime") -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time_mode)


def idle_sessions(stream: DataFrame, idle_seconds: int) -> DataFrame:
    return _keyed(stream, "user_id", P.IdleSessions(idle_seconds), "user_id long, message_id long, session_no long, is_new boolean")


def bursts(stream: DataFrame, seconds: float) -> DataFrame:
    return _keyed(stream, "user_id", P.Bursts(seconds), "user_id long, first_ts timestamp, last_ts timestamp, n int, question string, files string")


def late_files(stream: DataFrame, minutes: int) -> DataFrame:
    return _keyed(stream, "user_id", P.LateFiles(minutes), "user_id long, file_id long, text_id long, state string")


def alerts(ticks: DataFrame, repeat_seconds: int) -> DataFrame:
    return _keyed(ticks, "monitor", P.Alerts(repeat_seconds), "monitor string, ts timestamp, message string, problems string")


def retries(stream: DataFrame, tries: int, minutes: int) -> DataFrame:
    return _keyed(stream, "user_id", P.RetryBudget(tries, minutes), "user_id long, message_id long, action string")


def followups(stream: DataFrame, seconds: int) -> DataFrame:
    """Each file with its user's latest text, if that is young enough: one row per file, one text per user in the state."""
    return _keyed(stream, "user_id", P.Followups(seconds), "user_id long, file_id long, text_id long")


def daily_figures(stream: DataFrame) -> DataFrame:
    return (stream.groupBy(F.window("created_at", "1 day").alias("w"))
            .agg(F.count("*").alias("questions"), F.count_if(F.col("status") == "ok").alias("ok"),
                 F.count_if(F.col("status").isin("error", "send_error")).alias("error"),
                 F.count_if(F.col("status") == "limit").alias("limit_hits"), F.sum("cost_usd").alias("cost"))
            .select(F.to_date("w.start").alias("day"), "questions", "ok", "error", "limit_hits", F.bround("cost", 4).alias("cost")))
