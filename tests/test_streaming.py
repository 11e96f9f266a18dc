"""Streams cut into several micro-batches give what one batch gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from deskmill.operators import sessions
from deskmill.session import Tables, workspace
from deskmill.sources.views import messages
from deskmill.streaming import streams
from deskmill.streaming.runner import read_stream, run_available, state_settings


def micro_batches(spark):
    """The events in four files that overlap in time, and a late mark that lets the watermark pass all of them."""
    events = Tables(spark, "/root/testdata/sf0.001").events
    path = workspace(spark, "events")
    for part in (2, 0, 3, 1):
        events.filter(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(path)
    mark = events.limit(1).withColumns({"event_id": F.lit(10**6), "user_id": F.lit(-1).cast("long"), "ts": F.lit("2024-06-01").cast("timestamp_ntz")})
    mark.select(events.columns).coalesce(1).write.mode("append").parquet(path)
    return events, read_stream(spark, path, events.schema, delay="40 days", files_per_batch=1)


def test_sessions_out_of_order(spark):
    events, stream = micro_batches(spark)
    got = run_available(streams.idle_sessions(messages(stream).filter("kind = 'text'"), 480 * 60), "sessions").select("message_id", "session_no")
    texts = messages(events).filter("kind = 'text'")
    want = sessions.number_sessions(texts, "user_id", "ts", "message_id", "base_ref", 480 * 60).select("message_id", "session_no")
    assert sorted(got.collect()) == sorted(want.collect())


def test_late_files_out_of_order(spark):
    events, stream = micro_batches(spark)
    got = run_available(streams.late_files(messages(stream), 360), "late").select("user_id", "file_id", "text_id", "state")
    files = sessions.pending_files(messages(events), 360)
    young = F.col("state") == "attached"
    want = files.select("user_id", "file_id", F.when(young, F.col("text_id")).alias("text_id"), F.when(young, "attached").otherwise("discarded").alias("state"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_followups_out_of_order(spark):
    events, stream = micro_batches(spark)
    got = run_available(streams.followups(messages(stream), 3 * 3600), "followups")
    want = sessions.followup_files(messages(events), 3 * 3600)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_bursts_out_of_order(spark):
    events, stream = micro_batches(spark)
    got = run_available(streams.bursts(messages(stream), 3 * 3600), "bursts")
    want = sessions.burst_questions(sessions.number_bursts(messages(events), 3 * 3600))
    columns = ["user_id", "n", "question", "files"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def files_in_turn(spark, batches, schema, delay="10 minutes"):
    """Each list of rows is a micro-batch of its own."""
    path = workspace(spark, "turns")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, spark.createDataFrame([], schema).schema, delay=delay, files_per_batch=1)


MESSAGE = "user_id long, ts timestamp_ntz, message_id long, kind string, body string"


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_a_late_text_joins_its_burst(spark):
    stream = files_in_turn(spark, [[(1, at(0), 1, "text", "a")], [(1, at(90), 3, "text", "c")], [(1, at(50), 2, "text", "b")],
                                   [(2, at(9000), 9, "text", "z")], [(2, at(99999), 10, "text", "y")]], MESSAGE)
    rows = run_available(streams.bursts(stream, 60), "bursts").collect()
    assert [(r.n, r.question) for r in rows if r.user_id == 1] == [(3, "a\nb\nc")]
    assert all(r.first_ts <= r.last_ts for r in rows)


def test_file_then_question_and_pause(spark):
    stream = files_in_turn(spark, [[(1, at(0), 1, "file", "f"), (1, at(2), 2, "text", "why?"), (1, at(5), 3, "command", "/new"), (1, at(6), 4, "text", "next")],
                                   [(2, at(9999), 9, "text", "z")]], MESSAGE)
    rows = run_available(streams.bursts(stream, 4), "bursts").orderBy("first_ts").collect()
    assert [(r.question, r.files) for r in rows] == [("why?", "1"), ("/new", ""), ("next", "")]


def state_rows(spark, stream, columns, variable="state"):
    """Keys that still have a value of a state variable after the run."""
    out, check = workspace(spark, "out"), workspace(spark, "check")
    with state_settings(spark):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        left = spark.read.format("statestore").option("stateVarName", variable).load(check)
        keys = sorted(tuple(r.key) for r in left.select("key").collect())
    return keys, [tuple(r) for r in spark.read.parquet(out).select(*columns).collect()]


def test_waiting_files_of_a_silent_user_end(spark):
    stream = files_in_turn(spark, [[(1, at(0), 1, "file", "f")], [(2, at(50), 2, "file", "g"), (2, at(90), 3, "text", "t")],
                                   [(3, at(9999), 9, "text", "z")]], MESSAGE)
    keys, rows = state_rows(spark, streams.late_files(stream, 30), ["user_id", "file_id", "text_id", "state"])
    assert keys == [] and sorted(rows) == [(1, 1, None, "discarded"), (2, 2, 3, "attached")]


def test_failed_links_of_a_silent_user_end(spark):
    schema = "user_id long, ts timestamp_ntz, message_id long, base_ref string, works boolean"
    stream = files_in_turn(spark, [[(1, at(0), 1, "x", False)], [(2, at(1), 2, "y", False), (2, at(60), 3, None, True)], [(3, at(99999), 9, None, True)]], schema)
    keys, rows = state_rows(spark, streams.retries(stream, 3, 60), ["user_id", "message_id", "action"])
    assert keys == [] and sorted(rows, key=str) == sorted(
        [(1, 1, "failed"), (1, None, "given_up"), (2, 2, "failed"), (2, 3, "retry_connected")], key=str)


def test_followups_hold_one_text(spark):
    rows = [(1, at(i), i, "text" if i % 3 else "file", "b") for i in range(1, 60)]
    stream = files_in_turn(spark, [rows, [(2, at(9999), 99, "text", "z")]], MESSAGE)
    keys, found = state_rows(spark, streams.followups(stream, 180), ["file_id", "text_id"])
    assert keys == [] and sorted(found) == [(i, i - 1) for i in range(3, 60, 3)]
