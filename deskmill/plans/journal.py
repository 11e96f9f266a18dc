"""Journal queries over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deskmill.operators import journal as J
from deskmill.operators.ordered import newest
from deskmill.plans.registry import query
from deskmill.session import workspace
from deskmill.sources.views import JOURNAL_SQL, MESSAGES_SQL, journal, messages

WITH = "WITH " + JOURNAL_SQL + "\n"
TODAY = "2024-01-20"
PERIODS = {"today": "2024-01-20 00:00:00", "week": "2024-01-14 00:00:00"}


@query("journal_page", WITH + """
, p AS (SELECT id, created_at, channel, user_key, user_name, base_id, question, status, duration_ms, cost_usd, error
  FROM journal WHERE id < 100000000 AND status IN ('error','send_error','ok')
   AND (contains(lower(question), '7') OR contains(lower(coalesce(answer,'')), '7') OR contains(lower(coalesce(error,'')), '7'))
  ORDER BY id DESC LIMIT 50)
SELECT *, (SELECT count(*) = 50 FROM p) AS more FROM p""")
def _(t):
    return J.page(journal(t.events), limit=50, before=100000000, statuses=["ok", "error", "send_error"], needle="7")


@query("status_groups", WITH + """
SELECT CASE WHEN status='ok' THEN 'ok' WHEN status IN ('error','send_error') THEN 'error' WHEN status='limit' THEN 'limit'
  WHEN status IN ('denied','unknown_user') THEN 'other' END AS status_group, count(*) AS n FROM journal GROUP BY 1""")
def _(t):
    return journal(t.events).groupBy(J.status_group().alias("status_group")).agg(F.count("*").alias("n"))


@query("since", WITH + """
SELECT created_at, user_key, status, duration_ms, cost_usd, channel FROM journal WHERE created_at >= TIMESTAMP '2024-01-20 06:30:00'""")
def _(t):
    return J.since(journal(t.events), F.lit("2024-01-20 06:30:00").cast("timestamp_ntz"))


@query("append_journal", WITH + """
SELECT id, substr(question, 1, 2000) AS question, substr(answer, 1, 20000) AS answer, status FROM (
  SELECT id, repeat(question || ' ', 300) AS question, repeat(answer || ' ', 2500) AS answer, status FROM journal)""")
def _(t):
    path = workspace(t.spark, "journal")
    rows = journal(t.events).withColumn("question", F.expr("repeat(concat(question, ' '), 300)")).withColumn(
        "answer", F.expr("repeat(concat(answer, ' '), 2500)"))
    J.append_journal(rows.filter(F.col("status") == "ok"), path)
    J.append_journal(rows.filter(F.col("status") != "ok"), path)
    return t.spark.read.parquet(path).select("id", "question", "answer", "status")


@query("daily_series", WITH + """
, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-07', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT d.day, count(j.id) AS questions, count(*) FILTER (j.status='ok') AS ok,
  count(*) FILTER (j.status IN ('error','send_error')) AS error, count(*) FILTER (j.status='limit') AS limit_hits,
  round_even(coalesce(sum(j.cost_usd), 0), 4) AS cost
FROM d LEFT JOIN journal j ON CAST(j.created_at AS DATE) = d.day GROUP BY 1""")
def _(t):
    return J.daily_series(journal(t.events), TODAY, 14)


@query("daily_spine", WITH + """
, d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-22', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT d.day, count(j.id) AS n FROM d LEFT JOIN journal j ON CAST(j.created_at AS DATE) = d.day GROUP BY 1""")
def _(t):
    facts = J.daily_facts(journal(t.events)).select("day", F.col("questions").alias("n"))
    return J.day_spine(t.spark, TODAY, 30).join(facts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("period_summary", WITH + """
, p AS (SELECT 'today' AS period, * FROM journal WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00'
        UNION ALL SELECT 'week', * FROM journal WHERE created_at >= TIMESTAMP '2024-01-14 00:00:00'),
m AS (SELECT period, list(duration_ms ORDER BY duration_ms) AS l FROM p WHERE status='ok' AND duration_ms<>0 GROUP BY 1)
SELECT p.period, count(*) FILTER (status IN ('ok','error','send_error')) AS questions, count(*) FILTER (status='ok') AS ok,
  CAST(round_even(100.0*count(*) FILTER (status='ok')/nullif(count(*) FILTER (status IN ('ok','error','send_error')),0), 0) AS BIGINT) AS ok_rate,
  any_value(m.l[len(m.l)//2 + 1])/1000 AS median_seconds, round_even(sum(cost_usd), 4) AS cost,
  count(DISTINCT user_key) FILTER (status IN ('ok','error','send_error')) AS users, count(*) FILTER (status='limit') AS limits
FROM p LEFT JOIN m USING (period) GROUP BY 1""")
def _(t):
    return J.period_summary(journal(t.events), PERIODS)


@query("journal_report", WITH + """
SELECT CAST(min(created_at) AS DATE) AS first_day, CAST(max(created_at) AS DATE) AS last_day,
  count(*) FILTER (status IN ('ok','error')) AS answered,
  CAST(round_even(100.0*count(*) FILTER (status='ok')/count(*) FILTER (status IN ('ok','error')), 0) AS BIGINT) AS ok_percent,
  max(duration_ms) FILTER (status='ok' AND duration_ms<>0)/1000 AS max_seconds,
  round_even(avg(cost_usd) FILTER (status='ok'), 4) AS mean_cost, round_even(sum(cost_usd) FILTER (status='ok'), 4) AS total_cost,
  count(*) FILTER (status='limit') AS limits, median(duration_ms) FILTER (status='ok' AND duration_ms<>0)/1000 AS median_seconds
FROM journal""")
def _(t):
    return J.report(journal(t.events))


@query("top_bases", WITH + """
SELECT coalesce(base_id, 'knowledge base only') AS base, count(*) AS n FROM journal WHERE status IN ('ok','error') GROUP BY 1""")
def _(t):
    return J.top_bases(journal(t.events), "knowledge base only")


@query("top_users", WITH + """
SELECT user_name, count(*) AS n, min(id) AS first_id FROM journal WHERE status IN ('ok','error') GROUP BY 1
ORDER BY n DESC, first_id LIMIT 10""")
def _(t):
    return J.top_users(journal(t.events))


@query("unknown_users", WITH + "SELECT user_key, count(*) AS n FROM journal WHERE status='unknown_user' GROUP BY 1")
def _(t):
    return journal(t.events).filter(F.col("status") == "unknown_user").groupBy("user_key").agg(F.count("*").alias("n"))


@query("channels_today", WITH + """
SELECT channel, count(*) AS n FROM journal WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1""")
def _(t):
    return (journal(t.events).filter(F.col("created_at") >= F.lit(PERIODS["today"]).cast("timestamp_ntz"))
            .groupBy("channel").agg(F.count("*").alias("n")))


@query("recent_people", WITH + """
, r AS (SELECT * FROM journal ORDER BY id DESC LIMIT 500)
SELECT user_key, max_by(user_name, id) AS user_name FROM r GROUP BY 1""")
def _(t):
    return J.recent_people(journal(t.events))


@query("recent_dialog", WITH + """
, r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY id DESC) AS rn FROM journal
  WHERE status='ok' AND created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00')
SELECT user_key, row_number() OVER (PARTITION BY user_key ORDER BY id) AS place, id, created_at, base_id,
  CASE WHEN length(question) > 400 THEN substr(question,1,399)||'…' ELSE trim(regexp_replace(question,'\\s+',' ','g')) END AS question,
  CASE WHEN length(answer) > 700 THEN substr(answer,1,699)||'…' ELSE trim(regexp_replace(answer,'\\s+',' ','g')) END AS answer
FROM r WHERE rn <= 6""")
def _(t):
    return J.recent_dialog(journal(t.events), "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("cost_delta", WITH + """
SELECT id, user_key, base, cost_total, greatest(0, cost_total - coalesce(lag(cost_total) OVER (PARTITION BY user_key, base ORDER BY created_at, id), 0)) AS delta
FROM (SELECT id, created_at, user_key, coalesce(base_id,'') AS base, duration_ms/1000 AS cost_total FROM journal WHERE status='ok')""")
def _(t):
    totals = journal(t.events).filter(F.col("status") == "ok").select(
        "id", "created_at", "user_key", F.coalesce("base_id", F.lit("")).alias("base"), (F.col("duration_ms") / 1000).alias("cost_total"))
    return J.cost_delta(totals, ["user_key", "base"]).drop("created_at")


@query("failure_streak", WITH + """
, s AS (SELECT *, sum(CASE WHEN status='ok' THEN 1 ELSE 0 END) OVER (PARTITION BY user_key ORDER BY created_at, id) AS island
  FROM journal WHERE status IN ('ok','error')),
f AS (SELECT *, sum(CASE WHEN status='error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_key, island ORDER BY created_at, id) AS r FROM s)
SELECT id, user_key, status, CAST(CASE WHEN r > 0 AND status='error' THEN (r-1)%2+1 ELSE 0 END AS BIGINT) AS fails,
  (r > 0 AND status='error' AND (r-1)%2+1 >= 2) AS ends_session FROM f""")
def _(t):
    return J.failure_streaks(journal(t.events), ["user_key"]).select("id", "user_key", "status", "fails", "ends_session")


@query("recent_notes", "WITH " + MESSAGES_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY message_id DESC) AS rn FROM messages
  WHERE kind='command' AND ts >= TIMESTAMP '2024-01-20 00:00:00')
SELECT user_id, message_id, ts, substr(body,1,1500) AS note FROM r WHERE rn <= 10""")
def _(t):
    rows = messages(t.events).filter((F.col("kind") == "command") & (
        F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")))
    return newest(rows, ["user_id"], 10, F.col("message_id").desc()).select(
        "user_id", "message_id", "ts", F.substring("body", 1, 1500).alias("note"))


@query("recent_success", WITH + """
, k AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:10:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 30 MINUTE)) AS tick),
g AS (SELECT created_at FROM journal WHERE status='ok')
SELECT k.tick, EXISTS (SELECT 1 FROM g WHERE g.created_at <= k.tick AND g.created_at >= k.tick - INTERVAL 1 HOUR) AS ok FROM k""")
def _(t):
    ticks = t.spark.range(1).select(F.explode(F.expr(
        "sequence(timestamp_ntz'2024-01-01 00:10:00', timestamp_ntz'2024-02-01 00:00:00', interval 30 minutes)")).alias("tick"))
    return J.recent_success(journal(t.events), ticks)


@query("display_name", """
SELECT o.o_orderkey, o.o_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_name
  WHEN o.o_orderpriority <> '1-URGENT' THEN o.o_orderpriority ELSE '1-URGENT' END AS display
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o.o_custkey = c.c_custkey""")
def _(t):
    people = t.customer.filter(F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return J.display_name(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), people, "o_custkey",
                          "o_orderpriority", "1-URGENT").drop("o_orderpriority")


def _hourly_checks(t):
    """One check per channel and hour: it fails when more than half of the hour's entries are errors."""
    return (journal(t.events).withColumn("tick", F.date_trunc("hour", "created_at").cast("timestamp_ntz"))
            .groupBy("tick", F.coalesce("base_id", F.lit("none")).alias("name"))
            .agg(F.count_if(F.col("status").isin("error", "send_error")).alias("bad_n"), F.count("*").alias("n"))
            .select("tick", "name", F.rank().over(Window.partitionBy("tick").orderBy("name")).alias("check_no"),
                    (F.col("bad_n") * 2 <= F.col("n")).alias("ok"),
                    F.concat(F.col("bad_n").cast("string"), F.lit(" of "), F.col("n").cast("string")).alias("text")))


@query("alert_text", WITH + """
, c AS (SELECT date_trunc('hour', created_at) AS tick, coalesce(base_id,'none') AS name,
  count(*) FILTER (status IN ('error','send_error')) AS bad_n, count(*) AS n FROM journal GROUP BY 1, 2)
SELECT tick, string_agg('• '||name||': '||bad_n||' of '||n, chr(10) ORDER BY name) AS text FROM c WHERE bad_n*2 > n GROUP BY 1""")
def _(t):
    return J.alert_text(_hourly_checks(t))


@query("n_of_n_failure", WITH + """
, a AS (SELECT coalesce(base_id,'none') AS name, date_trunc('hour', created_at) AS tick, status,
  row_number() OVER (PARTITION BY coalesce(base_id,'none'), date_trunc('hour', created_at) ORDER BY created_at, id) AS attempt FROM journal)
SELECT name, tick, count(*) AS tried, NOT bool_or(status='ok') AS bad FROM a WHERE attempt <= 3 GROUP BY 1, 2""")
def _(t):
    rows = journal(t.events).select(F.coalesce("base_id", F.lit("none")).alias("name"),
                                    F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("tick"), "created_at", "id", "status")
    attempts = newest(rows, ["name", "tick"], 3, F.col("created_at"), F.col("id"), rank="attempt").withColumn("ok", F.col("status") == "ok")
    return J.n_of_n_failure(attempts, ["name", "tick"], 3)
