"""Session, burst and alert queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskmill.operators import sessions as S
from deskmill.plans.registry import query
from deskmill.sources.views import JOURNAL_SQL, MESSAGES_SQL, journal, messages

IDLE = 480 * 60

SESSIONS_SQL = MESSAGES_SQL + """,
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 480 MINUTE THEN 0 ELSE 1 END AS cold
  FROM messages WHERE kind='text' WINDOW w AS (PARTITION BY user_id ORDER BY ts, message_id)),
i AS (SELECT *, sum(cold) OVER (PARTITION BY user_id ORDER BY ts, message_id) AS island FROM g),
c AS (SELECT *, last_value(base_ref IGNORE NULLS) OVER (PARTITION BY user_id, island ORDER BY ts, message_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM i),
f AS (SELECT *, (cold=1 OR (base_ref IS NOT NULL AND base_ref IS DISTINCT FROM cur)) AS is_new FROM c),
numbered AS (SELECT *, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, message_id) AS BIGINT) AS session_no FROM f),
sessions AS (SELECT user_id, session_no, max(base_ref) AS base_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n
  FROM numbered GROUP BY 1, 2),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_no DESC) AS rn
   FROM sessions WHERE last_ts <= TIMESTAMP '2024-01-25 12:00:00')
  WHERE rn = 1 AND TIMESTAMP '2024-01-25 12:00:00' - last_ts <= INTERVAL 480 MINUTE)"""
NOW = "2024-01-25 12:00:00"


def _numbered(t):
    texts = messages(t.events).filter(F.col("kind") == "text")
    return S.number_sessions(texts, "user_id", "ts", "message_id", "base_ref", IDLE)


def _sessions(t):
    return S.session_table(_numbered(t), "user_id", "ts", "base_ref")


@query("idle_sessions", "WITH " + SESSIONS_SQL + " SELECT user_id, message_id, session_no, is_new FROM numbered")
def _(t):
    return _numbered(t).select("user_id", "message_id", "session_no", "is_new")


@query("session_table", "WITH " + SESSIONS_SQL + " SELECT * FROM sessions")
def _(t):
    return _sessions(t)


@query("current_session", "WITH " + SESSIONS_SQL + " SELECT user_id, session_no, base_id, last_ts FROM cur")
def _(t):
    return S.current_session(_sessions(t), "user_id", NOW, IDLE)


@query("recent_conversations", "WITH " + SESSIONS_SQL + """
SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY s.last_ts DESC, s.session_no DESC) AS place
  FROM sessions s LEFT JOIN cur ON s.user_id=cur.user_id AND s.session_no=cur.session_no WHERE cur.user_id IS NULL) WHERE place <= 5""")
def _(t):
    sessions = _sessions(t)
    return S.recent_conversations(sessions, S.current_session(sessions, "user_id", NOW, IDLE), "user_id")


@query("conversation_archive", "WITH " + JOURNAL_SQL + """,
j AS (SELECT id, user_key, created_at, question, base_id, CASE WHEN id%3<>0 THEN cost_usd END AS cost_usd FROM journal WHERE status='ok'),
g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 480 MINUTE THEN 0 ELSE 1 END AS cold
  FROM j WINDOW w AS (PARTITION BY user_key ORDER BY created_at, id)),
i AS (SELECT *, sum(cold) OVER (PARTITION BY user_key ORDER BY created_at, id) AS island FROM g),
c AS (SELECT *, last_value(base_id IGNORE NULLS) OVER (PARTITION BY user_key, island ORDER BY created_at, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM i),
n AS (SELECT *, CAST(sum(CASE WHEN cold=1 OR (base_id IS NOT NULL AND base_id IS DISTINCT FROM cur) THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_key ORDER BY created_at, id) AS BIGINT) AS session_no FROM c)
SELECT user_key, session_no, substr(min_by(question, (created_at, id)), 1, 200) AS title, min(created_at) AS started_at,
  max(created_at) AS last_active, (list(base_id ORDER BY created_at DESC, id DESC))[1] AS base_id,
  max_by(cost_usd, (created_at, id)) FILTER (cost_usd IS NOT NULL) AS cost_total FROM n GROUP BY 1, 2""")
def _(t):
    rows = journal(t.events).filter(F.col("status") == "ok").select(
        "id", "user_key", "created_at", "question", "base_id", F.when(F.col("id") % 3 != 0, F.col("cost_usd")).alias("cost_usd"))
    numbered = S.number_sessions(rows, "user_key", "created_at", "id", "base_id", IDLE)
    return S.conversation_archive(numbered, "user_key", "created_at", "id")


@query("followup_files", "WITH " + MESSAGES_SQL + """,
s AS (SELECT *, last_value(CASE WHEN kind='text' THEN ts END IGNORE NULLS) OVER w AS tts,
  last_value(CASE WHEN kind='text' THEN message_id END IGNORE NULLS) OVER w AS text_id FROM messages
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, message_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, message_id AS file_id, text_id FROM s WHERE kind='file' AND ts - tts <= INTERVAL 3 HOUR""")
def _(t):
    return S.followup_files(messages(t.events), 3 * 3600)


@query("pending_files", "WITH " + MESSAGES_SQL + """,
s AS (SELECT *, first_value(CASE WHEN kind='text' THEN ts END IGNORE NULLS) OVER w AS tts,
  first_value(CASE WHEN kind='text' THEN message_id END IGNORE NULLS) OVER w AS text_id FROM messages
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, message_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, message_id AS file_id, text_id,
  CASE WHEN text_id IS NULL THEN 'waiting' WHEN tts - ts <= INTERVAL 360 MINUTE THEN 'attached' ELSE 'discarded' END AS state
FROM s WHERE kind='file'""")
def _(t):
    return S.pending_files(messages(t.events), 360)


@query("limit_blackout", "WITH " + JOURNAL_SQL + """,
s AS (SELECT *, last_value(CASE WHEN status='limit' THEN date_trunc('hour', created_at) + INTERVAL 1 HOUR END IGNORE NULLS)
  OVER (ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS limit_until FROM journal)
SELECT id, user_key, created_at, limit_until FROM s WHERE status<>'limit' AND created_at < limit_until""")
def _(t):
    reset = (F.date_trunc("hour", "created_at") + F.expr("interval 1 hour")).cast("timestamp_ntz")
    return S.limit_blackout(journal(t.events), reset).select("id", "user_key", "created_at", "limit_until")


BURST_SQL = MESSAGES_SQL + """,
b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR kind='command' OR lag(kind) OVER w='command' OR ts - lag(ts) OVER w >= INTERVAL 3 HOUR
  THEN 1 ELSE 0 END AS opens FROM messages WINDOW w AS (PARTITION BY user_id ORDER BY ts, message_id)),
n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, message_id) AS BIGINT) AS burst_no FROM b)
"""


@query("burst_batches", "WITH " + BURST_SQL + """
SELECT user_id, burst_no, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n,
  coalesce(string_agg(body, chr(10) ORDER BY ts, message_id) FILTER (kind<>'file'), '') AS question,
  coalesce(string_agg(CAST(message_id AS VARCHAR), ',' ORDER BY ts, message_id) FILTER (kind='file'), '') AS files
FROM n GROUP BY 1, 2""")
def _(t):
    return S.burst_questions(S.number_bursts(messages(t.events), 3 * 3600))


@query("dedup_messages", """
SELECT event_id, user_id, ts, event_type FROM events""")
def _(t):
    again = t.events.unionByName(t.events.withColumn("ts", F.expr("ts + interval 2 minutes")))
    return S.first_deliveries(again, "event_id", F.col("ts")).select("event_id", "user_id", "ts", "event_type")


@query("latest_record", """
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    return S.latest_record(t.events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id")


TICKS_SQL = JOURNAL_SQL + """,
ticks AS (SELECT coalesce(base_id,'none') AS monitor, date_trunc('hour', created_at) AS ts,
  count(*) FILTER (status IN ('error','send_error')) > 0 AS bad,
  coalesce(string_agg(DISTINCT status, ',' ORDER BY status) FILTER (status IN ('error','send_error')), '') AS problems,
  count(*) % 7 <> 0 AS sent FROM journal GROUP BY 1, 2)"""
ALERT_SQL = "WITH RECURSIVE " + TICKS_SQL + """,
o AS (SELECT *, epoch(ts)::BIGINT AS at, row_number() OVER (PARTITION BY monitor ORDER BY ts) AS rn FROM ticks),
st AS (SELECT monitor, 0::BIGINT AS rn, NULL::TIMESTAMP AS ts, false AS bad, ''::VARCHAR AS problems, 0::BIGINT AS alerted, NULL::VARCHAR AS message
    FROM (SELECT DISTINCT monitor FROM ticks)
  UNION ALL SELECT o.monitor, o.rn, o.ts, o.bad, o.problems,
    CASE WHEN o.sent AND ((o.bad AND (NOT st.bad OR o.at - st.alerted >= 21600 OR st.problems <> o.problems)) OR (NOT o.bad AND st.bad))
      THEN o.at ELSE st.alerted END,
    CASE WHEN o.bad AND (NOT st.bad OR o.at - st.alerted >= 21600 OR st.problems <> o.problems) THEN 'alert'
      WHEN NOT o.bad AND st.bad THEN 'recovered' END
  FROM st JOIN o ON o.monitor = st.monitor AND o.rn = st.rn + 1)
SELECT monitor, ts, message, problems FROM st WHERE message IS NOT NULL"""


def ticks(t):
    """Hourly state of each base: bad when an error occurred; the sent flag stands in for delivery."""
    bad = F.col("status").isin("error", "send_error")
    return (journal(t.events).groupBy(F.coalesce("base_id", F.lit("none")).alias("monitor"),
                                      F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("ts"))
            .agg((F.count_if(bad) > 0).alias("bad"),
                 F.array_join(F.sort_array(F.collect_set(F.when(bad, F.col("status")))), ",").alias("problems"),
                 (F.count("*") % 7 != 0).alias("sent")))


@query("alert_machine", ALERT_SQL)
def _(t):
    return S.alert_machine(ticks(t), 6 * 3600)
