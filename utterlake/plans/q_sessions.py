"""Queries of endpoints and turn analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import endpoint as ep
from ..operators import sessions as se
from . import views as v
from .q_scoring import r6
from .views import sql, with_sql

RULES = ep.EndpointRules(start=2, end=2, pre_roll=2, cap=8, least=6)


def endpoint_batch(spark, d):
    return ep.endpoints(v.frames(spark, d), RULES)


def events(spark, d):
    return v.session_events(spark, d)


def session_states(spark, d):
    return se.session_states(events(spark, d)).select("session", "event_id", "state", F.round("dwell_s", 3).alias("dwell_s"))


def barge_in(spark, d):
    return se.barge_ins(events(spark, d)).select("session", "event_id")


def turn_latency(spark, d):
    return se.turn_latency(events(spark, d)).select("session", F.round(F.col("ts").cast("double"), 3).alias("ended"), "turnaround_ms")


def history_window(spark, d):
    h = se.history_window(v.table(spark, d, "conversations"), 2)
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n"), F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["role"], F.length(x["text"]).cast("string"))), ",").alias("roles"))


def telemetry_mean(spark, d):
    return se.telemetry_mean(v.frames(spark, d)).select("key", F.col("start").cast("double").alias("start"), *r6("p"), "n")


def telemetry_sliding(spark, d):
    return se.telemetry_mean(v.frames(spark, d), "2 hours", "1 hour").select("key", F.col("start").cast("double").alias("start"), *r6("p"), "n")


_STATES = """m AS (SELECT *, CASE type WHEN 'speech_start' THEN 'USER_SPEAKING' WHEN 'speech_end' THEN 'THINKING' WHEN 'tts_start' THEN 'SPEAKING' WHEN 'reply_done' THEN 'LISTENING' WHEN 'interrupted' THEN 'USER_SPEAKING' END AS state FROM session_events),
c AS (SELECT *, lag(state) OVER (PARTITION BY session ORDER BY ts, event_id) AS b FROM m)"""
_ENDPOINT = """WITH RECURSIVE f AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, least(value / 100, 1.0) AS p FROM events),
s AS (SELECT DISTINCT key, CAST(-1 AS BIGINT) AS seq, false AS o, 0 AS sp, 0 AS si, 0 AS held, 0 AS len, CAST(0 AS BIGINT) AS fst, CAST(NULL AS VARCHAR) AS event, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM f
UNION ALL SELECT key, seq, CASE WHEN NOT o THEN sp2 >= 2 ELSE NOT closed END, CASE WHEN NOT o AND sp2 < 2 THEN sp2 ELSE 0 END, CASE WHEN o AND NOT closed THEN si2 ELSE 0 END,
  CASE WHEN NOT o THEN h2 WHEN closed THEN 0 ELSE held END, CASE WHEN NOT o THEN CASE WHEN sp2 >= 2 THEN h2 ELSE 0 END WHEN closed THEN 0 ELSE len + 1 END, CASE WHEN NOT o AND sp2 >= 2 THEN seq - h2 + 1 WHEN o AND NOT closed THEN fst ELSE 0 END,
  CASE WHEN NOT o AND sp2 >= 2 THEN 'START' WHEN o AND closed THEN CASE WHEN kept < 6 THEN 'DISCARD' ELSE 'END' END END, CASE WHEN NOT o THEN seq - h2 + 1 ELSE fst END, CASE WHEN NOT o THEN seq + 1 ELSE fst + kept END
FROM (SELECT *, si2 >= 2 OR len + 1 >= 8 AS closed, CASE WHEN si2 >= 2 THEN least(len + 1, greatest(0, len + 2)) ELSE len + 1 END AS kept FROM (
  SELECT f.key, f.seq, s.o, s.sp, s.held, s.len, s.fst, CASE WHEN f.p >= 0.5 THEN s.sp + 1 ELSE 0 END AS sp2, CASE WHEN f.p < 0.35 THEN s.si + 1 ELSE 0 END AS si2, least(s.held + 1, 4) AS h2 FROM s JOIN f ON f.key = s.key AND f.seq = s.seq + 1)))
SELECT key, event, a AS start_seq, b AS end_seq, b - a AS n_windows FROM s WHERE event IS NOT NULL"""

QUERIES = {f.__name__: f for f in (endpoint_batch, session_states, barge_in, turn_latency, history_window, telemetry_mean, telemetry_sliding)}
ORACLE_SQL = {
    "endpoint_batch": _ENDPOINT,
    "session_states": with_sql(_STATES + " SELECT session, event_id, state, round(epoch_us(lead(ts) OVER (PARTITION BY session ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6, 3) AS dwell_s FROM c WHERE b IS NULL OR b <> state", "session_events"),
    "barge_in": with_sql("""r AS (SELECT session, type, ts AS a, lead(type) OVER w AS nt, lead(ts) OVER w AS e FROM session_events WHERE type IN ('speech_end', 'reply_done') WINDOW w AS (PARTITION BY session ORDER BY ts, event_id))
        SELECT s.session, s.event_id FROM session_events s JOIN r ON r.session = s.session AND r.type = 'speech_end' AND r.nt = 'reply_done' AND s.ts >= r.a AND s.ts < r.e WHERE s.type = 'speech_start'""", "session_events"),
    "turn_latency": with_sql("""t AS (SELECT *, count(*) FILTER (type = 'speech_end') OVER (PARTITION BY session ORDER BY ts, event_id) AS turn FROM session_events),
        g AS (SELECT session, min(ts) FILTER (type = 'speech_end') AS ts, min(ts) FILTER (type = 'tts_start') AS f FROM t WHERE turn > 0 GROUP BY session, turn)
        SELECT session, round(epoch_us(ts) / 1e6, 3) AS ended, round((epoch_us(f) / 1e6 - epoch_us(ts) / 1e6) * 1000, 3) AS turnaround_ms FROM g WHERE f IS NOT NULL""", "session_events"),
    "history_window": """SELECT conv_id, turn, len(h) AS n, array_to_string(h, ',') AS roles FROM (SELECT conv_id, turn, role, list(role || ':' || length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h FROM conversations) WHERE role = 'user'""",
    "telemetry_mean": sql("SELECT key, epoch(date_trunc('hour', ts)) AS start, round(avg(p), 6) AS p, count(*) AS n FROM frames GROUP BY 1, 2", "frames"),
    "telemetry_sliding": sql("SELECT key, epoch(date_trunc('hour', ts)) - k * 3600 AS start, round(avg(p), 6) AS p, count(*) AS n FROM frames, (SELECT unnest(range(2)) AS k) GROUP BY 1, 2", "frames"),
}
