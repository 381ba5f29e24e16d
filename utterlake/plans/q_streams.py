"""Queries that run the streaming forms over the given tables, fed as files that follow each other; their statements are
those of the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive as ad
from ..operators import takes as ta
from ..sources import files as fi
from ..streaming import keyed as ky
from ..streaming import sources as so
from ..streaming import windows as wi
from ..streaming.session_logs import session_frames
from ..tables import shared_folder, written
from . import q_gates, q_scoring, q_series, q_sessions
from . import views as v
from .q_scoring import r6
from .views import sql, with_sql


def frames(spark, d):
    return v.frames(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


def events(spark, d):
    return v.session_events(spark, d)


def timed_waves(spark, d):
    """The waves with an event time, a second a sample."""
    return v.waves(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n")))


def endpoint_stream(spark, d):
    return so.replay(frames(spark, d), "ts", lambda s: ky.endpoint_stream(s, q_sessions.RULES)).drop("batch")


def gate_stream(spark, d):
    return so.replay(frames(spark, d), "ts", lambda s: ky.gate_stream(s, **q_gates._GATE)).drop("batch")


def frame_stream(spark, d):
    found = so.replay(timed_waves(spark, d), "n", lambda s: ky.frame_stream(s, 16, 6))
    return found.select("key", "frame", F.round(F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x * x), 6).alias("energy"))


def metrics_stream(spark, d):
    rows = v.stages(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    found = so.replay(rows, "at", ky.metrics_stream)
    last = found.groupBy("stage").agg(F.max_by(F.struct("total", "count", "p50", "p95", "last"), "total").alias("m"))
    return last.select("stage", "m.total", "m.count", *[F.round(f"m.{c}", 1).alias(c) for c in ("p50", "p95", "last")])


def session_state_stream(spark, d):
    found = so.replay(events(spark, d), "ts", ky.session_state_stream)
    return found.select("session", "event_id", "state", F.round("dwell_s", 3).alias("dwell_s"))


def barge_in_stream(spark, d):
    return so.replay(events(spark, d), "ts", ky.barge_in_stream).drop("batch")


def telemetry_stream(spark, d):
    """In update mode a window's last row is the one with all its frames."""
    found = so.replay(frames(spark, d), "ts", wi.telemetry_stream, mode="update")
    last = found.groupBy("key", "start").agg(F.max_by(F.struct("p", "n"), "n").alias("m"))
    return last.select("key", F.col("start").cast("double").alias("start"), F.round("m.p", 6).alias("p"), "m.n")


def telemetry_sliding_stream(spark, d):
    found = so.replay(frames(spark, d), "ts", lambda s: wi.telemetry_stream(s, "2 hours", "1 hour"), mode="update")
    last = found.groupBy("key", "start").agg(F.max_by(F.struct("p", "n"), "n").alias("m"))
    return last.select("key", F.col("start").cast("double").alias("start"), F.round("m.p", 6).alias("p"), "m.n")


def take_stream(spark, d):
    """The takes that the watermark has closed: those that end before the last event less the delay."""
    found = so.replay(frames(spark, d).where("p >= 0.4"), "ts", wi.takes)
    return found.select("key", F.col("start").cast("double").alias("start"), F.round(F.col("end").cast("double"), 3).alias("end"), "n")


def takes(spark, d):
    found = wi.takes(frames(spark, d).where("p >= 0.4"))
    return found.select("key", F.round(F.col("start").cast("double"), 3).alias("start"), F.round(F.col("end").cast("double"), 3).alias("end"), "n")


def _late(spark, d):
    """The folders of the main and the side output of one run: every tenth frame of a key comes once more, a month later
    than it was due."""
    f = frames(spark, d).withColumn("due", F.col("ts"))
    again = f.where("seq % 10 = 3").withColumn("due", F.col("due") + F.expr("INTERVAL 30 DAYS"))
    rows, base = f.unionByName(again), shared_folder(spark, "late")
    files = so.write_slices(rows, f"{base}/in", "due", 3)
    so.append_split(ky.tag_late(so.event_source(spark, f"{base}/in", rows.schema, files), "due"), "late", f"{base}/main", f"{base}/side", f"{base}/checkpoint")
    return f"{base}/main", f"{base}/side"


def late_side_output(spark, d):
    return spark.read.schema("key long, seq long").parquet(_late(spark, d)[1]).select("key", "seq")


def late_main_output(spark, d):
    return spark.read.schema("key long, seq long").parquet(_late(spark, d)[0]).select("key", "seq")


HOUR = 3_600_000_000
TAKE_RULES = ta.TakeRules(quiet=24 * HOUR, lead=12 * HOUR, most=36 * HOUR, min_on=1, min_off=1)


def timed_takes(spark, d):
    return ta.timed_takes(frames(spark, d), TAKE_RULES)


def timed_take_stream(spark, d):
    """Those of ``timed_takes`` that a later frame or the watermark has closed: a key's last take stays open unless its
    deadline lies behind the last event by more than the delay."""
    return so.replay(frames(spark, d), "ts", lambda s: ky.take_stream(s, TAKE_RULES)).drop("batch")


def clean_series(spark, d):
    found = ad.clean_series(v.waves(spark, d), 16)
    return found.select("key", "n", *r6("x", "gain"))


def clean_series_identity(spark, d):
    """Cleaning that takes nothing away."""
    found = ad.clean_series(v.waves(spark, d), 16, 0.0)
    return found.select("key", "n", *r6("x", "gain"))


def clean_stream(spark, d):
    found = so.replay(timed_waves(spark, d), "n", lambda s: ky.clean_stream(s, 16))
    return found.select("key", "n", *r6("x", "gain"))


def clean_stream_identity(spark, d):
    found = so.replay(timed_waves(spark, d), "n", lambda s: ky.clean_stream(s, 16, 0.0))
    return found.select("key", "n", *r6("x"))


def append_stream(spark, d):
    """Two runs of one stream on one checkpoint: the second finds nothing new, and every row is there once."""
    rows = v.stages(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    base = shared_folder(spark, "append")
    files = so.write_slices(rows, f"{base}/in", "at", 3)
    for _ in range(2):
        so.append_committed(so.event_source(spark, f"{base}/in", rows.schema, files), f"{base}/out", f"{base}/checkpoint")
    return fi.read_committed(spark, f"{base}/out", "event_id long, stage string, ms double").select("event_id", "stage", *r6("ms"))


def session_source(spark, d):
    """The frames as a service logs them, a set of files for each slice with many sessions to a file, read by a source with
    offsets of its own. The number of files follows that of the rows, not that of the sessions."""
    rows = written(frames(spark, d).select(F.col("key").alias("session"), "seq", F.unix_micros("ts").alias("us"), "p"), "frames")
    base, files = shared_folder(spark, "sessions"), max(1, rows.count() // 250_000)
    stream, query = None, None
    for low, high in ((0, 20), (20, 1 << 40)):
        part = rows.where((F.col("seq") >= low) & (F.col("seq") < high)).repartition(files, "session").sortWithinPartitions("session", "seq")
        part.select(F.to_json(F.struct("session", "seq", "us", "p")).alias("value")).write.mode("append").text(f"{base}/in")
        if query is None:
            stream = session_frames(spark, f"{base}/in")
            query = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").format("parquet").start(f"{base}/out")
        query.processAllAvailable()
    query.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select("session", "seq", *r6("p"))


def align_stream(spark, d):
    from pyspark.sql import types as T

    waves = v.waves(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n")))
    base = shared_folder(spark, "align")
    files = so.write_slices(waves, f"{base}/in", "ts", 2)
    pair = [so.event_source(spark, f"{base}/in", waves.schema, files) for _ in range(2)]
    stream = wi.align_stream(pair[0], pair[1], 3)
    so.append_batches(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(T.StructType(stream.schema.fields)).parquet(f"{base}/out").select("key", "n", *r6("raw", "x"))


def levels():
    """Rounded a little off the ties, which sums of few decimals do reach."""
    return [F.round(F.col(c) + 3e-11, 9).alias(c) for c in ("smoothed", "floor", "noise")]


def ema_floor(spark, d):
    found = ad.ema_floor(v.frames(spark, d).select("key", "seq", F.col("p").alias("x")))
    return found.select("key", "seq", *levels(), "present")


def floor_stream(spark, d):
    found = so.replay(frames(spark, d).withColumn("x", F.col("p")), "ts", ky.floor_stream)
    return found.select("key", "seq", *levels(), "present")


_FLOOR = """WITH RECURSIVE f AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, least(value / 100, 1.0) AS x FROM events),
r AS (SELECT DISTINCT key, CAST(-1 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS l, false AS present FROM f
UNION ALL SELECT key, seq, s2, m2, s2, q2, CASE WHEN seq < 6 THEN s2 ELSE least(h * l + (1 - h) * x, CAST(1.5 AS DOUBLE) * m2) END, pr FROM (
 SELECT *, CAST(0.95 AS DOUBLE) + (1 - CAST(0.95 AS DOUBLE)) * q2 AS h FROM (
  SELECT *, CASE WHEN seq < 6 THEN q ELSE CAST(0.2 AS DOUBLE) * q + (1 - CAST(0.2 AS DOUBLE)) * CAST(pr AS INTEGER) END AS q2 FROM (
   SELECT *, seq >= 6 AND s2 / greatest(m2, CAST(1e-12 AS DOUBLE)) > 2 AS pr FROM (
    SELECT *, CASE WHEN seq < 6 OR m >= s2 THEN s2 ELSE CAST(0.998 AS DOUBLE) * m + (1 - CAST(0.998 AS DOUBLE)) / (1 - CAST(0.96 AS DOUBLE)) * (s2 - CAST(0.96 AS DOUBLE) * b) END AS m2 FROM (
     SELECT f.key, f.seq, f.x, r.m, r.b, r.q, r.l, CASE WHEN f.seq < 6 THEN r.l + (f.x - r.l) / (f.seq + 1) ELSE CAST(0.8 AS DOUBLE) * r.s + (1 - CAST(0.8 AS DOUBLE)) * f.x END AS s2 FROM r JOIN f ON f.key = r.key AND f.seq = r.seq + 1))))))
SELECT key, seq, round(s + CAST(3e-11 AS DOUBLE), 9) AS smoothed, round(m + CAST(3e-11 AS DOUBLE), 9) AS floor, round(l + CAST(3e-11 AS DOUBLE), 9) AS noise, present FROM r WHERE seq >= 0"""
_TIMED = """WITH RECURSIVE f AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) AS us, least(value / 100, 1.0) AS p FROM events),
t AS (SELECT DISTINCT key, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS seen, CAST(0 AS BIGINT) AS n, false AS act, CAST(NULL AS BIGINT) AS ca, CAST(NULL AS BIGINT) AS cseen, CAST(0 AS BIGINT) AS cn FROM f
UNION ALL SELECT key, seq, CASE WHEN fresh THEN us ELSE a END, CASE WHEN act2 THEN us WHEN fresh THEN NULL ELSE seen END, CASE WHEN fresh THEN 1 ELSE n + 1 END, act2, CASE WHEN fresh THEN a END, CASE WHEN fresh THEN seen END, CASE WHEN fresh THEN n ELSE 0 END
FROM (SELECT *, CASE WHEN p > 0.6 THEN true WHEN p < 0.4 THEN false ELSE act AND NOT fresh END AS act2 FROM (
  SELECT f.key, f.seq, f.us, f.p, t.a, t.seen, t.n, t.act, t.a IS NULL OR f.us >= least(t.a + 36 * h, coalesce(t.seen + 24 * h, t.a + 12 * h)) AS fresh FROM t JOIN f ON f.key = t.key AND f.seq = t.seq + 1, (SELECT CAST(3600000000 AS BIGINT) AS h)))),
l AS (SELECT key, max(seq) AS seq FROM t GROUP BY key),
c AS (SELECT key, ca AS a, cseen AS seen, cn AS n, false AS final FROM t WHERE ca IS NOT NULL UNION ALL SELECT t.key, t.a, t.seen, t.n, true FROM t JOIN l USING (key, seq)),
o AS (SELECT key, a AS start, least(a + 36 * h, coalesce(seen + 24 * h, a + 12 * h)) AS "end", CASE WHEN seen IS NULL THEN 'nothing heard' WHEN a + 36 * h <= seen + 24 * h THEN 'cap' ELSE 'quiet' END AS reason, n AS n_frames, final FROM c, (SELECT CAST(3600000000 AS BIGINT) AS h))
SELECT key, start, "end", reason, n_frames FROM o"""
_TAKES = """a AS (SELECT key, ts, ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) >= INTERVAL 30 MINUTE AS fresh FROM frames WHERE p >= 0.4),
b AS (SELECT *, count(*) FILTER (coalesce(fresh, true)) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS take FROM a),
c AS (SELECT key, round(epoch_us(min(ts)) / 1e6, 3) AS start, round(epoch_us(max(ts)) / 1e6 + 1800, 3) AS "end", count(*) AS n FROM b GROUP BY key, take)"""

QUERIES = {f.__name__: f for f in (endpoint_stream, gate_stream, frame_stream, metrics_stream, session_state_stream, barge_in_stream, telemetry_stream, telemetry_sliding_stream, takes, take_stream, timed_takes, timed_take_stream, late_side_output, late_main_output, clean_series, clean_series_identity, clean_stream, clean_stream_identity, append_stream, session_source, align_stream, ema_floor, floor_stream)}
ORACLE_SQL = {
    "endpoint_stream": q_sessions.ORACLE_SQL["endpoint_batch"],
    "gate_stream": q_gates.ORACLE_SQL["hysteresis_gate"],
    "frame_stream": sql("SELECT key, f AS frame, round(sum(x * x), 6) AS energy FROM waves, (SELECT unnest(range(64)) AS f) WHERE n >= f * 6 AND n < f * 6 + 16 GROUP BY key, f HAVING count(*) = 16", "waves"),
    "metrics_stream": f"SELECT t.total, m.* FROM ({q_scoring.ORACLE_SQL['latency_summary']}) m JOIN (SELECT event_type AS stage, count(*) AS total FROM events GROUP BY 1) t USING (stage)",
    "session_state_stream": f"SELECT * FROM ({q_sessions.ORACLE_SQL['session_states']}) WHERE dwell_s IS NOT NULL",
    "barge_in_stream": q_sessions.ORACLE_SQL["barge_in"],
    "telemetry_stream": q_sessions.ORACLE_SQL["telemetry_mean"],
    "telemetry_sliding_stream": q_sessions.ORACLE_SQL["telemetry_sliding"],
    "takes": with_sql(_TAKES + " SELECT * FROM c", "frames"),
    "late_side_output": sql("SELECT key, seq FROM frames WHERE seq % 10 = 3", "frames"),
    "late_main_output": sql("SELECT key, seq FROM frames", "frames"),
    "timed_takes": _TIMED,
    "timed_take_stream": _TIMED + """ WHERE NOT final OR "end" < (SELECT max(epoch_us(ts)) - 600000000 FROM events)""",
    "clean_series_identity": sql("SELECT key, n, round(x, 6) AS x, CAST(1.0 AS DOUBLE) AS gain FROM waves", "waves"),
    "clean_stream_identity": sql("SELECT key, n, round(x, 6) AS x FROM waves WHERE n < 56", "waves"),
    "append_stream": "SELECT event_id, event_type AS stage, round(value, 6) AS ms FROM events",
    "session_source": sql("SELECT key AS session, seq, round(p, 6) AS p FROM frames", "frames"),
    "align_stream": sql("SELECT a.key, b.n, round(a.x, 6) AS raw, round(b.x, 6) AS x FROM waves a JOIN waves b ON a.key = b.key AND b.n = a.n + 3", "waves"),
    "ema_floor": _FLOOR,
    "floor_stream": _FLOOR,
}
