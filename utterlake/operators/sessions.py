"""Turn analytics over typed session events (session, ts, event_id, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The state that each event type leads to.
STATE_OF = {"speech_start": "USER_SPEAKING", "speech_end": "THINKING", "tts_start": "SPEAKING", "reply_done": "LISTENING", "interrupted": "USER_SPEAKING", "error": "LISTENING", "empty": "LISTENING"}


def _order():
    return Window.partitionBy("session").orderBy("ts", "event_id")


def session_states(events: DataFrame) -> DataFrame:
    """session, ts, event_id, state, dwell_s: a row where the state changes, and how long it stays (NULL for the last)."""
    state = F.create_map(*[F.lit(x) for p in STATE_OF.items() for x in p])[F.col("type")]
    rows = events.withColumn("state", state).where("state is not null")
    rows = rows.withColumn("__before", F.lag("state").over(_order())).where("__before is null or __before <> state")
    dwell = F.lead("ts").over(_order()).cast("double") - F.col("ts").cast("double")
    return rows.select("session", "ts", "event_id", "state", dwell.alias("dwell_s"))


def replies(events: DataFrame) -> DataFrame:
    """session, start, end: from each speech_end to the next reply_done (open ones have end NULL)."""
    rows = events.where(F.col("type").isin("speech_end", "reply_done"))
    follow = rows.withColumn("__next", F.lead("type").over(_order())).withColumn("end", F.lead("ts").over(_order()))
    return follow.where("type = 'speech_end'").select("session", F.col("ts").alias("start"), F.when(F.col("__next") == "reply_done", F.col("end")).alias("end"))


def barge_ins(events: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """session, start, ts: user speech that starts inside a reply. Replies are cut into time buckets, so the interval
    join is an equi join on session and bucket; the exact test follows."""
    spans = replies(events).where("end is not null")
    b = lambda c: F.floor(F.col(c).cast("double") / bucket_s).cast("long")
    spans = spans.withColumn("bucket", F.explode(F.sequence(b("start"), b("end"))))
    starts = events.where("type = 'speech_start'").select("session", "ts", "event_id", b("ts").alias("bucket"))
    joined = starts.join(spans, ["session", "bucket"]).where("ts >= start and ts < end")
    return joined.select("session", "start", "ts", "event_id")


def turn_latency(events: DataFrame) -> DataFrame:
    """session, ts, turnaround_ms: from each speech_end to the first tts_start before the next speech_end."""
    rows = events.withColumn("turn", F.count_if(F.col("type") == "speech_end").over(_order())).where("turn > 0")
    found = rows.groupBy("session", "turn").agg(F.min(F.when(F.col("type") == "speech_end", F.col("ts"))).alias("ts"), F.min(F.when(F.col("type") == "tts_start", F.col("ts"))).alias("first"))
    return found.where("first is not null").select("session", "ts", F.round((F.col("first").cast("double") - F.col("ts").cast("double")) * 1000, 3).alias("turnaround_ms"))


def history_window(turns: DataFrame, max_turns: int = 20) -> DataFrame:
    """conv_id, turn, history of each user turn: the last 2 * max_turns messages, the turn itself included."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-(2 * max_turns - 1), 0)
    rows = turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))
    return rows.where("role = 'user'").select("conv_id", "turn", "history")


def telemetry_mean(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """key, start, mean of p in tumbling or sliding windows of event time."""
    w = F.window(F.col("ts").cast("timestamp"), size, slide) if slide else F.window(F.col("ts").cast("timestamp"), size)
    return events.groupBy("key", w.alias("w")).agg(F.avg("p").alias("p"), F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), "p", "n")
