"""Queries of the gates and decoding operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gates
from . import views as v
from .views import sql, with_sql

_GATE = {"on": 0.4, "off": 0.3, "min_on": 2, "min_off": 2}


def gated(spark, d):
    return gates.hysteresis_gate(v.frames(spark, d), **_GATE)


def hysteresis_gate(spark, d):
    return gated(spark, d).select("key", "seq", "active")


def segments(spark, d):
    return gates.segments(gated(spark, d)).select("key", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def collapse_runs(spark, d):
    return gates.collapse_runs(v.frames(spark, d)).select("key", F.array_join("labels", ",").alias("labels"))


def levels(spark, d):
    """Frames with a level in dB from p."""
    return v.frames(spark, d).withColumn("db", 20 * F.log10(F.col("p") + 1e-12))


def energy_gate(spark, d):
    return gates.energy_gate(levels(spark, d), below=12.0).select("key", "seq", "active")


def dilate(spark, d):
    return gates.dilate(gates.energy_gate(levels(spark, d), below=6.0)).select("key", "seq", "active")


def trim_to_active(spark, d):
    g = gated(spark, d)
    lengths = g.groupBy("key").agg((F.count("*") * 0.01).alias("length_s"))
    return gates.trim_to_active(gates.segments(g), lengths).select("key", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def run_triggers(spark, d):
    return gates.run_triggers(v.frames(spark, d), 0.5, 64, 32).select("key", "seq")


def envelope_mask(spark, d):
    return gates.envelope_mask(v.waves(spark, d), taps=8, share=0.2).groupBy("key").agg(F.count_if(F.col("active")).alias("n_active"))


def adjacent_repeats(spark, d):
    return gates.adjacent_repeats(v.frames(spark, d))


def scored(spark, d):
    """Five label scores a frame, spread from p."""
    f = v.frames(spark, d)
    scores = F.array(*[F.pmod(F.col("p") * (k + 1) * 7.3, F.lit(1.0)) for k in range(5)])
    return f.select("key", "seq", F.posexplode(scores).alias("label", "score")).withColumn("label", F.col("label").cast("long")).withColumn("score", F.round("score", 6))


def topk_per_frame(spark, d):
    return gates.topk_per_frame(scored(spark, d), 2).select("key", "seq", "label", "rank")


def greedy_decode(spark, d):
    out = gates.collapse_runs(gates.greedy_decode(scored(spark, d)))
    return out.select("key", tx.char_decode(F.col("labels")).alias("text"))


def blank_fraction(spark, d):
    return gates.blank_fraction(v.frames(spark, d)).select("key", F.round("blank", 6).alias("blank"), "verdict")


_RUNS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM frames),
runs_of AS (SELECT *, rn - coalesce(max(CASE WHEN NOT (p > 0.4) THEN rn END) OVER w, 0) AS up, rn - coalesce(max(CASE WHEN NOT (p < 0.3) THEN rn END) OVER w, 0) AS down FROM numbered WINDOW w AS (PARTITION BY key ORDER BY seq)),
gated AS (SELECT key, seq, coalesce(last_value(CASE WHEN up = 2 THEN true WHEN down = 2 THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS active FROM runs_of)"""
_SEGS = _RUNS + """, opened AS (SELECT *, CASE WHEN active AND NOT coalesce(lag(active) OVER (PARTITION BY key ORDER BY seq), false) THEN 1 ELSE 0 END AS o FROM gated),
numbered2 AS (SELECT *, sum(o) OVER (PARTITION BY key ORDER BY seq) AS s FROM opened),
segs AS (SELECT key, min(seq) * CAST(0.01 AS DOUBLE) AS start_s, (max(seq) + 1) * CAST(0.01 AS DOUBLE) AS end_s FROM numbered2 WHERE active GROUP BY key, s)"""
_LEVELS = "levels AS (SELECT key, seq, 20 * log10(p + 1e-12) AS db FROM frames)"
_SCORED = "scored AS (SELECT key, seq, k AS label, round(CAST(fmod(p * (k + 1) * 7.3, 1.0) AS DOUBLE), 6) AS score FROM frames, (SELECT unnest(range(5)) AS k))"
_COLLAPSE = "(SELECT key, seq, label, lag(label) OVER (PARTITION BY key ORDER BY seq) AS b FROM {t})"

QUERIES = {f.__name__: f for f in (hysteresis_gate, segments, collapse_runs, energy_gate, dilate, trim_to_active, run_triggers, envelope_mask, adjacent_repeats, topk_per_frame, greedy_decode, blank_fraction)}
ORACLE_SQL = {
    "hysteresis_gate": with_sql(_RUNS + " SELECT key, seq, active FROM gated", "frames"),
    "segments": with_sql(_SEGS + " SELECT key, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM segs", "frames"),
    "collapse_runs": sql("SELECT key, coalesce(string_agg(CAST(label AS VARCHAR), ',' ORDER BY seq) FILTER ((b IS NULL OR b <> label) AND label <> 0), '') AS labels FROM " + _COLLAPSE.format(t="frames") + " GROUP BY key", "frames"),
    "energy_gate": with_sql(_LEVELS + " SELECT key, seq, db > max(db) OVER (PARTITION BY key) - 12 AS active FROM levels", "frames"),
    "dilate": with_sql(_LEVELS + ", a AS (SELECT key, seq, db > max(db) OVER (PARTITION BY key) - 6 AS x FROM levels) SELECT key, seq, bool_or(x) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS active FROM a", "frames"),
    "trim_to_active": with_sql(_SEGS + """, n AS (SELECT key, count(*) * CAST(0.01 AS DOUBLE) AS length_s FROM frames GROUP BY key), s AS (SELECT key, min(start_s) AS a, max(end_s) AS b FROM segs GROUP BY key)
        SELECT key, round(CASE WHEN a IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), a - CAST(0.1 AS DOUBLE)) END, 6) AS start_s, round(CASE WHEN b IS NOT NULL THEN least(length_s, b + CAST(0.1 AS DOUBLE)) END, 6) AS end_s FROM n LEFT JOIN s USING (key)""", "frames"),
    "run_triggers": with_sql("""m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM frames),
        r AS (SELECT *, rn - coalesce(max(CASE WHEN NOT (p >= 0.5) THEN rn END) OVER (PARTITION BY key ORDER BY seq), 0) AS run FROM m) SELECT key, seq FROM r WHERE run = 2""", "frames"),
    "envelope_mask": with_sql("""e AS (SELECT key, sum(x * x) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 AS v FROM waves),
        a AS (SELECT key, v > 0.2 * max(v) OVER (PARTITION BY key) AS active FROM e) SELECT key, count(*) FILTER (active) AS n_active FROM a GROUP BY key""", "waves"),
    "adjacent_repeats": sql("SELECT key, count(*) FILTER (label = b) AS repeats FROM " + _COLLAPSE.format(t="frames") + " GROUP BY key", "frames"),
    "topk_per_frame": with_sql(_SCORED + " SELECT key, seq, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY key, seq ORDER BY score DESC, label) AS rank FROM scored) WHERE rank <= 2", "frames"),
    "greedy_decode": with_sql(_SCORED + """, g AS (SELECT key, seq, label FROM (SELECT *, row_number() OVER (PARTITION BY key, seq ORDER BY score DESC, label) AS rank FROM scored) WHERE rank = 1)
        SELECT key, coalesce(string_agg(substr(' abcdefghijklmnopqrstuvwxyz', label, 1), '' ORDER BY seq) FILTER ((b IS NULL OR b <> label) AND label <> 0), '') AS text FROM """ + _COLLAPSE.format(t="g") + " GROUP BY key", "frames"),
    "blank_fraction": with_sql("""b AS (SELECT key, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS blank FROM frames GROUP BY key)
        SELECT key, round(blank, 6) AS blank, CASE WHEN blank > 0.995 THEN 'collapsed' WHEN blank < 0.99 THEN 'healthy' ELSE 'borderline' END AS verdict FROM b""", "frames"),
}
