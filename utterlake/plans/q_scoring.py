"""Queries of text functions and scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio as au
from ..functions import text as tx
from ..operators import scoring as sc
from . import views as v
from .views import norm_sql, sql, with_sql


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def docs(spark, d):
    return v.table(spark, d, "documents")


def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", tx.normalize(F.col("text")).alias("norm"))


def char_encode(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(tx.char_encode(F.col("text")), ",").alias("ids"))


def char_decode(spark, d):
    return docs(spark, d).select("doc_id", tx.char_decode(tx.char_encode(F.col("text"))).alias("text"))


def split_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


def length_window(spark, d):
    return v.sentence_rows(spark, d)


def char_ngrams(spark, d):
    grams = v.sentence_rows(spark, d).select("doc_id", "pos", F.explode(tx.char_ngrams(F.col("norm"))).alias("gram"))
    return grams


def rtf(spark, d):
    return docs(spark, d).select("doc_id", F.round(au.rtf(F.col("doc_id") * 1.5, F.col("n_chars") / 15.0), 9).alias("rtf"))


def strip_punct(spark, d):
    return v.sentence_rows(spark, d).select("doc_id", "pos", tx.strip_punct(F.col("sentence")).alias("plain"))


def duration_filter(spark, d):
    """Durations are kept as characters, 15 a second: the bounds go to the stored column, and so to the files."""
    return v.manifest(spark, d, F.col("n_chars").between(30 * 15, 200 * 15)).select("path", F.round("duration", 6).alias("duration"))


def group_key_from_path(spark, d):
    return v.manifest(spark, d).select("path", F.regexp_extract("path", r"([^/]*?)-[^/]*$", 1).alias("group"), F.element_at(F.split("path", "/"), -2).alias("folder"))


def frame_count(spark, d):
    n = au.frame_count(F.col("duration"))
    return v.manifest(spark, d).select("doc_id", n.alias("frames"), au.conv_length(n).alias("conv"), au.half_length(n).alias("half"))


def hz_mel(spark, d):
    mel = au.hz_to_mel(F.col("n_chars").cast("double"))
    return docs(spark, d).select("doc_id", F.round(mel, 6).alias("mel"), F.round(au.mel_to_hz(mel), 4).alias("hz"))


def db_convert(spark, d):
    return v.frames(spark, d).select("key", "seq", F.round(au.level_db(F.col("p")), 6).alias("db"), F.round(au.gain(F.col("p") * 18), 6).alias("gain"))


def clip_levels(spark, d):
    from pyspark.sql import Window

    peak = F.max(F.abs("x")).over(Window.partitionBy("key"))
    return v.waves(spark, d).select("key", "n", F.round(au.clip(F.col("x") * 4), 6).alias("clipped"), F.round(F.col("x") / peak, 6).alias("normal"))


def cer(spark, d):
    return v.hyp_ref(spark, d).select("conv_id", "turn", F.round(tx.cer(F.col("hyp"), F.col("ref")), 6).alias("cer"))


def wer(spark, d):
    return sc.with_errors(v.hyp_ref(spark, d)).select("conv_id", "turn", "word_errors", F.round("wer", 6).alias("wer"))


def corpus_wer(spark, d):
    return sc.corpus_wer(v.hyp_ref(spark, d)).select(*r6("wer"))


def engine_leaderboard(spark, d):
    pairs = v.hyp_ref(spark, d).withColumn("seconds", F.length("hyp") / 100.0).withColumn("audio_s", F.length("ref") / 15.0)
    return sc.engine_leaderboard(pairs).select("engine", "n", *r6("wer", "cer", "rtf"))


def scenarios(spark, d):
    """scenario, engine, p"""
    f = v.frames(spark, d)
    return f.select(F.concat(F.lit("type"), F.col("label").cast("string")).alias("scenario"), F.concat(F.lit("e"), (F.col("key") % 3).cast("string")).alias("engine"), "p")


def scenario_pivot(spark, d):
    return sc.scenario_pivot(scenarios(spark, d), ["e0", "e1", "e2"], ["type0", "type4"]).select("scenario", *r6("e0", "e1", "e2"), "expect_high")


def scenario_score(spark, d):
    return sc.single_score(scenarios(spark, d), ["type0", "type4"]).select("engine", *r6("score"))


def latency_summary(spark, d):
    return sc.latency_summary(v.stages(spark, d))


def rolling_stage_percentile(spark, d):
    return sc.rolling_percentile(v.stages(spark, d), 0.95, 50).select("event_id", "stage", "pct")


def event_counters(spark, d):
    return sc.event_counters(v.session_events(spark, d))


def run_selection(spark, d):
    return sc.run_selection(v.runs(spark, d)).select("run", *r6("best"), "best_step", *r6("median", "spread", "floor"), "wide")


def best_k_runs(spark, d):
    return sc.best_k_runs(v.runs(spark, d), 20).select("run", "step", *r6("metric"))


def score_histogram(spark, d):
    rows = v.frames(spark, d).select("label", F.col("p").alias("score"))
    return sc.score_histogram(rows, 0.0, 1.0, 60).select("label", "bin", *r6("density"))


def log_sum_exp(spark, d):
    return sc.log_sum_exp(v.frames(spark, d).withColumn("x", F.col("p") * 1000), "key", "x").select("key", *r6("lse"))


def nbest_rescore(spark, d):
    c = v.table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("utt"), F.col("turn").alias("rank"), F.when(F.col("turn") % 3 == 1, "").otherwise(tx.normalize(F.col("text"))).alias("hyp"), (-F.length("text") / 10.0).alias("s1"), (-(F.col("turn") % 4) * 3.0).alias("s2"))
    return sc.nbest_rescore(rows).select("utt", "rank", "hyp", F.round("score", 6).alias("score"))


def masked_accuracy(spark, d):
    f = v.frames(spark, d)
    return sc.masked_accuracy(f, F.col("p") * 8 - 4, (F.col("label") >= 2).cast("int"), F.col("seq") % 5 != 0).select(*r6("accuracy"))


# Words of one side alone equal nothing on the other, so all of a side share one character; DuckDB counts bytes, and the
# words that both sides have are fewer than the one-byte characters.
_ERRS = """err AS (SELECT *, len(list_filter(string_split(ref, ' '), lambda w: w <> '')) AS ref_words,
  list_filter(string_split(hyp, ' '), lambda w: w <> '') AS hw, list_filter(string_split(ref, ' '), lambda w: w <> '') AS rw FROM hyp_ref),
coded AS (SELECT *, list_sort(list_intersect(hw, rw)) AS u FROM err),
scored AS (SELECT *, levenshtein(array_to_string(list_transform(hw, lambda w: chr(CAST(coalesce(list_position(u, w), 0) + 2 AS INTEGER))), ''), array_to_string(list_transform(rw, lambda w: chr(CAST(coalesce(nullif(list_position(u, w), 0) + 2, 1) AS INTEGER))), '')) AS word_errors,
  levenshtein(hyp, ref) / greatest(1, length(ref)) AS cer FROM coded)"""
_SCEN = "scen AS (SELECT 'type' || label AS scenario, 'e' || (key % 3) AS engine, p FROM frames)"

QUERIES = {f.__name__: f for f in (normalize_text, char_encode, char_decode, split_sentences, length_window, char_ngrams, rtf, strip_punct, duration_filter, group_key_from_path, frame_count, hz_mel, db_convert, clip_levels, cer, wer, corpus_wer, engine_leaderboard, scenario_pivot, scenario_score, latency_summary, rolling_stage_percentile, event_counters, run_selection, best_k_runs, score_histogram, log_sum_exp, nbest_rescore, masked_accuracy)}
ORACLE_SQL = {
    "normalize_text": f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents",
    "char_encode": "SELECT doc_id, array_to_string(list_transform(list_filter(string_split(lower(text), ''), lambda c: c <> '' AND instr(' abcdefghijklmnopqrstuvwxyz', c) > 0), lambda c: CAST(instr(' abcdefghijklmnopqrstuvwxyz', c) AS VARCHAR)), ',') AS ids FROM documents",
    "char_decode": "SELECT doc_id, regexp_replace(lower(text), '[^a-z ]', '', 'g') AS text FROM documents",
    "split_sentences": """SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS sentence FROM (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents)""",
    "length_window": sql("SELECT * FROM sentence_rows", "sentence_rows"),
    "char_ngrams": sql("SELECT DISTINCT doc_id, pos, substr(' ' || norm || ' ', i, 3) AS gram FROM (SELECT *, unnest(range(1, length(norm) + 1)) AS i FROM sentence_rows)", "sentence_rows"),
    "rtf": "SELECT doc_id, round((CAST(doc_id * 1.5 AS DOUBLE) / 1000) / greatest(CAST(n_chars AS DOUBLE) / 15.0, 1e-6), 9) AS rtf FROM documents",
    "strip_punct": sql("SELECT doc_id, pos, trim(lower(sentence), ' .,!?') AS plain FROM sentence_rows", "sentence_rows"),
    "duration_filter": sql("SELECT path, round(CAST(duration AS DOUBLE), 6) AS duration FROM manifest WHERE duration BETWEEN 30 AND 200", "manifest"),
    "group_key_from_path": sql("SELECT path, speaker AS \"group\", speaker AS folder FROM manifest", "manifest"),
    "frame_count": """WITH n AS (SELECT doc_id, CAST(greatest(0, 1 + floor((floor(CAST(n_chars AS DOUBLE) / 15.0 * 16000) - 400) / 160)) AS BIGINT) AS frames FROM documents)
        SELECT doc_id, frames, CAST(greatest(0, floor((floor((frames - 1) / 2.0) - 1) / 2.0)) AS BIGINT) AS conv, CAST(floor((frames + 1) / 2.0) AS BIGINT) AS half FROM n""",
    "hz_mel": "SELECT doc_id, round(2595.0 * log10(1 + CAST(n_chars AS DOUBLE) / 700), 6) AS mel, round(CAST(n_chars AS DOUBLE), 4) AS hz FROM documents",
    "db_convert": sql("SELECT key, seq, round(20 * log10(p + 1e-12), 6) AS db, round(pow(10.0, -(p * 18) / 20), 6) AS gain FROM frames", "frames"),
    "clip_levels": sql("SELECT key, n, round(greatest(-1.0, least(1.0, x * 4)), 6) AS clipped, round(x / max(abs(x)) OVER (PARTITION BY key), 6) AS normal FROM waves", "waves"),
    "cer": sql("SELECT conv_id, turn, round(levenshtein(hyp, ref) / greatest(1, length(ref)), 6) AS cer FROM hyp_ref", "hyp_ref"),
    "wer": with_sql(_ERRS + " SELECT conv_id, turn, word_errors, round(word_errors / greatest(1, ref_words), 6) AS wer FROM scored", "hyp_ref"),
    "corpus_wer": with_sql(_ERRS + " SELECT round(sum(word_errors) / greatest(1, sum(ref_words)), 6) AS wer FROM scored", "hyp_ref"),
    "engine_leaderboard": with_sql(_ERRS + " SELECT engine, count(*) AS n, round(sum(word_errors) / greatest(1, sum(ref_words)), 6) AS wer, round(avg(cer), 6) AS cer, round(sum(length(hyp) / CAST(100 AS DOUBLE)) / sum(length(ref) / CAST(15 AS DOUBLE)), 6) AS rtf FROM scored GROUP BY engine", "hyp_ref"),
    "scenario_pivot": with_sql(_SCEN + " SELECT scenario, round(avg(p) FILTER (engine = 'e0'), 6) AS e0, round(avg(p) FILTER (engine = 'e1'), 6) AS e1, round(avg(p) FILTER (engine = 'e2'), 6) AS e2, scenario IN ('type0', 'type4') AS expect_high FROM scen GROUP BY scenario", "frames"),
    "scenario_score": with_sql(_SCEN + " SELECT engine, round(avg(CASE WHEN scenario IN ('type0', 'type4') THEN p ELSE 1 - p END), 6) AS score FROM scen GROUP BY engine", "frames"),
    "latency_summary": with_sql("""b AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, event_id DESC) AS back FROM stages),
        r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ms, ts, event_id) - 1 AS rk, count(*) OVER (PARTITION BY stage) AS n FROM b WHERE back <= 500)
        SELECT stage, count(*) AS count, round(max(ms) FILTER (rk = least(n - 1, round_even(0.5 * (n - 1), 0))), 1) AS p50, round(max(ms) FILTER (rk = least(n - 1, round_even(CAST(0.95 AS DOUBLE) * (n - 1), 0))), 1) AS p95, round(max(ms) FILTER (back = 1), 1) AS last FROM r GROUP BY stage""", "stages"),
    "rolling_stage_percentile": with_sql("""w AS (SELECT event_id, stage, list_sort(list(ms) OVER (PARTITION BY stage ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS l FROM stages)
        SELECT event_id, stage, l[CAST(round_even(CAST(0.95 AS DOUBLE) * (len(l) - 1), 0) AS BIGINT) + 1] AS pct FROM w""", "stages"),
    "event_counters": sql("SELECT type, count(*) AS n FROM session_events GROUP BY type", "session_events"),
    "run_selection": with_sql("""l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric, step) AS r, count(*) OVER (PARTITION BY run) AS n FROM runs WHERE step > 0),
        t AS (SELECT run, max(metric) FILTER (r = n // 2 + 1) AS median, max(metric) - min(metric) AS spread FROM l GROUP BY run),
        o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric, step) AS r FROM runs)
        SELECT o.run, round(o.metric, 6) AS best, o.step AS best_step, round(median, 6) AS median, round(spread, 6) AS spread, round(f.metric, 6) AS floor, greatest(0.0, coalesce(spread, 0.0)) > 0.02 AS wide FROM o LEFT JOIN t ON o.run = t.run JOIN runs f ON f.run = o.run AND f.step = 0 WHERE o.r = 1""", "runs"),
    "best_k_runs": sql("SELECT run, step, round(metric, 6) AS metric FROM runs ORDER BY runs.metric, run, step LIMIT 20", "runs"),
    "score_histogram": with_sql("""c AS (SELECT label, CAST(least(60, floor(p / (CAST(1 AS DOUBLE) / 60)) + 1) AS BIGINT) AS bin, count(*) AS n FROM frames WHERE p BETWEEN 0 AND 1 GROUP BY 1, 2)
        SELECT label, bin, round(n / (sum(n) OVER (PARTITION BY label) * (CAST(1 AS DOUBLE) / 60)), 6) AS density FROM c""", "frames"),
    "log_sum_exp": with_sql("m AS (SELECT key, max(p * 1000) AS t FROM frames GROUP BY key) SELECT key, round(t + ln(sum(exp(p * 1000 - t))), 6) AS lse FROM frames JOIN m USING (key) GROUP BY key, t", "frames"),
    "nbest_rescore": f"""WITH h AS (SELECT conv_id AS utt, turn AS rank, CASE WHEN turn % 3 = 1 THEN '' ELSE {norm_sql('text')} END AS hyp, CAST(0.3 AS DOUBLE) * (-length(text) / CAST(10 AS DOUBLE)) + CAST(0.7 AS DOUBLE) * (-(turn % 4) * CAST(3 AS DOUBLE)) AS score FROM conversations)
        SELECT utt, rank, hyp, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY hyp = '', score DESC, rank) AS r FROM h) WHERE r = 1""",
    "masked_accuracy": sql("SELECT round(avg(CASE WHEN (1 / (1 + exp(-(p * 8 - 4))) > 0.5) = (label >= 2) THEN 1.0 ELSE 0.0 END) FILTER (seq % 5 <> 0), 6) AS accuracy FROM frames", "frames"),
}
