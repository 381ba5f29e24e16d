"""Queries of training-set preparation, lists and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio as au
from ..functions import text as tx
from ..operators import prep as pr
from . import views as v
from .q_scoring import r6
from .views import sql, with_sql


def man(spark, d):
    return v.manifest(spark, d).select("path", "speaker", "duration", "doc_id")


def sents(spark, d):
    return v.sentence_rows(spark, d)


def chosen(spark, d):
    return sents(spark, d).where("doc_id % 3 = 0")


def stable_shuffle(spark, d):
    return pr.stable_shuffle(man(spark, d), "path", 7).select("path", "place")


def item_split(spark, d):
    return pr.item_split(man(spark, d), "path", 1).select("path", "dev")


def group_split(spark, d):
    return pr.group_split(man(spark, d), "speaker", 8, 1).select("path", "held_out")


def stride_sample(spark, d):
    return pr.stride_sample(man(spark, d), ["path"], 7).select("path")


def pool_minus_existing(spark, d):
    return pr.pool_minus_existing(sents(spark, d), chosen(spark, d), "norm").select("norm")


def todo_anti(spark, d):
    return pr.pool_minus_existing(sents(spark, d).select("doc_id", "pos", "norm"), chosen(spark, d), "norm")


def frozen_list(spark, d):
    first = pr.stable_shuffle(chosen(spark, d), "norm", 3).select(F.col("place").alias("idx"), "norm")
    return pr.append_list(first, sents(spark, d), "norm", ["doc_id", "pos"])


def union_lists(spark, d):
    """Both lists with their places, the second after the first, repeats and all."""
    return pr.union_lists(chosen(spark, d), sents(spark, d), ["doc_id", "pos"]).select("idx", "norm")


def overlap(spark, d):
    return pr.overlap(man(spark, d).where("doc_id % 2 = 0"), man(spark, d).where("doc_id % 3 = 0"), "path")


def pool_union_distinct(spark, d):
    a, b = (pr.ngram_frequency(x).select("gram") for x in (chosen(spark, d), sents(spark, d).where("doc_id % 5 = 0")))
    return a.union(b).distinct()


def split_leakage(spark, d):
    return pr.split_leakage(man(spark, d).where("doc_id % 2 = 0"), man(spark, d).where("doc_id % 2 = 1"))


def manifest_join(spark, d):
    labels = v.table(spark, d, "labels")
    return man(spark, d).join(labels, "doc_id").select("path", F.round("duration", 6).alias("duration"), F.col("quality").cast("long").alias("quality"))


def manifest_cache_check(spark, d):
    """Cached paths that are gone from the listing."""
    return man(spark, d).join(man(spark, d).where("doc_id % 10 <> 3").select("path"), "path", "left_anti").select("path")


def bench_matrix(spark, d):
    """Every engine and noise for every utterance: the two small dimensions go to all tasks."""
    turns = v.table(spark, d, "conversations")
    engines, kinds = turns.select(F.col("role").alias("engine")).distinct(), v.table(spark, d, "events").select(F.col("event_type").alias("noise")).distinct()
    return pr.bench_matrix(turns.select("conv_id", "turn"), engines, kinds)


def ngram_frequency(spark, d):
    return pr.ngram_frequency(sents(spark, d))


def word_frequency(spark, d):
    return pr.word_frequency(sents(spark, d))


def pair_frequency(spark, d):
    words = pr.word_frequency(sents(spark, d)).select(F.filter(F.split("word", ""), lambda c: c != "").alias("symbols"), "n")
    return pr.pair_frequency(words)


def coverage_report(spark, d):
    return pr.coverage_report(chosen(spark, d), sents(spark, d)).select("sentences", "words", *r6("minutes"), "distinct", *r6("five", "coverage"), "median")


def corpus_totals(spark, d):
    return pr.corpus_totals(man(spark, d)).select("items", F.round("seconds", 4).alias("seconds"), F.round("hours", 6).alias("hours"))


def corpus_fingerprint(spark, d):
    return pr.corpus_fingerprint(v.table(spark, d, "conversations").withColumn("k", F.col("conv_id") * 100 + F.col("turn")), "k", "text")


def encoded(spark, d):
    return sents(spark, d).select("doc_id", "pos", tx.char_encode(F.col("norm")).alias("ids"), au.frame_count(F.length("norm") / 60.0).alias("frames"))


def ctc_feasibility(spark, d):
    return pr.ctc_feasibility(encoded(spark, d)).select("doc_id", "pos", "need", "ok")


def speed_expand(spark, d):
    return pr.speed_expand(man(spark, d)).select("path", F.col("speed_id"), "class_id", F.round(F.col("duration") / F.col("speed"), 6).alias("seconds"))


def ctc_summary(spark, d):
    return pr.ctc_summary(encoded(spark, d)).select("speed", "violations", *r6("worst", "median"))


def speed_series(spark, d):
    e = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("speaker"))
    return pr.speed_series(v.waves(spark, d), e).groupBy("key", "speed_id", "class_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total"))


def manifest_cache(spark, d):
    """A cache that lacks nothing is kept; one with a path that is gone gives way to the listing."""
    listing = man(spark, d).select("path")
    kept = pr.valid_manifest(listing.where("path like '%3'"), listing).withColumn("from_cache", F.lit(True))
    gone = listing.select(F.concat("path", F.lit("-gone")).alias("path"))
    return kept.unionByName(pr.valid_manifest(gone, listing).withColumn("from_cache", F.lit(False)))


def pool_intersection(spark, d):
    """How many n-grams both pools have."""
    a, b = (pr.ngram_frequency(x).select("gram") for x in (chosen(spark, d), sents(spark, d).where("doc_id % 5 = 0")))
    return a.intersect(b).agg(F.count("*").alias("shared"))


def shifted_padded(spark, d):
    """Targets padded with 0 to the longest of their batch."""
    from ..operators.batching import ragged_pad

    rows = pr.shifted_targets(encoded(spark, d)).select("doc_id", "pos", "y_in", (F.col("doc_id") % 50).alias("batch"))
    found = ragged_pad(rows, "batch", "y_in")
    return found.select("doc_id", "pos", F.size("y_in").cast("long").alias("padded"), F.array_join(F.slice("y_in", F.col("length"), 2), ",").alias("edge"))


def shifted_targets(spark, d):
    out = pr.shifted_targets(encoded(spark, d))
    return out.select("doc_id", "pos", F.array_join("y_in", ",").alias("y_in"), F.array_join("y_out", ",").alias("y_out"))


def validation_report(spark, d):
    m, f = man(spark, d), pr.ctc_feasibility(encoded(spark, d))
    row = lambda name, df, bad: df.agg(F.count_if(bad).alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").cast("string").alias("detail"))
    return pr.validation_report(row("durations", m, F.col("duration") <= 0), row("feasible", f, ~F.col("ok")), row("short", m, F.col("duration") < 1))


_KEY = "sha256('{seed}:' || {c})"
_GRAMS = "grams AS (SELECT DISTINCT doc_id, pos, substr(' ' || norm || ' ', i, 3) AS gram FROM (SELECT *, unnest(range(1, length(norm) + 1)) AS i FROM sentence_rows))"
_ENC = """enc AS (SELECT doc_id, pos, norm, list_transform(list_filter(string_split(norm, ''), lambda c: c <> '' AND instr(' abcdefghijklmnopqrstuvwxyz', c) > 0), lambda c: instr(' abcdefghijklmnopqrstuvwxyz', c)) AS ids FROM sentence_rows),
fit AS (SELECT doc_id, pos, len(ids) + CASE WHEN len(ids) > 1 THEN len(list_filter(range(2, len(ids) + 1), lambda i: ids[i] = ids[i - 1])) ELSE 0 END AS need, greatest(0, 1 + floor((floor(length(norm) / CAST(60 AS DOUBLE) * 16000) - 400) / 160)) AS frames FROM enc)"""

QUERIES = {f.__name__: f for f in (stable_shuffle, item_split, group_split, stride_sample, pool_minus_existing, todo_anti, frozen_list, union_lists, overlap, pool_union_distinct, split_leakage, manifest_join, manifest_cache_check, bench_matrix, ngram_frequency, word_frequency, pair_frequency, coverage_report, corpus_totals, corpus_fingerprint, ctc_feasibility, speed_expand, ctc_summary, speed_series, manifest_cache, pool_intersection, shifted_padded, shifted_targets, validation_report)}
ORACLE_SQL = {
    "stable_shuffle": sql(f"SELECT path, row_number() OVER (ORDER BY {_KEY.format(seed=7, c='path')}, path) - 1 AS place FROM manifest", "manifest"),
    "item_split": sql(f"SELECT path, row_number() OVER (ORDER BY {_KEY.format(seed=1, c='path')}, path) <= greatest(1, least(300, (SELECT count(*) FROM manifest) // 10)) AS dev FROM manifest", "manifest"),
    "group_split": with_sql(f"g AS (SELECT speaker, row_number() OVER (ORDER BY {_KEY.format(seed=1, c='speaker')}, speaker) <= 8 AS held_out FROM (SELECT DISTINCT speaker FROM manifest)) SELECT path, held_out FROM manifest JOIN g USING (speaker)", "manifest"),
    "stride_sample": sql("SELECT path FROM (SELECT path, row_number() OVER (ORDER BY path) - 1 AS r FROM manifest) WHERE r % 7 = 0", "manifest"),
    "pool_minus_existing": sql("SELECT norm FROM sentence_rows WHERE doc_id % 3 <> 0", "sentence_rows"),
    "todo_anti": sql("SELECT norm, doc_id, pos FROM sentence_rows WHERE doc_id % 3 <> 0", "sentence_rows"),
    "frozen_list": with_sql(f"""a AS (SELECT row_number() OVER (ORDER BY {_KEY.format(seed=3, c='norm')}, norm) - 1 AS idx, norm FROM sentence_rows WHERE doc_id % 3 = 0)
        SELECT idx, norm FROM a UNION ALL SELECT (SELECT max(idx) FROM a) + row_number() OVER (ORDER BY doc_id, pos), norm FROM sentence_rows WHERE doc_id % 3 <> 0""", "sentence_rows"),
    "union_lists": sql("SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS idx, norm FROM sentence_rows WHERE doc_id % 3 = 0 UNION ALL SELECT (SELECT count(*) FROM sentence_rows WHERE doc_id % 3 = 0) + row_number() OVER (ORDER BY doc_id, pos) - 1, norm FROM sentence_rows", "sentence_rows"),
    "overlap": sql("SELECT path FROM manifest WHERE doc_id % 6 = 0", "manifest"),
    "pool_union_distinct": with_sql(_GRAMS + " SELECT DISTINCT gram FROM grams WHERE doc_id % 3 = 0 OR doc_id % 5 = 0", "sentence_rows"),
    "split_leakage": with_sql("""p AS (SELECT path FROM manifest WHERE doc_id % 2 = 0 INTERSECT SELECT path FROM manifest WHERE doc_id % 2 = 1), s AS (SELECT speaker FROM manifest WHERE doc_id % 2 = 0 INTERSECT SELECT speaker FROM manifest WHERE doc_id % 2 = 1)
        SELECT 'path' AS "check", count(*) AS n, count(*) = 0 AS ok FROM p UNION ALL SELECT 'speaker', count(*), true FROM s""", "manifest"),
    "manifest_join": sql("SELECT path, round(CAST(duration AS DOUBLE), 6) AS duration, CAST(quality AS BIGINT) AS quality FROM manifest JOIN labels USING (doc_id)", "manifest"),
    "manifest_cache_check": sql("SELECT path FROM manifest WHERE doc_id % 10 = 3", "manifest"),
    "bench_matrix": "SELECT conv_id, turn, engine, noise FROM conversations, (SELECT DISTINCT role AS engine FROM conversations), (SELECT DISTINCT event_type AS noise FROM events)",
    "ngram_frequency": with_sql(_GRAMS + " SELECT gram, count(*) AS n FROM grams GROUP BY gram", "sentence_rows"),
    "word_frequency": sql("SELECT '▁' || w AS word, count(*) AS n FROM (SELECT unnest(string_split(norm, ' ')) AS w FROM sentence_rows) WHERE w <> '' GROUP BY w", "sentence_rows"),
    "pair_frequency": with_sql("""f AS (SELECT '▁' || w AS word, count(*) AS n FROM (SELECT unnest(string_split(norm, ' ')) AS w FROM sentence_rows) WHERE w <> '' GROUP BY w)
        SELECT substr(word, i, 1) AS "left", substr(word, i + 1, 1) AS "right", CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, unnest(range(1, length(word))) AS i FROM f) GROUP BY 1, 2""", "sentence_rows"),
    "coverage_report": with_sql(_GRAMS + """, o AS (SELECT gram, count(*) AS n FROM grams WHERE doc_id % 3 = 0 GROUP BY gram), r AS (SELECT *, row_number() OVER (ORDER BY n, gram) AS k, count(*) OVER () AS c FROM o), a AS (SELECT DISTINCT gram FROM grams)
        SELECT t.*, s.*, c.* FROM (SELECT count(*) AS sentences, CAST(sum(n_words) AS BIGINT) AS words, round(sum(n_words) / 150, 6) AS minutes FROM sentence_rows WHERE doc_id % 3 = 0) t,
        (SELECT count(*) AS "distinct", round(avg(CASE WHEN n >= 5 THEN 1.0 ELSE 0.0 END), 6) AS five, max(n) FILTER (k = c // 2 + 1) AS median FROM r) s, (SELECT round(avg(CASE WHEN o.gram IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM a LEFT JOIN o USING (gram)) c""", "sentence_rows"),
    "corpus_totals": sql("SELECT count(*) AS items, round(sum(CAST(duration AS DOUBLE)), 4) AS seconds, round(sum(CAST(duration AS DOUBLE)) / 3600, 6) AS hours FROM manifest", "manifest"),
    "corpus_fingerprint": """WITH t AS (SELECT text, row_number() OVER (ORDER BY conv_id * 100 + turn) - 1 AS r, count(*) OVER () AS n FROM conversations)
        SELECT 'n=' || max(n) || ':' || substr(sha1(string_agg(text, '' ORDER BY r) FILTER (r % greatest(1, n // 200) = 0)), 1, 12) AS fingerprint FROM t""",
    "ctc_feasibility": with_sql(_ENC + " SELECT doc_id, pos, need, floor(frames / CAST(1.1 AS DOUBLE)) >= need AS ok FROM fit", "sentence_rows"),
    "speed_expand": with_sql("s AS (SELECT speaker, row_number() OVER (ORDER BY speaker) - 1 AS s FROM (SELECT DISTINCT speaker FROM manifest)), k AS (SELECT unnest([0, 1, 2]) AS speed_id, unnest([0.9, 1.0, 1.1]) AS sp) SELECT path, CAST(speed_id AS BIGINT) AS speed_id, s * 3 + speed_id AS class_id, round(CAST(duration AS DOUBLE) / CAST(sp AS DOUBLE), 6) AS seconds FROM manifest JOIN s USING (speaker), k", "manifest"),
    "ctc_summary": with_sql(_ENC + """, s AS (SELECT sp AS speed, floor(frames / sp) AS f, need FROM fit, (SELECT unnest([CAST(1.1 AS DOUBLE), CAST(1 AS DOUBLE)]) AS sp) WHERE need > 0)
        SELECT speed, count(*) FILTER (f < need) AS violations, round(min(f / need), 6) AS worst, round(quantile_cont(f / need, 0.5), 6) AS median FROM s GROUP BY speed""", "sentence_rows"),
    "speed_series": with_sql("""k AS (SELECT unnest([0, 1, 2]) AS speed_id, unnest([CAST(0.9 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1.1 AS DOUBLE)]) AS sp), o AS (SELECT speed_id, CAST(round_even(64 / sp, 0) AS BIGINT) AS size FROM k),
        g AS (SELECT speed_id, i, i * (63 / CAST(size - 1 AS DOUBLE)) AS pos FROM (SELECT speed_id, size, unnest(range(size)) AS i FROM o)),
        r AS (SELECT a.key, speed_id, i, a.x + (coalesce(b.x, a.x) - a.x) * (pos - floor(pos)) AS x FROM g JOIN waves a ON a.n = CAST(least(floor(pos), 63) AS BIGINT) LEFT JOIN waves b ON b.key = a.key AND b.n = a.n + 1),
        c AS (SELECT vec_id AS key, (dense_rank() OVER (ORDER BY label) - 1) * 3 AS c FROM embeddings)
        SELECT key, CAST(speed_id AS BIGINT) AS speed_id, c + speed_id AS class_id, count(*) AS n, round(sum(x), 6) AS total FROM r JOIN c USING (key) GROUP BY key, speed_id, c""", "waves"),
    "manifest_cache": sql("SELECT path, true AS from_cache FROM manifest WHERE path LIKE '%3' UNION ALL SELECT path, false FROM manifest", "manifest"),
    "pool_intersection": with_sql(_GRAMS + " SELECT count(*) AS shared FROM (SELECT gram FROM grams WHERE doc_id % 3 = 0 INTERSECT SELECT gram FROM grams WHERE doc_id % 5 = 0)", "sentence_rows"),
    "shifted_padded": with_sql(_ENC + """, y AS (SELECT doc_id, pos, doc_id % 50 AS batch, list_prepend(1, ids) AS y FROM enc)
        SELECT doc_id, pos, max(len(y)) OVER (PARTITION BY batch) AS padded, CASE WHEN len(y) = max(len(y)) OVER (PARTITION BY batch) THEN CAST(y[-1] AS VARCHAR) ELSE y[-1] || ',0' END AS edge FROM y""", "sentence_rows"),
    "shifted_targets": with_sql(_ENC + " SELECT doc_id, pos, concat_ws(',', '1', CASE WHEN len(ids) > 0 THEN array_to_string(ids, ',') END) AS y_in, concat_ws(',', CASE WHEN len(ids) > 0 THEN array_to_string(ids, ',') END, '1') AS y_out FROM enc", "sentence_rows"),
    "validation_report": with_sql(_ENC + """, c AS (SELECT 'durations' AS "check", count(*) FILTER (duration <= 0) AS n FROM manifest UNION ALL SELECT 'feasible', count(*) FILTER (NOT floor(frames / CAST(1.1 AS DOUBLE)) >= need) FROM fit UNION ALL SELECT 'short', count(*) FILTER (duration < 1) FROM manifest)
        SELECT "check", n = 0 AS ok, CAST(n AS VARCHAR) AS detail, (SELECT count(*) FILTER (n > 0) FROM c) AS failed FROM c""", "sentence_rows", "manifest"),
}
