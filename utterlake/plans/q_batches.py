"""Queries of the tokenizer, batches, crops, masks and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import batching as ba
from ..operators import coverage as co
from ..operators import prep as pr
from ..operators import tokenizer as to
from . import views as v
from .q_prep import chosen, encoded, man, sents
from .views import sql, with_sql


def turn_texts(spark, d):
    c = v.table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.normalize(F.col("text")).alias("norm"))


def bpe_train(spark, d):
    merges = to.bpe_train(turn_texts(spark, d), 12)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank long, left string, right string")


def _encoded(spark, d):
    texts = turn_texts(spark, d)
    merges = to.bpe_train(texts, 12)
    vocab = to.vocabulary(texts, merges)
    return to.bpe_encode(texts, ["conv_id", "turn"], merges, vocab), vocab


def bpe_encode(spark, d):
    """Encoded and decoded again: the words of the normalised text."""
    ids, vocab = _encoded(spark, d)
    return ids.select("conv_id", "turn", to.bpe_decode(F.col("ids"), vocab).alias("text"))


def unk_rate(spark, d):
    """Words outside the 200 most frequent of the even conversations are unknown."""
    texts = turn_texts(spark, d)
    table = to.first_ids(to.word_symbols(texts.where("conv_id % 2 = 0")), 200)
    placed = texts.select("conv_id", "turn", F.explode_outer(tx.words(F.col("norm"))).alias("w")).select("conv_id", "turn", F.concat(F.lit(to.MARK), "w").alias("word"))
    looked = to.token_lookup(placed.where("word is not null"), table).groupBy("conv_id", "turn").agg(F.collect_list("id").alias("ids"))
    every = texts.select("conv_id", "turn").join(looked, ["conv_id", "turn"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return to.token_rates(every).select("tokens", "unknown", F.round("unk_rate", 6).alias("unk_rate"), "empty_targets")


def token_lookup(spark, d):
    texts = turn_texts(spark, d)
    table = to.first_ids(to.word_symbols(texts.where("conv_id % 2 = 0")), 200)
    return to.token_lookup(to.word_symbols(texts).select("word"), table).select("word", F.col("id").cast("long").alias("id"))


def length_batches(spark, d):
    return ba.length_batches(man(spark, d), "doc_id").select("doc_id", "frames", "batch")


def epoch_order(spark, d):
    batches = ba.length_batches(man(spark, d), "doc_id")
    return ba.epoch_order(batches, 3, 2).select("part", "batch", "order")


def ragged_pad(spark, d):
    items = encoded(spark, d).select("doc_id", "pos", "ids", (F.col("doc_id") % 50).alias("batch"))
    found = ba.ragged_pad(items, "batch")
    return found.select("doc_id", "pos", F.size("ids").cast("long").alias("padded"), F.col("length").cast("long").alias("length"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("real"))


def random_crop(spark, d):
    return ba.random_crop(v.waves(spark, d), 20, 5).select("key", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def span_mask(spark, d):
    """Vectors as series of eight frames of eight bands."""
    feats = v.waves(spark, d).select("key", F.floor(F.col("n") / 8).alias("frame"), (F.col("n") % 8).alias("band"), F.col("x").alias("v"))
    keys = feats.groupBy("key").agg((F.max("frame") + 1).alias("frames"))
    spans = ba.mask_spans(keys, 8, 1, freq_width=3, n_time=2, time_share=0.5, time_width=4)
    return ba.span_mask(feats, spans).select("key", "frame", "band", F.round("v", 6).alias("v"))


def minute_budget(spark, d):
    found = co.minute_budget(sents(spark, d), chosen(spark, d), 2_000.0)
    return found.select("have_words", F.round("mean_words", 6).alias("mean_words"), "n")


def greedy_coverage(spark, d):
    """Fifty sentences beside what the chosen ones cover."""
    pool = sents(spark, d).where("doc_id % 3 <> 0").select((F.col("doc_id") * 100_000 + F.col("pos")).alias("idx"), "norm")
    picked = co.greedy_coverage(pool, 50, seen=pr.ngram_frequency(chosen(spark, d)))
    return spark.createDataFrame(list(enumerate(picked)), "place long, idx long")


_TEXT = f"texts AS (SELECT conv_id, turn, {v.norm_sql('text')} AS norm FROM conversations)"
_WORDS = _TEXT + """, placed AS (SELECT conv_id, turn, '▁' || w AS word FROM (SELECT conv_id, turn, unnest(string_split(norm, ' ')) AS w FROM texts) WHERE w <> ''),
top AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS r FROM placed WHERE conv_id % 2 = 0 GROUP BY word), known AS (SELECT word, r + 2 AS id FROM top WHERE r <= 200)"""
_HASH = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"
_BATCHES = """RECURSIVE items AS (SELECT doc_id, CAST(floor(duration * 100) AS BIGINT) AS frames, row_number() OVER (ORDER BY floor(duration * 100), doc_id) AS k FROM manifest),
b AS (SELECT k, doc_id, frames, CAST(0 AS BIGINT) AS batch, 1 AS n FROM items WHERE k = 1
  UNION ALL SELECT i.k, i.doc_id, i.frames, CASE WHEN shut THEN batch + 1 ELSE batch END, CASE WHEN shut THEN 1 ELSE n + 1 END FROM (
    SELECT b.*, (i.frames * (b.n + 1) > 12000 OR b.n >= 32) AS shut, i.k AS ik FROM b JOIN items i ON i.k = b.k + 1) x JOIN items i ON i.k = x.ik)"""
_DRAWN = """keys AS (SELECT key, 8 AS frames FROM waves GROUP BY key),
drawn AS (SELECT key, 'band' AS axis, 8 AS size, 3 AS most, unnest(range(2)) AS k FROM keys UNION ALL SELECT key, 'time', 8, 4, unnest(range(2)) FROM keys),
wide AS (SELECT *, """ + _HASH.format("'1:' || key || ':' || axis || ':' || k || ':w'") + """ % (most + 1) AS width FROM drawn),
spans AS (SELECT key, axis, low, low + width AS high FROM (SELECT *, """ + _HASH.format("'1:' || key || ':' || axis || ':' || k || ':at'") + """ % (size - width + 1) AS low FROM wide WHERE width > 0 AND size > width))"""

QUERIES = {f.__name__: f for f in (bpe_train, bpe_encode, unk_rate, token_lookup, length_batches, epoch_order, ragged_pad, random_crop, span_mask, minute_budget, greedy_coverage)}
ORACLE_SQL = {
    "bpe_encode": f"WITH {_TEXT} SELECT conv_id, turn, norm AS text FROM texts",
    "unk_rate": f"WITH {_WORDS} SELECT count(*) AS tokens, count(*) FILTER (id IS NULL) AS unknown, round(count(*) FILTER (id IS NULL) / greatest(1, count(*)), 6) AS unk_rate, (SELECT count(*) FROM texts WHERE norm = '') AS empty_targets FROM placed LEFT JOIN known USING (word)",
    "token_lookup": f"WITH {_WORDS} SELECT word, coalesce(id, 2) AS id FROM (SELECT DISTINCT word FROM placed) LEFT JOIN known USING (word)",
    "length_batches": f"WITH {_BATCHES.replace('RECURSIVE items', 'RECURSIVE manifest AS (' + v.SQL['manifest'] + '), items')} SELECT doc_id, frames, batch FROM b",
    "epoch_order": f"WITH {_BATCHES.replace('RECURSIVE items', 'RECURSIVE manifest AS (' + v.SQL['manifest'] + '), items')} SELECT DISTINCT CAST(0 AS INTEGER) AS part, batch, sha256('5:0:' || batch) AS \"order\" FROM b",
    "ragged_pad": with_sql("""e AS (SELECT doc_id, pos, doc_id % 50 AS batch, CAST(len(list_filter(string_split(norm, ''), lambda c: c <> '' AND instr(' abcdefghijklmnopqrstuvwxyz', c) > 0)) AS BIGINT) AS length FROM sentence_rows)
        SELECT doc_id, pos, max(length) OVER (PARTITION BY batch) AS padded, length, length AS real FROM e""", "sentence_rows"),
    "random_crop": with_sql("s AS (SELECT key, count(*) AS size FROM waves GROUP BY key), c AS (SELECT key, size, " + _HASH.format("'5:' || key") + " % (size - 20 + 1) AS start FROM s), w AS (SELECT key, (start + i) % size AS n, i FROM (SELECT *, unnest(range(20)) AS i FROM c)) SELECT key, i, round(x, 6) AS x FROM w JOIN waves USING (key, n)", "waves"),
    "span_mask": with_sql(_DRAWN + """, f AS (SELECT key, n // 8 AS frame, n % 8 AS band, x FROM waves)
        SELECT f.key, frame, band, round(CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.key = f.key AND CASE WHEN axis = 'band' THEN band ELSE frame END >= low AND CASE WHEN axis = 'band' THEN band ELSE frame END < high) THEN 0.0 ELSE x END, 6) AS v FROM f""", "waves"),
    "minute_budget": sql("SELECT h AS have_words, round(m, 6) AS mean_words, CAST(CASE WHEN 2000 > h / 150 * 1.05 THEN greatest(0, round_even((2000 * 150 - h) / m, 0)) ELSE 0 END AS BIGINT) AS n FROM (SELECT CAST(sum(n_words) FILTER (doc_id % 3 = 0) AS BIGINT) AS h, avg(n_words) AS m FROM sentence_rows)", "sentence_rows"),
}
