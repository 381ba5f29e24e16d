"""Lists, splits, order and coverage of training sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import numbered
from .series import regrids
from .verify import order_key


def stable_shuffle(items: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds ``place`` from 0 in a fixed-seed order that any engine can repeat."""
    return numbered(items.withColumn("__h", order_key(seed, key)), ["__h", key], "place").drop("__h")


def item_split(items: DataFrame, key: str, seed: int = 0, most: int = 300) -> DataFrame:
    """Adds ``dev``: the first max(1, min(most, n // 10)) items in hashed order. Only the chosen keys are sorted out,
    by a top-k that Spark runs partition by partition."""
    n = max(1, min(most, items.count() // 10))
    dev = items.select(key).orderBy(order_key(seed, key), key).limit(n).withColumn("dev", F.lit(True))
    return items.join(dev, key, "left").withColumn("dev", F.coalesce("dev", F.lit(False)))


def group_split(items: DataFrame, group: str, n_held_out: int = 8, seed: int = 0) -> DataFrame:
    """Adds ``held_out``: whole groups, the first ``n_held_out`` in hashed order."""
    chosen = items.select(group).distinct().orderBy(order_key(seed, group), group).limit(n_held_out).withColumn("held_out", F.lit(True))
    return items.join(chosen, group, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def stride_sample(items: DataFrame, order: list[str], k: int) -> DataFrame:
    """Every ``k``-th row in order, from the first."""
    return numbered(items, order, "__r").where(F.col("__r") % k == 0).drop("__r")


def pool_minus_existing(pool: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of the pool whose key is not in the list; repeats stay."""
    return pool.join(existing.select(key).distinct(), key, "left_anti")


def append_list(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """idx, key: the list as it is, then the new texts after its last index in their order."""
    last = existing.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("last"))
    rows = pool_minus_existing(new, existing, key).select(key, *order)
    rows = numbered(rows, order, "__r")
    return existing.select("idx", key).unionByName(rows.crossJoin(last).select((F.col("last") + 1 + F.col("__r")).cast("long").alias("idx"), key))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def split_leakage(train: DataFrame, dev: DataFrame) -> DataFrame:
    """check, n, ok: shared paths (must be none) and shared speakers (reported)."""
    rows = [(name, overlap(train, dev, name).agg(F.count("*").alias("n"))) for name in ("path", "speaker")]
    out = [df.select(F.lit(name).alias("check"), "n", (F.col("n") == 0 if name == "path" else F.lit(True)).alias("ok")) for name, df in rows]
    return out[0].unionByName(out[1])


def ngram_frequency(sentences: DataFrame, n: int = 3) -> DataFrame:
    """gram and how many sentences hold it."""
    return sentences.select(F.explode(tx.char_ngrams(F.col("norm"), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def word_frequency(sentences: DataFrame) -> DataFrame:
    return sentences.select(F.explode(tx.words(F.col("norm"))).alias("w")).groupBy(F.concat(F.lit("▁"), "w").alias("word")).agg(F.count("*").alias("n"))


def pair_frequency(words: DataFrame) -> DataFrame:
    """left, right, n: adjacent symbols of the words (symbols array, n), weighted by the words' counts."""
    pairs = F.arrays_zip(F.slice("symbols", 1, F.size("symbols") - 1).alias("left"), F.slice("symbols", 2, F.size("symbols") - 1).alias("right"))
    return words.where(F.size("symbols") > 1).select("n", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def coverage_report(sentences: DataFrame, pool: DataFrame, n: int = 3) -> DataFrame:
    """sentences, words, minutes (at 150 words), distinct n-grams, share of the pool's n-grams, share seen five times or
    more, upper median count."""
    totals = sentences.agg(F.count("*").alias("sentences"), F.sum("n_words").alias("words"), (F.sum("n_words") / 150).alias("minutes"))
    own, all_ = ngram_frequency(sentences, n), ngram_frequency(pool, n).select("gram")
    # Counts of equal counts: their running sum finds the median among the few different ones.
    times = own.groupBy("n").agg(F.count("*").alias("__t"))
    times = times.withColumn("__upto", F.sum("__t").over(Window.orderBy("n"))).crossJoin(own.agg(F.count("*").alias("__c")))
    five = F.sum(F.when(F.col("n") >= 5, F.col("__t")).otherwise(0)) / F.sum("__t")
    stats = times.agg(F.sum("__t").alias("distinct"), five.alias("five"), F.min(F.when(F.col("__upto") > F.floor(F.col("__c") / 2), F.col("n"))).alias("median"))
    covered = all_.join(own.select("gram", F.lit(1).alias("hit")), "gram", "left").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("coverage"))
    return totals.crossJoin(stats).crossJoin(covered)


def corpus_totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("items"), F.sum("duration").alias("seconds"), (F.sum("duration") / 3600).alias("hours"))


def corpus_fingerprint(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row, fingerprint: n=<count>:<12 hex digits of sha1> over every max(1, n // 200)-th text in order of the key."""
    n = texts.count()
    picked = stride_sample(texts.select(key), [key], max(1, n // 200))  # at most 399 rows
    picked = picked.join(texts.select(key, text), key)
    joined = picked.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, text))), lambda x: x[text]), "").alias("t"))
    return joined.select(F.concat(F.lit(f"n={n}:"), F.substring(F.sha1("t"), 1, 12)).alias("fingerprint"))


def ctc_feasibility(items: DataFrame) -> DataFrame:
    """Adds need (tokens and adjacent repeats) and ok (frames at 1.1 times the speed suffice) to items of ids, frames."""
    repeats = F.size(F.filter(F.arrays_zip(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))).alias("a"), F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))
    rows = items.withColumn("need", (F.size("ids") + F.when(F.size("ids") > 1, repeats).otherwise(0)).cast("long"))
    return rows.withColumn("ok", F.floor(F.col("frames") / 1.1) >= F.col("need"))


def ctc_summary(items: DataFrame, speed: float = 1.1) -> DataFrame:
    """speed, violations, worst, median of frames over need, at ``speed`` and at the raw one, for items of ids, frames
    that need any frame."""
    rows = ctc_feasibility(items).where("need > 0")
    at = lambda s: rows.select(F.lit(s).alias("speed"), F.floor(F.col("frames") / s).alias("f"), "need")
    ratio = F.col("f") / F.col("need")
    both = at(speed).unionByName(at(1.0))
    return both.groupBy("speed").agg(F.count_if(F.col("f") < F.col("need")).alias("violations"), F.min(ratio).alias("worst"), F.percentile(ratio, F.lit(0.5)).alias("median"))


def speed_series(samples: DataFrame, items: DataFrame, speeds: tuple[float, ...] = (0.9, 1.0, 1.1)) -> DataFrame:
    """key, speed_id, class_id, n, x: the samples (key, n, x) of each item (key, speaker) resampled to each speed; every
    speed of a speaker is a class of its own."""
    classes = speed_expand(items, speeds).select("key", "speed_id", "class_id")
    moved = regrids(samples, speeds).withColumnRenamed("rate_id", "speed_id")
    return moved.join(classes, ["key", "speed_id"]).select("key", "speed_id", "class_id", "n", "x")


def valid_manifest(cached: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """The cached manifest if it has rows and all of its paths are still listed, else the listing: every path is
    looked up, not a sample."""
    gone = cached.join(listing.select(key), key, "left_anti")
    return listing if cached.isEmpty() or not gone.isEmpty() else cached


def require_valid(report: DataFrame) -> DataFrame:
    """The report, if no check has failed; else an error that names those that have."""
    bad = [f"{r['check']}: {r['detail']}" for r in report.where("not ok").collect()]  # a row a check
    if bad:
        raise ValueError("failed checks: " + "; ".join(bad))
    return report


def speed_expand(items: DataFrame, speeds: tuple[float, ...] = (0.9, 1.0, 1.1)) -> DataFrame:
    """Each item at each speed; ``class_id`` = speaker's place in order * speeds + the speed's place."""
    table = items.sparkSession.createDataFrame(list(enumerate(speeds)), "speed_id long, speed double")
    speakers = numbered(items.select("speaker").distinct(), ["speaker"], "__s")
    return items.join(speakers, "speaker").crossJoin(table).withColumn("class_id", F.col("__s") * len(speeds) + F.col("speed_id")).drop("__s")


def shifted_targets(items: DataFrame, ids: str = "ids", sos: int = 1, eos: int = 1) -> DataFrame:
    c = F.col(ids)
    return items.withColumn("y_in", F.concat(F.array(F.lit(sos).cast("long")), c)).withColumn("y_out", F.concat(c, F.array(F.lit(eos).cast("long"))))


def validation_report(*checks: DataFrame) -> DataFrame:
    """The rows (check, ok, detail) of all checks, with the number of failed ones in each row."""
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    return rows.crossJoin(rows.agg(F.count_if(~F.col("ok")).alias("failed")))


def union_lists(first: DataFrame, second: DataFrame, order: list[str]) -> DataFrame:
    """The rows of both with ``idx``, their places: the first list in ``order``, then the second; repeats stay."""
    one, two = numbered(first, order, "idx"), numbered(second, order, "idx")
    return one.unionByName(two.withColumn("idx", F.col("idx") + one.count()))


def bench_matrix(utterances: DataFrame, *dimensions: DataFrame, most: int = 10_000) -> DataFrame:
    """Every combination of an utterance with a row of each dimension. Dimensions are lists that people keep, of ``most``
    combinations at most (more is an error); they are held by all tasks, and utterances are not shuffled."""
    settings = reduce(lambda a, b: a.crossJoin(b), dimensions)
    rows = settings.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} settings")
    return utterances.crossJoin(F.broadcast(utterances.sparkSession.createDataFrame(rows, settings.schema)))
