"""Recognition scoring, leaderboards and grouped ratios."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..tables import numbered


def with_errors(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Adds word_errors, ref_words, wer and cer of each pair."""
    h, r = F.col(hyp), F.col(ref)
    rows = pairs.withColumn("word_errors", tx.word_errors(h, r).cast("long")).withColumn("ref_words", F.size(tx.words(r)).cast("long"))
    return rows.withColumn("wer", F.col("word_errors") / F.greatest(F.lit(1), "ref_words")).withColumn("cer", tx.cer(h, r))


def corpus_wer(pairs: DataFrame, *by: str) -> DataFrame:
    """Errors over reference words of each group, not the mean of ratios."""
    return with_errors(pairs).groupBy(*by).agg((F.sum("word_errors") / F.greatest(F.lit(1), F.sum("ref_words"))).alias("wer"))


def engine_leaderboard(pairs: DataFrame) -> DataFrame:
    """engine, n, corpus WER, mean CER, real-time factor; needs seconds and audio_s."""
    return (
        with_errors(pairs)
        .groupBy("engine")
        .agg(
            F.count("*").alias("n"),
            (F.sum("word_errors") / F.greatest(F.lit(1), F.sum("ref_words"))).alias("wer"),
            F.avg("cer").alias("cer"),
            (F.sum("seconds") / F.sum("audio_s")).alias("rtf"),
        )
    )


def scenario_pivot(scores: DataFrame, engines: list[str], speech: list[str]) -> DataFrame:
    """Mean p of each scenario by engine, and whether the scenario should be high."""
    wide = scores.groupBy("scenario").pivot("engine", engines).agg(F.avg("p"))
    return wide.withColumn("expect_high", F.col("scenario").isin(speech))


def single_score(scores: DataFrame, speech: list[str]) -> DataFrame:
    """engine and the mean of p where speech is expected, of 1 - p elsewhere."""
    return scores.groupBy("engine").agg(F.avg(F.when(F.col("scenario").isin(speech), F.col("p")).otherwise(1 - F.col("p"))).alias("score"))


def latency_summary(samples: DataFrame, window: int = 500) -> DataFrame:
    """stage, count, p50, p95, last of the last ``window`` samples of each stage by (ts, event_id); percentiles by
    nearest rank with half-even rounding, all to one decimal."""
    newest = F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = samples.withColumn("__back", newest).where(F.col("__back") <= window)
    rank = F.row_number().over(Window.partitionBy("stage").orderBy("ms", "ts", "event_id")) - 1
    n = F.count("*").over(Window.partitionBy("stage"))
    ranked = recent.withColumn("__rank", rank).withColumn("__n", n)
    at = lambda q: F.max(F.when(F.col("__rank") == F.least(F.col("__n") - 1, F.rint(q * (F.col("__n") - 1))), F.col("ms")))
    return ranked.groupBy("stage").agg(
        F.count("*").alias("count"), F.round(at(F.lit(0.5)), 1).alias("p50"), F.round(at(F.lit(0.95)), 1).alias("p95"), F.round(F.max(F.when(F.col("__back") == 1, F.col("ms"))), 1).alias("last")
    )


def rolling_percentile(samples: DataFrame, q: float = 0.95, window: int = 500, chunk: int = 20_000) -> DataFrame:
    """Adds ``pct``: the nearest-rank percentile of the last ``window`` samples of the stage, as of each sample.

    Samples in order of stage and time are numbered and cut into chunks of ``chunk``, each with the ``window`` - 1 samples
    before it, so that a hot stage is many tasks; a task keeps the last samples in order and moves one in and one out."""
    chunk, names = max(chunk, window), [*samples.columns, "pct"]
    rows = numbered(samples, ["stage", "ts", "event_id"], "__k")
    own, late = F.floor(F.col("__k") / chunk), F.col("__k") % chunk > chunk - window
    rows = rows.withColumn("__own", own).withColumn("__chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))

    def find(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__k")
        found, recent, ranked, now = [], deque(), [], None
        for stage, ms in zip(part["stage"].tolist(), part["ms"].tolist(), strict=True):
            if stage != now:
                now, recent, ranked = stage, deque(), []
            if len(recent) == window:
                del ranked[bisect_left(ranked, recent.popleft())]
            recent.append(ms)
            insort(ranked, ms)
            found.append(ranked[round(q * (len(ranked) - 1))])
        part = part.assign(pct=found)
        return part[part["__own"] == key[0]][names]

    schema = T.StructType([*samples.schema.fields, T.StructField("pct", T.DoubleType())])
    return rows.groupBy("__chunk").applyInPandas(find, schema)


def event_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))


def run_selection(runs: DataFrame, ci: float = 0.0, wide: float = 0.02) -> DataFrame:
    """run, best, best_step, upper median of the evaluations after the first, their spread, the floor (the first), and
    whether the result is ``wide``: the spread or the confidence interval ``ci`` exceeds that bound."""
    order = Window.partitionBy("run").orderBy("metric", "step")
    later = runs.where("step > 0").withColumn("__r", F.row_number().over(order)).withColumn("__n", F.count("*").over(Window.partitionBy("run")))
    tail = later.groupBy("run").agg(
        F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2) + 1, F.col("metric"))).alias("median"), (F.max("metric") - F.min("metric")).alias("spread")
    )
    head = runs.groupBy("run").agg(F.min("metric").alias("best"), F.min_by("step", F.struct("metric", "step")).alias("best_step"), F.min_by("metric", "step").alias("floor"))
    return head.join(tail, "run", "left").withColumn("wide", F.greatest(F.lit(ci), F.coalesce("spread", F.lit(0.0))) > wide)


def best_k_runs(runs: DataFrame, k: int) -> DataFrame:
    """The k best evaluations: smallest metric, then run and step."""
    return runs.orderBy("metric", "run", "step").limit(k)


def score_histogram(scores: DataFrame, low: float, high: float, bins: int = 60) -> DataFrame:
    """label, bin (from 1), density of each class over equal bins of [low, high]; the top edge is in the last bin."""
    place = F.least(F.lit(bins), F.floor((F.col("score") - low) / ((high - low) / bins)) + 1).cast("long")
    n = F.sum("n").over(Window.partitionBy("label"))
    counted = scores.where(F.col("score").between(low, high)).groupBy("label", place.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("label", "bin", (F.col("n") / (n * ((high - low) / bins))).alias("density"))


def log_sum_exp(rows: DataFrame, by: str, x: str) -> DataFrame:
    """by, lse: ln of the sum of exponentials without overflow; minus infinity if all are."""
    top = rows.groupBy(by).agg(F.max(x).alias("__top"))
    joined = rows.join(top, by).groupBy(by, "__top").agg(F.sum(F.exp(F.when(F.col(x) == F.col("__top"), 0.0).otherwise(F.col(x) - F.col("__top")))).alias("s"))
    return joined.select(by, F.when(F.col("__top") == float("-inf"), F.lit(float("-inf"))).otherwise(F.col("__top") + F.log("s")).alias("lse"))


def nbest_rescore(rows: DataFrame, weight: float = 0.3) -> DataFrame:
    """The best hypothesis of each utt by weight * s1 + (1 - weight) * s2; the earlier wins ties; empty ones only count
    if all are empty."""
    combined = rows.withColumn("score", weight * F.col("s1") + (1 - weight) * F.col("s2"))
    order = Window.partitionBy("utt").orderBy((F.col("hyp") == "").cast("int"), F.desc("score"), "rank")
    return combined.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def masked_accuracy(rows: DataFrame, score: Column, label: Column, valid: Column) -> DataFrame:
    """Share of valid rows whose score, after the logistic, is on the label's side of one half."""
    return rows.agg(F.avg(F.when(valid, ((1 / (1 + F.exp(-score)) > 0.5) == (label == 1)).cast("double"))).alias("accuracy"))
