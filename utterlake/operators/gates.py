"""Gates, segments and masks over ordered frames (key, seq), as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(key: str, seq: str):
    return Window.partitionBy(key).orderBy(seq)


def run_length(condition: Column, key: str = "key", seq: str = "seq") -> tuple[Column, Column]:
    """(row number, last row number at which the condition failed): their difference is the run up to a row."""
    w = _order(key, seq)
    rn = F.row_number().over(w)
    return rn, F.coalesce(F.max(F.when(~condition, rn)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def with_run(df: DataFrame, name: str, condition: Column, key: str = "key", seq: str = "seq") -> DataFrame:
    """``df`` with the length of the run of true conditions that ends at each row."""
    w = _order(key, seq)
    df = df.withColumn("__rn", F.row_number().over(w))
    broken = F.max(F.when(~condition, F.col("__rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, (F.col("__rn") - F.coalesce(broken, F.lit(0))).cast("long")).drop("__rn")


def hysteresis_gate(frames: DataFrame, on: float = 0.6, off: float = 0.4, min_on: int = 5, min_off: int = 8) -> DataFrame:
    """Adds ``active``: the state after each frame. It turns on at the ``min_on``-th consecutive p above ``on`` and off
    at the ``min_off``-th consecutive p below ``off``; ``off`` must not exceed ``on``."""
    if off > on:
        raise ValueError("off must not exceed on")
    rows = with_run(with_run(frames, "__up", F.col("p") > on), "__down", F.col("p") < off)
    event = F.when(F.col("__up") == min_on, True).when(F.col("__down") == min_off, False)
    state = F.last(event, ignorenulls=True).over(_order("key", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("active", F.coalesce(state, F.lit(False))).drop("__up", "__down")


def run_triggers(frames: DataFrame, start: float = 0.5, trigger_ms: float = 96, window_ms: float = 32) -> DataFrame:
    """Rows at which a run of p >= ``start`` reaches round(trigger_ms / window_ms) windows."""
    k = max(1, round(trigger_ms / window_ms))
    return with_run(frames, "run", F.col("p") >= start).where(F.col("run") == k)


def segments(frames: DataFrame, flag: str = "active", hop_s: float = 0.01) -> DataFrame:
    """key, start_s, end_s of the runs of active frames; one still open ends with the last frame."""
    w = _order("key", "seq")
    rows = frames.withColumn("__new", F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("__seg", F.sum("__new").over(w)).where(F.col(flag))
    found = rows.groupBy("key", "__seg").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    return found.select("key", (F.col("a") * hop_s).alias("start_s"), ((F.col("b") + 1) * hop_s).alias("end_s"))


def collapse_runs(frames: DataFrame, label: str = "label", blank: int = 0) -> DataFrame:
    """key and the labels in order, without repeats of the previous frame's label, then without blanks."""
    before = F.lag(label).over(_order("key", "seq"))
    rows = frames.withColumn("__before", before).where((F.col("__before").isNull() | (F.col("__before") != F.col(label))) & (F.col(label) != blank))
    kept = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", label))).alias("l"))
    kept = kept.select("key", F.transform("l", lambda x: x[label]).alias("labels"))
    return frames.select("key").distinct().join(kept, "key", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<bigint>")))


def energy_gate(frames: DataFrame, db: str = "db", below: float = 30.0) -> DataFrame:
    """Adds ``active``: the level is above the clip's largest less ``below``."""
    return frames.withColumn("active", F.col(db) > F.max(db).over(Window.partitionBy("key")) - below)


def dilate(frames: DataFrame, flag: str = "active", by: int = 1) -> DataFrame:
    """The mask widened by ``by`` frames on both sides."""
    near = F.max(F.col(flag).cast("int")).over(_order("key", "seq").rowsBetween(-by, by))
    return frames.withColumn(flag, near == 1)


def trim_to_active(segs: DataFrame, lengths: DataFrame, pad_s: float = 0.1) -> DataFrame:
    """key, start_s, end_s: from the first segment to the last, padded, within [0, length_s]; NULLs without one."""
    span = segs.groupBy("key").agg(F.min("start_s").alias("a"), F.max("end_s").alias("b"))
    return lengths.join(span, "key", "left").select("key", F.when(F.col("a").isNotNull(), F.greatest(F.lit(0.0), F.col("a") - pad_s)).alias("start_s"), F.when(F.col("b").isNotNull(), F.least(F.col("length_s"), F.col("b") + pad_s)).alias("end_s"))


def envelope_mask(samples: DataFrame, taps: int = 400, share: float = 0.02) -> DataFrame:
    """Adds ``active``: the centred mean of squares over ``taps`` samples exceeds ``share`` of the clip's largest."""
    w = Window.partitionBy("key").orderBy("n").rowsBetween(-(taps // 2), taps - taps // 2 - 1)
    rows = samples.withColumn("envelope", F.sum(F.col("x") * F.col("x")).over(w) / taps)
    return rows.withColumn("active", F.col("envelope") > share * F.max("envelope").over(Window.partitionBy("key")))


def adjacent_repeats(frames: DataFrame, label: str = "label") -> DataFrame:
    """key and how many frames repeat the label before them."""
    same = F.col(label) == F.lag(label).over(_order("key", "seq"))
    return frames.withColumn("__same", same).groupBy("key").agg(F.count_if(F.col("__same")).alias("repeats"))


def greedy_decode(scores: DataFrame) -> DataFrame:
    """key, seq, label: the best label of each frame, ties to the smaller."""
    return scores.groupBy("key", "seq").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("label"))


def topk_per_frame(scores: DataFrame, k: int) -> DataFrame:
    """The k best labels of each frame, ties to the smaller, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("key", "seq").orderBy(F.desc("score"), "label"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def blank_fraction(frames: DataFrame, label: str = "label", blank: int = 0) -> DataFrame:
    """key, share of blank frames and its verdict."""
    share = frames.groupBy("key").agg(F.avg((F.col(label) == blank).cast("double")).alias("blank"))
    return share.withColumn("verdict", F.when(F.col("blank") > 0.995, "collapsed").when(F.col("blank") < 0.99, "healthy").otherwise("borderline"))
