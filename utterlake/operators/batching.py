"""Length batches, epoch order, padding, crops and masks of training items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import numbered
from .verify import order_key


def _next_starts(frames: np.ndarray, max_frames: int, max_batch: int) -> np.ndarray:
    """Where the next batch begins if one begins at each item; items are in order of length, so a batch's longest is its
    last one so far."""
    n, at = len(frames), np.arange(len(frames))
    found = np.minimum(at + max_batch, n)
    for size in range(min(max_batch, n) - 1, 0, -1):  # the batch is full at this size if the item after it is too long for it
        after = at[: n - size] + size
        found[: n - size] = np.where(frames[after] * (size + 1) > max_frames, after, found[: n - size])
    return found


def length_batches(items: DataFrame, key: str, max_frames: int = 12_000, max_batch: int = 32, chunk: int = 8192) -> DataFrame:
    """key, frames, part (0), batch: items in order of duration, a batch closed before the item that would make it longer
    than ``max_frames`` when padded, or at ``max_batch`` items; the batches of one pass over all items.

    The items are cut into chunks of ``chunk``. Where a batch ends depends on where it begins and on the next ``max_batch``
    items alone, so a chunk tells for each place at which its first batch may begin how many it has and where the next
    chunk's first one begins. These maps, a row a chunk, are followed one after another; then each chunk numbers its own."""
    chunk = max(chunk, max_batch)
    rows = numbered(items.select(key, F.floor(F.col("duration") * 100).cast("long").alias("frames")), ["frames", key], "__k")
    own, begins = F.floor(F.col("__k") / chunk), F.col("__k") % chunk < max_batch
    ahead = rows.select("frames", "__k", F.explode(F.when(begins & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))).alias("__chunk"))

    def maps(of: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__k")
        n = int((part["__k"] // chunk == of[0]).sum())
        after = _next_starts(part["frames"].to_numpy(), max_frames, max_batch)
        leaves, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            j = after[i]
            leaves[i], count[i] = (j - n, 1) if j >= n else (leaves[j], count[j] + 1)
        return pd.DataFrame({"__chunk": [of[0]], "leaves": [leaves[:max_batch]], "count": [count[:max_batch]]})

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, number = 0, 0
        for batch in batches:
            out = []
            for of, leaves, count in zip(batch["__chunk"].tolist(), batch["leaves"], batch["count"], strict=True):
                out.append((of, first, number))
                number, first = number + int(count[first]), int(leaves[first])
            yield pd.DataFrame(out, columns=["__chunk", "__first", "__number"])

    def number(of: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__k")
        mine = (part["__k"] // chunk == of[0]).to_numpy()
        n, first = int(mine.sum()), int(part["__first"].iloc[0])
        after = _next_starts(part["frames"].to_numpy(), max_frames, max_batch)
        starts = np.zeros(n, np.int64)
        while first < n:
            starts[first] = 1
            first = after[first]
        return pd.DataFrame({"__k": part["__k"].to_numpy()[mine], "batch": part["__number"].iloc[0] - 1 + np.cumsum(starts)})

    found = ahead.groupBy("__chunk").applyInPandas(maps, "__chunk long, leaves array<long>, count array<long>")
    entries = found.coalesce(1).sortWithinPartitions("__chunk").mapInPandas(follow, "__chunk long, __first long, __number long")
    batches = ahead.join(entries, "__chunk").groupBy("__chunk").applyInPandas(number, "__k long, batch long")
    return rows.join(batches, "__k").select(key, "frames", F.lit(0).alias("part"), "batch")


def epoch_order(batches: DataFrame, seed: int, epoch: int) -> DataFrame:
    """The batches (part, batch) with a sort key that shuffles them anew each epoch, never their contents."""
    return batches.select("part", "batch").distinct().withColumn("order", order_key(seed + epoch, "part", "batch"))


def ragged_pad(items: DataFrame, batch: str, values: str = "ids", pad: int = 0) -> DataFrame:
    """Each item's values padded to its batch's longest, with ``length`` and ``mask`` (1: real)."""
    longest = items.groupBy(batch).agg(F.max(F.size(values)).alias("__longest"))
    rows = items.join(longest, batch).withColumn("length", F.size(values))
    fill = lambda x: F.array_repeat(F.lit(x), F.col("__longest") - F.col("length"))
    kind = items.schema[values].dataType.simpleString()
    padded = F.concat(F.col(values), fill(pad).cast(kind))
    return rows.withColumn(values, padded).withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.col("length")), fill(0))).drop("__longest")


def _draw(bound, *parts):
    """A number from 0 to ``bound``, inclusive, by a hash that any engine can repeat."""
    digits = F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")
    return F.pmod(digits, bound + 1)


def random_crop(series: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """key, i (0 to n - 1), x: a window of ``n`` samples of each (key, n, x), at a hashed offset; series that are too
    short are looped. Only the samples that are asked for are read again, by their number."""
    sizes = series.groupBy("key").agg(F.count("*").alias("size"))
    whole = F.when(F.col("size") < n, (F.floor(F.lit(n) / F.col("size")) + 1) * F.col("size")).otherwise(F.col("size")).cast("long")
    starts = sizes.withColumn("start", _draw(whole - n, F.lit(seed), F.col("key")))
    wanted = starts.select("key", "size", "start", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("key", "i", F.pmod(F.col("start") + F.col("i"), F.col("size")).alias("n"))
    return wanted.join(series, ["key", "n"]).select("key", "i", "x")


def mask_spans(keys: DataFrame, bands: int, seed: int = 0, n_freq: int = 2, freq_width: int = 27, n_time: int = 5, time_share: float = 0.05, time_width: int = 40) -> DataFrame:
    """key, axis, low, high (exclusive) of the masked bands and time spans of each series (key, frames), none where the
    width drawn is 0 or leaves nothing."""
    widest = F.least(F.lit(time_width), F.greatest(F.lit(1), F.floor(F.col("frames") * time_share))).cast("long")
    drawn = lambda axis, count, size, most: keys.select("key", F.lit(axis).alias("axis"), size.cast("long").alias("size"), most.cast("long").alias("most"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    rows = drawn("band", n_freq, F.lit(bands), F.lit(freq_width)).unionByName(drawn("time", n_time, F.col("frames"), widest))
    rows = rows.withColumn("width", _draw(F.col("most"), F.lit(seed), F.col("key"), F.col("axis"), F.col("k"), F.lit("w"))).where("width > 0 and size > width")
    low = _draw(F.col("size") - F.col("width"), F.lit(seed), F.col("key"), F.col("axis"), F.col("k"), F.lit("at"))
    return rows.withColumn("low", low).select("key", "axis", "low", (F.col("low") + F.col("width")).alias("high"))


def span_mask(features: DataFrame, spans: DataFrame) -> DataFrame:
    """``features`` (key, frame, band, v) with 0 where a span of ``mask_spans`` covers the frame or band. A series has a
    handful of spans, which come as one row."""
    listed = spans.groupBy("key").agg(F.collect_list(F.struct("axis", "low", "high")).alias("__spans"))
    at = lambda s: F.when(s["axis"] == "band", F.col("band")).otherwise(F.col("frame"))
    hit = F.coalesce(F.exists("__spans", lambda s: (at(s) >= s["low"]) & (at(s) < s["high"])), F.lit(False))
    return features.join(listed, "key", "left").withColumn("v", F.when(hit, 0.0).otherwise(F.col("v"))).drop("__spans")
