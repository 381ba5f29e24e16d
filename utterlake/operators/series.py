"""Framing, spectra, mixing and levels of long-form series (key, n, x)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import audio as au
from ..tables import dealt


def frame_series(samples: DataFrame, length: int, hop: int) -> DataFrame:
    """key, frame, i, x: complete overlapping frames; each sample goes to the frames that cover it."""
    n = F.count("*").over(Window.partitionBy("key"))
    rows = samples.withColumn("__frames", (1 + F.floor((n - length) / hop)).cast("long")).where(F.col("__frames") > 0)
    low = F.greatest(F.lit(0), F.ceil((F.col("n") - length + 1) / hop)).cast("long")
    high = F.least(F.floor(F.col("n") / hop), F.col("__frames") - 1).cast("long")
    rows = rows.withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    rows = rows.withColumn("frame", F.explode(F.sequence("__low", "__high")))
    return rows.select("key", "frame", (F.col("n") - F.col("frame") * hop).alias("i"), "x")


def _twiddles(spark, n_fft: int, bins: int) -> DataFrame:
    """bin, i, re, im of the transform of real input; bounded by the frame size."""
    angle = F.col("bin") * F.col("i") * (-2 * math.pi / n_fft)
    table = spark.range(bins).withColumnRenamed("id", "bin").crossJoin(spark.range(n_fft).withColumnRenamed("id", "i"))
    return table.select("bin", "i", F.cos(angle).alias("re"), F.sin(angle).alias("im"))


def stft(frames: DataFrame, length: int, n_fft: int, periodic: bool = False) -> DataFrame:
    """key, frame, bin, re, im for bins 0 to n_fft / 2 of the windowed frames, zero-padded to n_fft."""
    window = au.hann_periodic_sqrt(F.col("i"), length) if periodic else au.hann_symmetric(F.col("i"), length)
    rows = frames.withColumn("xw", F.col("x") * window)
    table = _twiddles(frames.sparkSession, n_fft, n_fft // 2 + 1)
    joined = rows.join(F.broadcast(table), "i")  # (n_fft / 2 + 1) * n_fft rows, set by the parameter
    return joined.groupBy("key", "frame", "bin").agg(F.sum(F.col("xw") * F.col("re")).alias("re"), F.sum(F.col("xw") * F.col("im")).alias("im"))


def dft_power(frames: DataFrame, length: int, n_fft: int) -> DataFrame:
    """key, frame, bin, power by a join with the transform's coefficients; for small transforms."""
    return stft(frames, length, n_fft).select("key", "frame", "bin", (F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


def fft_power(frames: DataFrame, length: int, n_fft: int) -> DataFrame:
    """The same by NumPy's fast transform over arrays of frames; for n_fft of 256 and more."""
    packed = frames.groupBy("key", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("xs"))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / (length - 1))

    def power(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                p = np.abs(np.fft.rfft(np.stack(batch["xs"].to_numpy()) * hann, n_fft)) ** 2
                yield pd.DataFrame({"key": batch["key"], "frame": batch["frame"], "p": list(p)})

    rows = packed.mapInPandas(power, "key long, frame long, p array<double>")
    return rows.select("key", "frame", F.posexplode("p").alias("bin", "power")).withColumn("bin", F.col("bin").cast("long"))


def overlap_add(spec: DataFrame, length: int, hop: int, n_fft: int) -> DataFrame:
    """key, n, x: inverse transform, window again, sum, over the summed squared window (at least 1e-8)."""
    spark = spec.sparkSession
    half = n_fft // 2
    angle = F.col("bin") * F.col("i") * (2 * math.pi / n_fft)
    table = spark.range(half + 1).withColumnRenamed("id", "bin").crossJoin(spark.range(length).withColumnRenamed("id", "i"))
    weight = F.when((F.col("bin") == 0) | (F.col("bin") == half), 1.0).otherwise(2.0) / n_fft
    table = table.select("bin", "i", (F.cos(angle) * weight).alias("c"), (F.sin(angle) * weight).alias("s"))
    inverse = spec.join(F.broadcast(table), "bin").groupBy("key", "frame", "i").agg(F.sum(F.col("re") * F.col("c") - F.col("im") * F.col("s")).alias("x"))
    window = au.hann_periodic_sqrt(F.col("i"), length)
    placed = inverse.select("key", (F.col("frame") * hop + F.col("i")).alias("n"), (F.col("x") * window).alias("x"), (window * window).alias("w"))
    return placed.groupBy("key", "n").agg((F.sum("x") / F.greatest(F.sum("w"), F.lit(1e-8))).alias("x"))


def mel_weights(spark, n_mels: int, n_fft: int, rate: int) -> DataFrame:
    """band, bin, weight > 0 of the triangular filterbank."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    points = [700 * (10 ** (top * k / (n_mels + 1) / 2595) - 1) for k in range(n_mels + 2)]
    bands = spark.createDataFrame([(k, points[k], points[k + 1], points[k + 2]) for k in range(n_mels)], "band long, low double, mid double, high double")
    hz = F.col("bin") * (rate / n_fft)
    rows = bands.crossJoin(spark.range(n_fft // 2 + 1).withColumnRenamed("id", "bin"))
    w = F.greatest(F.lit(0.0), F.least((hz - F.col("low")) / (F.col("mid") - F.col("low")), (F.col("high") - hz) / (F.col("high") - F.col("mid"))))
    return rows.select("band", "bin", w.alias("weight")).where("weight > 0")


def sparse_apply(power: DataFrame, weights: DataFrame) -> DataFrame:
    """key, frame, band, e: the power of each band."""
    return power.join(weights, "bin").groupBy("key", "frame", "band").agg(F.sum(F.col("power") * F.col("weight")).alias("e"))


def log_mel(energy: DataFrame) -> DataFrame:
    return energy.withColumn("v", F.log(F.col("e") + 1e-10))


def normalize_feats(feats: DataFrame, kind: str = "mean") -> DataFrame:
    """v per key and band: as it is (none), less its mean (mean), or also over its sample deviation + 1e-5 (meanvar)."""
    if kind == "none":
        return feats
    w = Window.partitionBy("key", "band")
    centred = F.col("v") - F.avg("v").over(w)
    return feats.withColumn("v", centred if kind == "mean" else centred / (F.coalesce(F.stddev_samp("v").over(w), F.lit(0.0)) + 1e-5))


def floor_znorm_inverse(feats: DataFrame, stats: DataFrame) -> DataFrame:
    """The values that ``floor_znorm`` was given, except that those below its floor are the floor."""
    return feats.join(stats, "band").withColumn("v", F.col("v") * F.col("std") + F.col("mean")).drop("mean", "std")


def floor_znorm(feats: DataFrame, stats: DataFrame, floor: float = -11.5) -> DataFrame:
    """v, no less than ``floor``, in corpus deviations from the corpus mean; stats: band, mean, std."""
    return feats.join(stats, "band").withColumn("v", (F.greatest(F.col("v"), F.lit(floor)) - F.col("mean")) / F.col("std")).drop("mean", "std")


def frame_rms_db(frames: DataFrame) -> DataFrame:
    return frames.groupBy("key", "frame").agg(au.level_db(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("db"))


def take_snr(samples: DataFrame, mask: DataFrame, hop: int) -> DataFrame:
    """key, snr: mean RMS of active over silent non-overlapping frames in dB; infinity if either is missing."""
    blocks = samples.groupBy("key", F.floor(F.col("n") / hop).alias("frame")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("c")).where(F.col("c") == hop)
    joined = blocks.join(mask.select("key", "frame", "active"), ["key", "frame"])
    means = joined.groupBy("key").agg(F.avg(F.when(F.col("active"), F.col("rms"))).alias("a"), F.avg(F.when(~F.col("active"), F.col("rms"))).alias("s"))
    return means.select("key", F.coalesce(20 * F.log10(F.col("a") / F.col("s")), F.lit(float("inf"))).alias("snr"))


def _pairs(ref: DataFrame, est: DataFrame) -> DataFrame:
    return ref.select("key", "n", F.col("x").alias("r")).join(est.select("key", "n", F.col("x").alias("e")), ["key", "n"])


def signal_snr(ref: DataFrame, est: DataFrame) -> DataFrame:
    s = _pairs(ref, est).groupBy("key").agg(F.sum(F.col("r") ** 2).alias("s"), F.sum((F.col("e") - F.col("r")) ** 2).alias("d"))
    return s.select("key", (10 * F.log10(F.col("s") / (F.col("d") + 1e-12))).alias("snr"))


def si_sdr(ref: DataFrame, est: DataFrame) -> DataFrame:
    """key, si_sdr: projection ratio of mean-centred series in dB, from one pass of sums."""
    s = _pairs(ref, est).groupBy("key").agg(F.count("*").alias("c"), F.sum("r").alias("r"), F.sum("e").alias("e"), F.sum(F.col("r") * F.col("e")).alias("re"), F.sum(F.col("r") ** 2).alias("rr"), F.sum(F.col("e") ** 2).alias("ee"))
    rr, re, ee = F.col("rr") - F.col("r") ** 2 / F.col("c"), F.col("re") - F.col("r") * F.col("e") / F.col("c"), F.col("ee") - F.col("e") ** 2 / F.col("c")
    target = re**2 / (rr + 1e-12)
    return s.select("key", (10 * F.log10((target + 1e-12) / (ee - target + 1e-12))).alias("si_sdr"))


def masked_attenuation(noisy: DataFrame, out: DataFrame, mask: DataFrame) -> DataFrame:
    """key, inside, outside: attenuation in dB within and outside the mask (key, n, active)."""
    rows = _pairs(noisy, out).join(mask.select("key", "n", "active"), ["key", "n"])
    att = lambda on: 10 * F.log10((F.sum(F.when(F.col("active") == on, F.col("r") ** 2)) + 1e-12) / (F.sum(F.when(F.col("active") == on, F.col("e") ** 2)) + 1e-12))
    return rows.groupBy("key").agg(att(True).alias("inside"), att(False).alias("outside"))


def noise_reduction_db(before: DataFrame, after: DataFrame, block: int) -> DataFrame:
    """key, block, db: 20 log10 of the RMS before over after in each block."""
    rms = lambda df, name: df.groupBy("key", F.floor(F.col("n") / block).alias("block")).agg(F.sqrt(F.avg(F.col("x") ** 2)).alias(name))
    return rms(before, "a").join(rms(after, "b"), ["key", "block"]).select("key", "block", (20 * F.log10((F.col("a") + 1e-12) / (F.col("b") + 1e-12))).alias("db"))


def peak_clipping(samples: DataFrame, level: float = 0.99) -> DataFrame:
    return samples.groupBy("key").agg(F.max(F.abs("x")).alias("peak"), F.count_if(F.abs("x") >= level).alias("clipped"))


def take_qc(takes: DataFrame) -> DataFrame:
    """Adds problems, warnings and ok to takes of peak, clipped, duration_s, snr_db, cer; a NULL duration means that no
    speech was found and is then the only problem; cer may be NULL."""
    c = F.col
    gate = lambda pairs: F.filter(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in pairs]), lambda m: m.isNotNull())
    problems = gate([(c("clipped") > 8, "clipped"), (c("peak") < 0.05, "too quiet"), (c("duration_s") < 0.7, "too short"), (c("duration_s") > 18, "too long")])
    warnings = gate([(c("snr_db") == float("inf"), "snr unmeasurable"), (c("snr_db") < 18, "noisy"), (c("cer") > 0.15, "misread")])
    none = c("duration_s").isNull()
    rows = takes.withColumn("problems", F.when(none, F.array(F.lit("no speech"))).otherwise(problems)).withColumn("warnings", F.when(none, F.array().cast("array<string>")).otherwise(warnings))
    return rows.withColumn("ok", F.size("problems") == 0)


def spectral_distance(ref: DataFrame, est: DataFrame, resolutions: list[tuple[int, int]]) -> DataFrame:
    """key, distance: over (length, hop) resolutions, Frobenius ratio plus mean absolute log-magnitude difference,
    summed and divided by the number of resolutions; those longer than the signal add nothing."""
    parts = None
    for length, hop in resolutions:
        mags = [stft(frame_series(df, length, hop), length, length, True).select("key", "frame", "bin", F.sqrt(F.greatest(F.col("re") ** 2 + F.col("im") ** 2, F.lit(1e-14))).alias(m)) for df, m in ((ref, "r"), (est, "e"))]
        both = mags[0].join(mags[1], ["key", "frame", "bin"]).groupBy("key").agg((F.sqrt(F.sum((F.col("r") - F.col("e")) ** 2)) / F.sqrt(F.sum(F.col("r") ** 2)) + F.avg(F.abs(F.log("r") - F.log("e")))).alias("d"))
        parts = both if parts is None else parts.unionByName(both)
    return parts.groupBy("key").agg((F.sum("d") / len(resolutions)).alias("distance"))


def sample_to_frame(labels: DataFrame, hop: int) -> DataFrame:
    """key, frame, label: 1 if more than half of the frame's samples are 1."""
    return labels.groupBy("key", F.floor(F.col("n") / hop).alias("frame")).agg((F.avg(F.col("label").cast("double")) > 0.5).cast("long").alias("label"))


def overlay_labels(bed: DataFrame, clips: DataFrame, hop: int) -> DataFrame:
    """key, frame, label: clip labels placed at start // hop on the bed; where they overlap the larger counts."""
    placed = clips.select("key", (F.col("frame") + F.floor(F.col("start") / hop)).alias("frame"), F.col("label").alias("c")).groupBy("key", "frame").agg(F.max("c").alias("c"))
    return bed.join(placed, ["key", "frame"], "left").select("key", "frame", F.greatest("label", F.coalesce("c", F.lit(0))).alias("label"))


def delay_align(raw: DataFrame, clean: DataFrame, delay: int) -> DataFrame:
    """key, n, clean, raw: each clean sample with the raw one ``delay`` before it, 0 where there is none."""
    moved = raw.select("key", (F.col("n") + delay).alias("n"), F.col("x").alias("raw"))
    return clean.select("key", "n", F.col("x").alias("clean")).join(moved, ["key", "n"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))


def _arrays(samples: DataFrame, name: str) -> DataFrame:
    """key, the series' samples in order of n, and the first n."""
    rows = samples.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("l"))
    return rows.select("key", F.transform("l", lambda s: s["x"]).alias(name), F.element_at("l", 1)["n"].alias(f"{name}_first"))


def best_lag(ref: DataFrame, est: DataFrame, max_lag: int, step: int = 4) -> DataFrame:
    """key, lag with the largest sum of products, the smallest such lag; overlaps of half the series or more. Series are
    gapless in n; all lags of a pair come from one transform of both, so a series is an array in its row."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lags = np.arange(-max_lag, max_lag + 1, step)
        for batch in batches:
            out = []
            for key, r, e, r0, e0 in zip(batch["key"], batch["r"], batch["e"], batch["r_first"], batch["e_first"], strict=True):
                size = 1 << (len(r) + len(e) - 1).bit_length()
                products = np.fft.irfft(np.fft.rfft(e, size) * np.conj(np.fft.rfft(r, size)), size)
                shift = lags + r0 - e0
                overlap = np.minimum(len(r), len(e) - shift) - np.maximum(0, -shift)
                fits = (overlap >= max(1, len(r) // 2)) & (np.abs(shift) < size)
                if fits.any():
                    sums = np.where(fits, np.round(products[np.where(fits, shift, 0) % size], 9), -np.inf)
                    out.append((key, int(lags[int(np.argmax(sums))])))
            yield pd.DataFrame(out, columns=["key", "lag"])

    return _arrays(ref, "r").join(_arrays(est, "e"), "key").mapInPandas(find, "key long, lag long")


def linear_regrid(samples: DataFrame, rate: float) -> DataFrame:
    """key, n, x resampled to round(n / rate) points from the first to the last sample, by linear interpolation."""
    return regrids(samples, (rate,)).select("key", "n", "x")


def regrids(samples: DataFrame, rates: tuple[float, ...]) -> DataFrame:
    """key, rate_id, n, x: ``linear_regrid`` at each rate, numbered from 0. Every sample makes the points that lie between
    it and the next one, so points meet no table of samples: there is no join, whose side could be taken for a small one.
    Partitions follow the number of samples, so the sort of a task stays of one size."""
    own = Window.partitionBy("key")
    samples = dealt(samples.where("key is not null").select("key", "n", "x"), "key")
    following = F.coalesce(F.lead("x").over(own.orderBy("n")), F.col("x"))
    rows = samples.select("key", F.col("n").alias("low"), "x", following.alias("next"), F.count("*").over(own).alias("size"))
    rows = rows.select("*", F.posexplode(F.array(*[F.lit(float(r)) for r in rates])).alias("rate_id", "rate"))
    rows = rows.withColumn("out", F.rint(F.col("size") / F.col("rate")).cast("long")).where("out > 0")
    last, gaps = F.col("size") - 1, F.col("out") - 1
    step = F.when(gaps > 0, last / gaps).otherwise(F.lit(0.0))
    # A point more at both ends than exact arithmetic has; the test of the point's own place decides.
    first = F.when(last > 0, F.greatest(F.floor(F.col("low") * gaps / last) - 1, F.lit(0))).otherwise(F.lit(0))
    until = F.when(last > 0, F.least(F.ceil((F.col("low") + 1) * gaps / last) + 1, gaps)).otherwise(gaps)
    points = rows.withColumns({"step": step, "first": first.cast("long"), "until": until.cast("long"), "last": last}).where("first <= until")
    points = points.select("*", F.explode(F.sequence("first", "until")).alias("n")).withColumn("at", F.col("n") * F.col("step"))
    points = points.where(F.least(F.floor("at"), F.col("last")) == F.col("low"))
    return points.select("key", F.col("rate_id").cast("long").alias("rate_id"), "n", (F.col("x") + (F.col("next") - F.col("x")) * (F.col("at") - F.col("low"))).alias("x"))


def mix_noise(speech: DataFrame, noise: DataFrame, snr_db: float) -> DataFrame:
    """key, n, x: the speech (key, n, x, clip) plus the noise of its clip (clip, n, x), repeated to its length and scaled to
    the target ratio. Samples meet by clip and place, so a noise table of many clips spreads the work."""
    clips = noise.groupBy("clip").agg(F.count("*").alias("len"), F.avg(F.col("x") ** 2).alias("pn"))
    own = speech.groupBy("key").agg(F.avg(F.col("x") ** 2).alias("ps"))
    rows = speech.join(own, "key").join(clips, "clip").withColumn("__m", F.col("n") % F.col("len"))
    rows = rows.join(noise.select("clip", F.col("n").alias("__m"), F.col("x").alias("noise")), ["clip", "__m"])
    scale = F.sqrt(F.col("ps") / (F.col("pn") * 10 ** (snr_db / 10) + 1e-12))
    return rows.select("key", "n", (F.col("x") + scale * F.col("noise")).alias("x"))
