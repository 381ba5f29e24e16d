"""Queries of the series operators; the waves have 64 samples a key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gates as ga
from ..operators import series as se
from . import views as v
from .q_scoring import r6
from .views import sql, with_sql

L, H = 16, 8


def waves(spark, d):
    return v.waves(spark, d)


def other(spark, d):
    """A changed copy of the waves: half as loud, with every fourth sample moved."""
    return waves(spark, d).withColumn("x", F.col("x") * 0.5 + F.when(F.col("n") % 4 == 0, 0.01).otherwise(0.0))


def framed(spark, d):
    return se.frame_series(waves(spark, d), L, H)


def frame_series(spark, d):
    return framed(spark, d).select("key", "frame", "i", *r6("x"))


def dft_power(spark, d):
    return se.dft_power(framed(spark, d), L, L).select("key", "frame", "bin", *r6("power"))


def fft_power(spark, d):
    return se.fft_power(framed(spark, d), L, L).select("key", "frame", "bin", *r6("power"))


def stft(spark, d):
    return se.stft(framed(spark, d), L, L).select("key", "frame", "bin", *r6("re", "im"))


def overlap_add(spark, d):
    rebuilt = se.overlap_add(se.stft(framed(spark, d), L, L, periodic=True), L, H, L)
    return rebuilt.select("key", "n", F.round("x", 6).alias("x"))


def log_mel(spark, d):
    power = se.dft_power(framed(spark, d), L, L)
    return se.log_mel(se.sparse_apply(power, se.mel_weights(spark, 3, L, 16000)))


def mel_energy(spark, d):
    return log_mel(spark, d).select("key", "frame", "band", *r6("e", "v"))


def sparse_apply(spark, d):
    return log_mel(spark, d).groupBy("band").agg(F.round(F.sum("e"), 4).alias("e"))


def normalize_feats(spark, d):
    return se.normalize_feats(bands(spark, d), "mean").select("key", "frame", "band", *r6("v"))


def normalize_feats_meanvar(spark, d):
    return se.normalize_feats(bands(spark, d), "meanvar").select("key", "frame", "band", *r6("v"))


def bands(spark, d):
    return waves(spark, d).select("key", F.floor(F.col("n") / 8).alias("frame"), (F.col("n") % 8).alias("band"), F.col("x").alias("v"))


def band_stats(spark, d):
    return bands(spark, d).groupBy("band").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_samp("v"), F.lit(1e-3)).alias("std"))


def floor_znorm_inverse(spark, d):
    stats = band_stats(spark, d)
    return se.floor_znorm_inverse(se.floor_znorm(bands(spark, d), stats, -0.1), stats).select("key", "frame", "band", *r6("v"))


def floor_znorm(spark, d):
    return se.floor_znorm(bands(spark, d), band_stats(spark, d), -0.1).select("key", "frame", "band", *r6("v"))


def frame_rms_db(spark, d):
    return se.frame_rms_db(framed(spark, d)).select("key", "frame", *r6("db"))


def take_snr(spark, d):
    mask = waves(spark, d).groupBy("key", F.floor(F.col("n") / 8).alias("frame")).agg((F.max("x") > 0.25).alias("active"))
    return se.take_snr(waves(spark, d), mask, 8).select("key", *r6("snr"))


def signal_snr(spark, d):
    return se.signal_snr(waves(spark, d), other(spark, d)).select("key", *r6("snr"))


def si_sdr(spark, d):
    return se.si_sdr(waves(spark, d), other(spark, d)).select("key", *r6("si_sdr"))


def masked_attenuation(spark, d):
    return se.masked_attenuation(waves(spark, d), other(spark, d), waves(spark, d).withColumn("active", F.col("x") > 0)).select("key", *r6("inside", "outside"))


def noise_reduction_db(spark, d):
    return se.noise_reduction_db(waves(spark, d), other(spark, d), 16).select("key", "block", *r6("db"))


def peak_clipping(spark, d):
    return se.peak_clipping(waves(spark, d), 0.3).select("key", *r6("peak"), "clipped")


def take_qc(spark, d):
    """Peaks and clipping of the whole take; duration and ratio of what lies between its first and last active frame; the
    misreading of the turn that the take's key opens a conversation with."""
    rate, hop = 64, 8
    raw = waves(spark, d).withColumn("x", F.col("x") * 3)
    active = lambda samples: samples.groupBy("key", F.floor(F.col("n") / hop).alias("frame")).agg((F.max("x") > 0.6).alias("active"))
    segments = ga.segments(active(raw).withColumnRenamed("frame", "seq"), hop_s=hop / rate)
    spans = ga.trim_to_active(segments, raw.groupBy("key").agg((F.count("*") / rate).alias("length_s")))
    first = F.ceil(F.col("start_s") * rate)
    trimmed = raw.join(spans, "key").where((F.col("n") >= first) & (F.col("n") < F.col("end_s") * rate)).select("key", (F.col("n") - first).alias("n"), "x")
    misread = v.hyp_ref(spark, d).where("turn = 0").select(F.col("conv_id").alias("key"), tx.cer(F.col("hyp"), F.col("ref")).alias("cer"))
    takes = se.peak_clipping(raw, 0.99).join(spans.select("key", (F.col("end_s") - F.col("start_s")).alias("duration_s")), "key")
    takes = takes.join(se.take_snr(trimmed, active(trimmed), hop).withColumnRenamed("snr", "snr_db"), "key", "left").join(misread, "key", "left")
    found = se.take_qc(takes)
    return found.select("key", *r6("duration_s", "snr_db", "cer"), F.array_join("problems", ";").alias("problems"), F.array_join("warnings", ";").alias("warnings"), "ok")


def spectral_distance(spark, d):
    return se.spectral_distance(waves(spark, d), other(spark, d), [(8, 4), (16, 8), (128, 32)]).select("key", F.round("distance", 5).alias("distance"))


def sample_to_frame(spark, d):
    return se.sample_to_frame(waves(spark, d).withColumn("label", (F.col("x") > 0).cast("long")), 4)


def overlay_labels(spark, d):
    bed = se.sample_to_frame(waves(spark, d).withColumn("label", (F.col("x") > 0.1).cast("long")), 4)
    clips = se.sample_to_frame(waves(spark, d).where("n < 16").withColumn("label", (F.col("x") > 0).cast("long")), 4).withColumn("start", (F.col("key") % 30).cast("long"))
    return se.overlay_labels(bed, clips, 4)


def delay_align(spark, d):
    return se.delay_align(waves(spark, d), other(spark, d), 5).select("key", "n", *r6("clean", "raw"))


def best_lag(spark, d):
    moved = waves(spark, d).select("key", (F.col("n") + 8).alias("n"), "x")
    return se.best_lag(waves(spark, d), moved, 16, 4)


def linear_regrid(spark, d):
    return se.linear_regrid(waves(spark, d), 1.1).select("key", "n", *r6("x"))


def mix_noise(spark, d):
    """Every user's series is a noise clip; waves take the clips in turn."""
    f = v.frames(spark, d).select("key", "seq", (F.col("p") - 0.5).alias("x"))
    clips = f.select("key").distinct().withColumn("clip", F.row_number().over(Window.orderBy("key")) - 1)  # a row a clip
    noise = f.join(clips, "key").select("clip", F.col("seq").alias("n"), "x")
    speech = waves(spark, d).withColumn("clip", F.col("key") % clips.count())
    return se.mix_noise(speech, noise, 10.0).select("key", "n", *r6("x"))


_FRAMED = "framed AS (SELECT key, f AS frame, n - f * 8 AS i, x FROM waves, (SELECT CAST(unnest(range(7)) AS BIGINT) AS f) WHERE n >= f * 8 AND n < f * 8 + 16)"
_STFT = _FRAMED + """, spec AS (SELECT key, frame, bin, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * cos(-2 * pi() * bin * i / 16)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * sin(-2 * pi() * bin * i / 16)) AS im
  FROM framed, (SELECT CAST(unnest(range(9)) AS BIGINT) AS bin) GROUP BY key, frame, bin)"""
_POWER = with_sql(_STFT + " SELECT key, frame, bin, round(re * re + im * im, 6) AS power FROM spec", "waves")
_MEL = _STFT + """, pts AS (SELECT k, 700 * (pow(CAST(10 AS DOUBLE), 2595 * log10(1 + 8000 / CAST(700 AS DOUBLE)) * k / 4 / 2595) - 1) AS hz FROM (SELECT unnest(range(5)) AS k)),
  w AS (SELECT a.k AS band, bin, greatest(0, least((bin * 1000 - a.hz) / (b.hz - a.hz), (c.hz - bin * 1000) / (c.hz - b.hz))) AS weight FROM pts a, pts b, pts c, (SELECT CAST(unnest(range(9)) AS BIGINT) AS bin) WHERE b.k = a.k + 1 AND c.k = a.k + 2),
  mel AS (SELECT key, frame, band, sum((re * re + im * im) * weight) AS e FROM spec JOIN w USING (bin) WHERE weight > 0 GROUP BY key, frame, band)"""
_OTHER = "other AS (SELECT key, n, x * 0.5 + CASE WHEN n % 4 = 0 THEN CAST(0.01 AS DOUBLE) ELSE 0 END AS e FROM waves), both_ AS (SELECT w.key, w.n, w.x AS r, o.e FROM waves w JOIN other o ON w.key = o.key AND w.n = o.n)"
_BANDS = "bands AS (SELECT key, n // 8 AS frame, n % 8 AS band, x AS v FROM waves)"
_S2F = "(SELECT key, n // 4 AS frame, CAST(avg(CASE WHEN x > {t} THEN 1.0 ELSE 0.0 END) > 0.5 AS BIGINT) AS label FROM waves {w} GROUP BY key, n // 4)"

QUERIES = {f.__name__: f for f in (frame_series, dft_power, fft_power, stft, overlap_add, mel_energy, sparse_apply, normalize_feats, normalize_feats_meanvar, floor_znorm, floor_znorm_inverse, frame_rms_db, take_snr, signal_snr, si_sdr, masked_attenuation, noise_reduction_db, peak_clipping, take_qc, spectral_distance, sample_to_frame, overlay_labels, delay_align, best_lag, linear_regrid, mix_noise)}
ORACLE_SQL = {
    "frame_series": with_sql(_FRAMED + " SELECT key, frame, i, round(x, 6) AS x FROM framed", "waves"),
    "dft_power": _POWER,
    "fft_power": _POWER,
    "stft": with_sql(_STFT + " SELECT key, frame, bin, round(re, 6) AS re, round(im, 6) AS im FROM spec", "waves"),
    "overlap_add": with_sql(_FRAMED + ", o AS (SELECT key, frame * 8 + i AS n, x, 0.5 - 0.5 * cos(2 * pi() * i / 16) AS w FROM framed) SELECT key, n, round(max(x) * sum(w) / greatest(sum(w), 1e-8), 6) + 0.0 AS x FROM o GROUP BY key, n", "waves"),
    "floor_znorm_inverse": with_sql(_BANDS + " SELECT key, frame, band, round(greatest(v, CAST(-0.1 AS DOUBLE)), 6) AS v FROM bands", "waves"),
    "mel_energy": with_sql(_MEL + " SELECT key, frame, band, round(e, 6) AS e, round(ln(e + 1e-10), 6) AS v FROM mel", "waves"),
    "sparse_apply": with_sql(_MEL + " SELECT band, round(sum(e), 4) AS e FROM mel GROUP BY band", "waves"),
    "normalize_feats": with_sql(_BANDS + " SELECT key, frame, band, round(v - avg(v) OVER (PARTITION BY key, band), 6) AS v FROM bands", "waves"),
    "normalize_feats_meanvar": with_sql(_BANDS + " SELECT key, frame, band, round((v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-5), 6) AS v FROM bands WINDOW w AS (PARTITION BY key, band)", "waves"),
    "floor_znorm": with_sql(_BANDS + ", s AS (SELECT band, avg(v) AS m, greatest(stddev_samp(v), 1e-3) AS d FROM bands GROUP BY band) SELECT key, frame, band, round((greatest(v, CAST(-0.1 AS DOUBLE)) - m) / d, 6) AS v FROM bands JOIN s USING (band)", "waves"),
    "frame_rms_db": with_sql(_FRAMED + " SELECT key, frame, round(20 * log10(sqrt(avg(x * x)) + 1e-12), 6) AS db FROM framed GROUP BY key, frame", "waves"),
    "take_snr": with_sql("b AS (SELECT key, n // 8 AS f, sqrt(avg(x * x)) AS r, max(x) > 0.25 AS a FROM waves GROUP BY key, n // 8) SELECT key, round(coalesce(20 * log10(avg(r) FILTER (a) / avg(r) FILTER (NOT a)), CAST('inf' AS DOUBLE)), 6) AS snr FROM b GROUP BY key", "waves"),
    "signal_snr": with_sql(_OTHER + " SELECT key, round(10 * log10(sum(r * r) / (sum((e - r) * (e - r)) + 1e-12)), 6) AS snr FROM both_ GROUP BY key", "waves"),
    "si_sdr": with_sql(_OTHER + """, s AS (SELECT key, sum(r * r) - sum(r) * sum(r) / count(*) AS rr, sum(r * e) - sum(r) * sum(e) / count(*) AS re, sum(e * e) - sum(e) * sum(e) / count(*) AS ee FROM both_ GROUP BY key)
        SELECT key, round(10 * log10((re * re / (rr + 1e-12) + 1e-12) / (ee - re * re / (rr + 1e-12) + 1e-12)), 6) AS si_sdr FROM s""", "waves"),
    "masked_attenuation": with_sql(_OTHER + " SELECT key, round(10 * log10((sum(r * r) FILTER (r > 0) + 1e-12) / (sum(e * e) FILTER (r > 0) + 1e-12)), 6) AS inside, round(10 * log10((sum(r * r) FILTER (r <= 0) + 1e-12) / (sum(e * e) FILTER (r <= 0) + 1e-12)), 6) AS outside FROM both_ GROUP BY key", "waves"),
    "noise_reduction_db": with_sql(_OTHER + " SELECT key, n // 16 AS block, round(20 * log10((sqrt(avg(r * r)) + 1e-12) / (sqrt(avg(e * e)) + 1e-12)), 6) AS db FROM both_ GROUP BY key, n // 16", "waves"),
    "peak_clipping": sql("SELECT key, round(max(abs(x)), 6) AS peak, count(*) FILTER (abs(x) >= 0.3) AS clipped FROM waves GROUP BY key", "waves"),
    "take_qc": with_sql("""w AS (SELECT key, n, x * 3 AS x FROM waves), p AS (SELECT key, max(abs(x)) AS peak, count(*) FILTER (abs(x) >= 0.99) AS clipped FROM w GROUP BY key),
        f AS (SELECT key, n // 8 AS f, max(x) > 0.6 AS a FROM w GROUP BY key, n // 8), g AS (SELECT key, greatest(0, min(f) FILTER (a) / CAST(8 AS DOUBLE) - CAST(0.1 AS DOUBLE)) AS s, least(1, (max(f) FILTER (a) + 1) / CAST(8 AS DOUBLE) + CAST(0.1 AS DOUBLE)) AS e, bool_or(a) AS any_ FROM f GROUP BY key),
        t AS (SELECT key, CAST(n - ceil(s * 64) AS BIGINT) AS n, x FROM w JOIN g USING (key) WHERE any_ AND n >= ceil(s * 64) AND n < e * 64),
        b AS (SELECT key, n // 8 AS f, sqrt(avg(x * x)) AS r, max(x) > 0.6 AS a FROM t GROUP BY key, n // 8 HAVING count(*) = 8),
        r AS (SELECT key, coalesce(20 * log10(avg(r) FILTER (a) / avg(r) FILTER (NOT a)), CAST('inf' AS DOUBLE)) AS snr FROM b GROUP BY key),
        c AS (SELECT conv_id AS key, levenshtein(hyp, ref) / CAST(greatest(1, length(ref)) AS DOUBLE) AS cer FROM hyp_ref WHERE turn = 0),
        q AS (SELECT p.key, CASE WHEN any_ THEN e - s END AS d, snr, cer, peak, clipped FROM p JOIN g USING (key) LEFT JOIN r USING (key) LEFT JOIN c USING (key)),
        z AS (SELECT *, CASE WHEN d IS NULL THEN 'no speech' ELSE concat_ws(';', CASE WHEN clipped > 8 THEN 'clipped' END, CASE WHEN peak < 0.05 THEN 'too quiet' END, CASE WHEN d < 0.7 THEN 'too short' END, CASE WHEN d > 18 THEN 'too long' END) END AS problems,
          CASE WHEN d IS NULL THEN '' ELSE concat_ws(';', CASE WHEN isinf(snr) THEN 'snr unmeasurable' END, CASE WHEN snr < 18 THEN 'noisy' END, CASE WHEN cer > 0.15 THEN 'misread' END) END AS warnings FROM q)
        SELECT key, round(d, 6) AS duration_s, round(snr, 6) AS snr_db, round(cer, 6) AS cer, problems, warnings, problems = '' AS ok FROM z""", "waves", "hyp_ref"),
    "sample_to_frame": sql("SELECT * FROM " + _S2F.format(t="0", w=""), "waves"),
    "overlay_labels": with_sql(f"bed AS {_S2F.format(t='0.1', w='')}, clip AS {_S2F.format(t='0', w='WHERE n < 16')}, p AS (SELECT key, frame + (key % 30) // 4 AS frame, max(label) AS c FROM clip GROUP BY 1, 2) SELECT key, frame, greatest(label, coalesce(c, 0)) AS label FROM bed LEFT JOIN p USING (key, frame)", "waves"),
    "delay_align": with_sql(_OTHER + " SELECT o.key, o.n, round(o.e, 6) AS clean, round(coalesce(w.x, 0), 6) AS raw FROM other o LEFT JOIN waves w ON w.key = o.key AND w.n + 5 = o.n", "waves"),
    "best_lag": with_sql("""l AS (SELECT unnest(range(-16, 17, 4)) AS lag), s AS (SELECT a.key, lag, round(sum(a.x * b.x), 9) AS s, count(*) AS c FROM waves a, l, waves b WHERE b.key = a.key AND b.n + 8 - lag = a.n GROUP BY 1, 2)
        SELECT key, lag FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, lag) AS r FROM s WHERE c >= 32) WHERE r = 1""", "waves"),
    "linear_regrid": with_sql("""g AS (SELECT key, n AS i, n * (63 / CAST(57 AS DOUBLE)) AS pos FROM waves WHERE n < 58) SELECT g.key, g.i AS n, round(a.x + (coalesce(b.x, a.x) - a.x) * (pos - floor(pos)), 6) AS x
        FROM g JOIN waves a ON a.key = g.key AND a.n = least(floor(pos), 63) LEFT JOIN waves b ON b.key = g.key AND b.n = a.n + 1""", "waves"),
    "mix_noise": with_sql("""c AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS clip FROM (SELECT DISTINCT key FROM frames)), z AS (SELECT clip, seq AS n, p - 0.5 AS x FROM frames JOIN c USING (key)),
        pn AS (SELECT clip, avg(x * x) AS pn, count(*) AS len FROM z GROUP BY clip), ps AS (SELECT key, avg(x * x) AS ps FROM waves GROUP BY key)
        SELECT w.key, w.n, round(w.x + sqrt(ps / (pn * 10 + 1e-12)) * z.x, 6) AS x FROM waves w JOIN ps USING (key) JOIN pn ON pn.clip = w.key % (SELECT count(*) FROM c) JOIN z ON z.clip = pn.clip AND z.n = w.n % pn.len""", "waves", "frames"),
}
