"""Queries of sources and sinks: files are written from the given tables and read back by the readers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import files as fi
from ..tables import shared_folder
from . import views as v
from .q_prep import chosen, sents
from .views import with_sql


def scan_pairs(spark, d):
    """The first 100 documents: the limit is what the reader is asked for."""
    return fi.scan_pairs(spark, f"{d}/documents.parquet", ["doc_id", "lang"], "doc_id", 100)


def turns(spark, d):
    c = v.table(spark, d, "conversations")
    text = F.trim(F.regexp_replace(F.col("text"), r"\s+", " "))
    return c.select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("utt_id"), text.alias("text"), F.col("text").alias("raw_text"), (F.length("text") / 15).alias("duration_s"))


def scan_transcripts(spark, d):
    path = shared_folder(spark, "transcripts")
    turns(spark, d).select(F.concat_ws(" ", "utt_id", "text").alias("value")).write.text(path)
    spark.createDataFrame([("line",), ("",)], "value string").write.mode("append").text(path)  # lines that are no transcript
    return fi.scan_transcripts(spark, path, "*.txt").select("utt_id", "text")


def waves(spark, d):
    """A wave file of each vector, held 250 times: 16,000 samples or so."""
    e = v.table(spark, d, "embeddings")
    samples, times = F.col("embedding").cast("array<double>"), F.pmod("vec_id", F.lit(300)) + 200
    return fi.with_wave(e.select(F.concat(F.lit("wav/"), F.col("vec_id").cast("string")).alias("path"), samples.alias("samples"), times.alias("times")))


def audio_manifest(spark, d):
    return fi.audio_manifest(waves(spark, d), 1.0, 1.6)


def decode_blocks(spark, d):
    found = fi.decode_blocks(waves(spark, d), 8_000, {"n": len, "total": np.sum})  # sums of whole 32768ths, exact in any order
    return found.select("path", "block", F.col("n").cast("long").alias("n"), F.round("total", 6).alias("total"))


def voice_rows(spark, d):
    return turns(spark, d).where("text <> ''").select("utt_id", F.translate("text", "z", "|").alias("text"), F.concat(F.lit('"'), F.col("text")).alias("raw_text"), "duration_s")


def ljspeech_read(spark, d):
    """Written, joined by a line of three fields and one of five, and read back."""
    path = shared_folder(spark, "voice")
    fi.write_manifest(voice_rows(spark, d), path)
    spark.createDataFrame([("a|b|c",), ("a|b|c|1.0|d",)], "value string").write.mode("append").text(path)
    return fi.read_manifest(spark, path)


def append_corpus(spark, d):
    """Two batches, the second numbered on from the first; a third is killed before its manifest row, and another comes
    twice: neither changes what a reader sees."""
    path, schema = shared_folder(spark, "corpus"), "norm string, utt_id string"
    ids = lambda: fi.read_committed(spark, path, schema)
    rows = fi.next_ids(spark.createDataFrame([], "utt_id string"), chosen(spark, d).select("norm"), ["norm"])
    fi.commit_batch(rows, path, "first")
    rows.write.parquet(f"{path}/data/batch=killed")
    rest = sents(spark, d).where("doc_id % 3 = 1").select("norm")
    fi.commit_batch(fi.next_ids(ids(), rest, ["norm"]), path, "second")
    fi.commit_batch(rows, path, "first")
    return ids()


def json_sink(spark, d):
    path = shared_folder(spark, "history")
    rows = v.table(spark, d, "conversations").select("conv_id", "turn", F.struct("role", F.length("text").alias("chars")).alias("metrics"))
    fi.write_json(rows, path)
    back = fi.read_json(spark, path, "conv_id long, turn long, metrics struct<role: string, chars: long>")
    return back.select("conv_id", "turn", "metrics.role", "metrics.chars")


def fingerprint_guard(spark, d):
    """Labels that an earlier job made from the manifest are joined, as they carry its fingerprint."""
    from ..operators import prep as pr

    m, path = v.manifest(spark, d), shared_folder(spark, "labels")
    stamp = lambda: pr.corpus_fingerprint(v.manifest(spark, d), "doc_id", "path").first()["fingerprint"]
    fi.write_artifact(m.select("path", F.length("text").alias("chars")), path, stamp())
    return m.join(fi.read_artifact(spark, path, stamp()), "path").select("path", "speaker", "chars")


_TURNS = """turns AS (SELECT conv_id || '-' || turn AS utt_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, length(text) / CAST(15 AS DOUBLE) AS duration FROM conversations)"""
_WAVES = """w AS (SELECT vec_id, (vec_id % 300 + 200) AS times, CAST(len(embedding) AS BIGINT) AS dims, list_transform(embedding, lambda x: CAST(trunc(greatest(-1, least(1, CAST(x AS DOUBLE))) * 32767) AS DOUBLE) / 32768) AS v FROM embeddings)"""

QUERIES = {f.__name__: f for f in (scan_pairs, scan_transcripts, audio_manifest, decode_blocks, ljspeech_read, append_corpus, json_sink, fingerprint_guard)}
ORACLE_SQL = {
    "scan_pairs": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    "scan_transcripts": f"WITH {_TURNS} SELECT utt_id, text FROM turns",
    "audio_manifest": f"WITH {_WAVES} SELECT 'wav/' || vec_id AS path, times * dims / CAST(16000 AS DOUBLE) AS duration FROM w WHERE times * dims / CAST(16000 AS DOUBLE) BETWEEN 1.0 AND 1.6",
    "decode_blocks": f"""WITH {_WAVES}, s AS (SELECT vec_id, n, v[n % dims + 1] AS x FROM (SELECT *, unnest(range(times * dims)) AS n FROM w))
        SELECT 'wav/' || vec_id AS path, n // 8000 AS block, count(*) AS n, round(sum(x), 6) AS total FROM s GROUP BY vec_id, n // 8000""",
    "ljspeech_read": f"WITH {_TURNS} SELECT utt_id, translate(text, 'z', '|') AS text, '\"' || text AS raw_text, round(duration, 3) AS duration_s FROM turns WHERE text <> ''",
    "append_corpus": with_sql("""a AS (SELECT norm, row_number() OVER (ORDER BY norm) - 1 AS k FROM sentence_rows WHERE doc_id % 3 = 0),
        b AS (SELECT norm, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY norm) - 1 AS k FROM sentence_rows WHERE doc_id % 3 = 1)
        SELECT norm, 'utt-' || CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END AS utt_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""", "sentence_rows"),
    "json_sink": "SELECT conv_id, turn, role, length(text) AS chars FROM conversations",
    "fingerprint_guard": "SELECT source || '/' || source || '-' || doc_id AS path, source AS speaker, length(text) AS chars FROM documents",
}
