"""Transcripts, wave files, pipe-separated manifests, JSON histories and append-only corpora."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..tables import numbered

MANIFEST = "utt_id string, text string, raw_text string, duration_s double"


def scan_pairs(spark: SparkSession, path: str, columns: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of a Parquet table in ``order``, only ``columns``: a top-k in every task, then of these."""
    return spark.read.parquet(path).select(*columns).orderBy(order).limit(n)


def scan_transcripts(spark: SparkSession, path: str, pattern: str = "*.trans.txt") -> DataFrame:
    """utt_id, text, path of the lines of all files below ``path``, split once at the first space; lines without one are
    left out."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    parts = F.split("value", " ", 2)
    return lines.where(F.instr("value", " ") > 0).select(parts[0].alias("utt_id"), parts[1].alias("text"), F.col("_metadata.file_path").alias("path"))


def pcm16_encode(samples: np.ndarray) -> bytes:
    """Samples clipped to [-1, 1], times 32767, towards zero, little-endian."""
    return (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()


def pcm16_decode(raw: bytes, channels: int = 1) -> np.ndarray:
    """Samples as fractions of 32768; several channels as their mean."""
    samples = np.frombuffer(raw, "<i2").astype(np.float64) / 32768
    return samples if channels == 1 else samples.reshape(-1, channels).mean(1)


def wave_bytes(samples: np.ndarray, rate: int = 16_000, times: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(pcm16_encode(samples) * times)
    return out.getvalue()


def with_wave(series: DataFrame, rate: int = 16_000) -> DataFrame:
    """path, content: (path, samples, and maybe times: how often they follow each other, 1 if it is not there) as wave files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 64):  # a file may be large
                part = batch.slice(start, 64)
                samples = [np.zeros(0) if x.values is None else np.asarray(x.values, float) for x in part["samples"]]
                content = [wave_bytes(x, rate, n) for x, n in zip(samples, part["times"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["path"], pa.array(content, pa.binary())], ["path", "content"])

    times = F.col("times").cast("int") if "times" in series.columns else F.lit(1)
    return series.select("path", "samples", times.alias("times")).mapInArrow(rows, "path string, content binary")


def audio_manifest(files: DataFrame, min_s: float = 1.0, max_s: float = 16.0) -> DataFrame:
    """path, duration of wave files (path, content, as ``binaryFile`` reads them) of ``min_s`` to ``max_s`` seconds, both
    inclusive. Durations come from the headers."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for raw in batch["content"]:
                with wave.open(io.BytesIO(raw)) as file:
                    found.append(file.getnframes() / file.getframerate())
            yield pd.DataFrame({"path": batch["path"], "duration": found})

    head = F.substring("content", 1, 4096)  # a header and no samples goes to the reader
    return files.select("path", head.alias("content")).mapInPandas(rows, "path string, duration double").where(F.col("duration").between(min_s, max_s))


def decode_blocks(files: DataFrame, block: int = 16_000, measures: dict[str, Callable[[np.ndarray], float]] | None = None) -> DataFrame:
    """path, block, samples: the samples of wave files in blocks of ``block``; the last may be shorter. ``measures``, functions
    of a block's samples, stand by their names in place of the samples, which then stay in the task."""

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
        for path, raw in zip(batch["path"], batch["content"], strict=True):
            with wave.open(io.BytesIO(raw.as_buffer())) as file:
                number = 0
                while part := file.readframes(block):
                    yield path.as_py(), number, pcm16_decode(part, file.getnchannels())
                    number += 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _some(blocks(batch), 4096 if measures else max(1, (1 << 20) // block)):
                path, number, samples = zip(*found, strict=True)
                if measures:
                    own = [pa.array([float(measure(x)) for x in samples], pa.float64()) for measure in measures.values()]
                else:
                    own = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, samples)]).astype(np.int32), np.concatenate(samples))]
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(number, pa.int64()), *own], ["path", "block", *(measures or ["samples"])])

    columns = ", ".join(f"{name} double" for name in measures) if measures else "samples array<double>"
    return files.select("path", "content").mapInArrow(rows, f"path string, block long, {columns}")


def _some(rows: Iterator, n: int) -> Iterator[list]:
    while held := list(islice(rows, n)):
        yield held


def write_manifest(rows: DataFrame, path: str) -> None:
    """Pipe-separated rows utt_id, text, raw_text, duration_s (three decimals); quotes keep pipes and quotes in texts."""
    duration = F.format_string("%.3f", "duration_s")
    rows.select("utt_id", "text", "raw_text", duration.alias("duration_s")).write.csv(path, sep="|", quote='"', escape='"', emptyValue="")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_manifest``; lines that have not four fields are dropped, whichever columns are asked for."""
    return spark.read.schema(MANIFEST).option("columnPruning", False).csv(path, sep="|", quote='"', escape='"', mode="DROPMALFORMED")


def next_ids(existing: DataFrame, new: DataFrame, order: list[str], prefix: str = "utt-") -> DataFrame:
    """``new`` with ``utt_id``: the prefix and numbers that go on from the largest there is, four digits at least. Rows
    are numbered range by range, so no task holds them all."""
    last = existing.agg(F.coalesce(F.max(F.substring("utt_id", len(prefix) + 1, 20).cast("long")), F.lit(-1)).alias("__last"))
    return numbered(new, order, "__k").crossJoin(last).withColumn("utt_id", F.concat(F.lit(prefix), F.format_string("%04d", F.col("__last") + 1 + F.col("__k")))).drop("__k", "__last")


def commit_batch(rows: DataFrame, table: str, batch: str, between=None) -> bool:
    """Append ``rows`` to a table as one batch: first the data, then the manifest row that makes them count. A run that is
    killed in between leaves files that no reader sees, and which the batch replaces when it runs again; a batch that the
    manifest has is left alone. ``between`` is called after the data are written."""
    spark = rows.sparkSession
    if committed(spark, table).where(F.col("batch") == batch).limit(1).count():
        return False
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{table}/data/batch={batch}")
    if between:
        between()
    spark.createDataFrame([(batch, seen.get["n"])], _BATCHES).coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/of={batch}")
    return True


_BATCHES = "batch string, n long"


def committed(spark: SparkSession, table: str) -> DataFrame:
    """batch, n: the batches that count, and their rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _BATCHES)
    return spark.read.schema(_BATCHES).parquet(f"{table}/manifest").select("batch", "n")


def read_committed(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of all batches that the manifest has."""
    data = spark.read.schema(f"{schema}, batch string").parquet(f"{table}/data")
    return data.join(committed(spark, table).select("batch"), "batch", "left_semi").drop("batch")


def write_artifact(rows: DataFrame, path: str, fingerprint: str) -> None:
    """Rows made from a corpus, with the fingerprint of that corpus beside them."""
    rows.write.parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(fingerprint,)], "fingerprint string").coalesce(1).write.parquet(f"{path}/made_from")


def read_artifact(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """The rows of an artifact, if it was made from the corpus of this fingerprint; else an error."""
    found = spark.read.schema("fingerprint string").parquet(f"{path}/made_from").first()["fingerprint"]
    return guard(spark.read.parquet(f"{path}/rows"), fingerprint, found)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def guard(data: DataFrame, wanted: str, found: str) -> DataFrame:
    """``data``, if an artifact's fingerprint is the wanted one; else an error."""
    if wanted != found:
        raise ValueError(f"made from other data: fingerprint {found}, wanted {wanted}")
    return data
