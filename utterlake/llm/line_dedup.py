"""Line dedup over levelled, sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; only its 128-bit hash is stored. A run
is a sorted table ``(h1, h2, n_docs, keeper)``. Batches of documents arrive in descending ``doc_id`` order: the keys
of a batch are anti-joined with the runs that exist, so a key new to the store gets its keeper (the largest doc_id
holding it), a known key only adds to the count. The batch becomes a run of level 0; ``fanout`` runs of a level are
compacted into one of the next. Counts are combined map-side before every shuffle, so a line that a third of all
documents hold costs one row a task; the join of the dropped keys with the lines is an equi join that AQE can split.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, materialize, row_slices

_SPACE = b" \t\n\x0b\x0c\r"
_KEYS = "doc_id long, h1 long, h2 long"


def _key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()  # bytes.lower() touches A-Z only


def _hash(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


def _is_long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars


def line_keys(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """One row for each document row and distinct key of ``min_chars`` code points or more: doc_id, h1, h2."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            ids, h1, h2 = [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                found = {_key(x) for x in (text.as_py() or b"").split(b"\n")}
                for key in found:
                    if _is_long(key, min_chars):
                        a, b = _hash(key)
                        ids.append(doc_id)
                        h1.append(a)
                        h2.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(keys, _KEYS)


class LineRuns:
    """The levelled store of line keys."""

    def __init__(self, fanout: int = 2):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        run = materialize(rows.select("h1", "h2", "n_docs", "keeper").sortWithinPartitions("h1", "h2"), f"line-run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(_merged(full), level + 1)

    def add(self, batch: DataFrame) -> None:
        """Add the rows (doc_id, h1, h2) of a batch whose ids are all smaller than those added before."""
        keys = batch.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last"))
        runs = self.runs()
        if runs:
            known = reduce(DataFrame.union, [run.select("h1", "h2") for run in runs])
            fresh = keys.join(known, ["h1", "h2"], "left_anti").withColumn("keeper", F.col("last"))
            again = keys.join(known, ["h1", "h2"], "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            keys = fresh.unionByName(again)
        else:
            keys = keys.withColumn("keeper", F.col("last"))
        self._write(keys, 0)

    def merged(self) -> DataFrame | None:
        """Each key once: h1, h2, n_docs, keeper."""
        runs = self.runs()
        return runs[0] if len(runs) == 1 else _merged(runs) if runs else None


def _merged(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, runs).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def _ranges(low: int | None, high: int | None, n: int) -> list[tuple[int, int]]:
    """At most ``n`` ranges [from, to) over all ids, the highest first."""
    if low is None:
        return []
    step = max(1, -(-(high - low + 1) // n))
    return [(max(low, top - step), top) for top in range(high + 1, low, -step)]


def repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """The line keys of all documents, and the keys found in at least ``min_docs`` documents with their keeper."""
    keys = materialize(line_keys(docs, min_chars).where("doc_id is not null"), "line-keys")
    store = LineRuns(fanout)
    bounds = keys.agg(F.min("doc_id"), F.max("doc_id")).first()
    for low, high in _ranges(bounds[0], bounds[1], batches):
        store.add(keys.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)))
    merged = store.merged()
    if merged is None:
        merged = keys.select("h1", "h2", F.lit(0).cast("long").alias("n_docs"), F.col("doc_id").alias("keeper"))
    return keys, merged.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 2, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` without repeated lines, with ``n_lines`` (before) and ``n_dropped`` added under the names ``counts``; a
    column of ``docs`` by such a name is replaced. Without ``counts`` nothing is added.

    A key of ``min_chars`` code points or more that at least ``min_docs`` documents hold loses all its lines except
    those in the largest doc_id holding it. A NULL text is one empty line and becomes ''. Rows that repeat a doc_id
    are one document for counting, and each of them is rewritten. Rows whose doc_id is NULL have no place in the
    order: they are not counted and stay whole. Of copies of a line within the keeper all stay. A text of any length is
    one row. Empty tables give empty results; other columns pass unchanged, whatever their names.
    """
    if counts:
        docs = docs.drop(*counts)
    marker, owner = free_name(docs.columns, "dropped_keys"), free_name(docs.columns, "of")
    keys, repeated = repeated_lines(docs, min_docs, min_chars, batches, fanout)
    drops = keys.join(repeated, ["h1", "h2"]).where("doc_id <> keeper").groupBy(F.col("doc_id").alias(owner)).agg(F.collect_set(F.struct("h1", "h2")).alias(marker))
    joined = docs.join(drops, docs["doc_id"].cast("long") == drops[owner], "left").drop(owner)
    kept = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema] + [T.StructField(name, T.LongType()) for name in counts or ()])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch["text"].cast(pa.binary()), batch[marker], strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                n_lines.append(len(lines))
                if drop.is_valid:
                    gone = {(x["h1"], x["h2"]) for x in drop.as_py()}
                    lines = [x for x in lines if not (_is_long(k := _key(x), min_chars) and _hash(k) in gone)]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(b"\n".join(lines))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if name == "text" else batch[name] for name in batch.schema.names if name != marker]
            added = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *added], [f.name for f in kept])

    return joined.mapInArrow(rewrite, kept)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT y.doc_id, y.pos, y.line, (r.k IS NOT NULL AND y.doc_id <> r.keeper) AS gone
  FROM keyed y LEFT JOIN repeated r ON y.k = r.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
