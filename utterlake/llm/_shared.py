"""Small helpers shared by the operators of this subpackage.

``shared_dir`` and ``materialize`` are the only way these operators cut lineage: tables written to the folder
that all executors share (``spark.checkpoint.dir``), so that a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in a local session without one, a new temporary folder."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="utterlake-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once what was made from them is written too."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: it does so when the driver collects its garbage, which in
    a short run of large stages is too late for the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as no column of that name needs."""
    taken, name = {c.lower() for c in columns}, f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with pos, their number within their group in ``order`` from 0, and size, the group's number of rows.

    Rows are dealt by ranges, so that a hot group is shared by many tasks; what is added up over the ranges is a row for
    each range and group in it."""
    part = F.spark_partition_id()
    ranged = materialize(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("part", part).withColumn("at", F.monotonically_increasing_id()), "ranges")
    runs = ranged.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy(*group)
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", *[F.col(g).alias(f"of_{g}") for g in group], "first", before.alias("before"), F.sum("n").over(of).alias("size")).withColumnRenamed("part", "of_part")
    same = F.col("part") == F.col("of_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
    pos = (F.col("at") - F.col("first") + F.col("before")).alias("pos")
    numbered = materialize(ranged.join(runs, same).select(*rows.columns, pos, "size"), "placed")
    discard(ranged)
    return numbered


def let(value, body):
    """``body(value)`` with the value computed once, however often the body names it: lambdas compute what they name
    anew for every element, unless it is bound to a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc32_mod(column, modulus: int):
    """crc32 of the decimal text of a column, modulo ``modulus``; NULL counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


# --- byte-level hashing, vectorised over whole Arrow batches -------------------------------------------------

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside [\x20\x09-\x0D]: the parts of white-space tokens.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and all of non-ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE_INVERSE, k, 2**64))])
        return self.up, self.down


_POWERS = _Powers()


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial byte hash; one entry more than ``data``."""
    up, _ = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the bytes behind ``sums``; equal bytes give equal hashes."""
    _, down = _POWERS.upto(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(sums: np.ndarray, start: int, n: int, size: int) -> np.ndarray:
    """Hashes of the n strings of ``size`` bytes that begin at ``start`` and after."""
    _, down = _POWERS.upto(len(sums))
    return mix64((sums[start + size : start + size + n] - sums[start : start + n]) * down[start : start + n])


def token_spans(data: np.ndarray, inside: np.ndarray):
    """Starts and ends of the maximal runs of bytes for which the table ``inside`` is true."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = inside[data]
    edge = np.diff(mask)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def row_slices(batches, rows: int = 1024):
    """The Arrow batches in slices of at most ``rows`` rows, which share the batch's memory: what Python makes of a slice
    can go before the next one."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


#: Bytes of text at a time where what is made of them is many times as large.
SMALL_CHUNK = 1 << 18


def utf8_chunks(column, limit: int = 1 << 20):
    """Yield (first row, data, offsets) of an Arrow string column as bytes, in chunks of about ``limit`` bytes;
    NULL counts as the empty text. A longer text makes a chunk of its own."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
