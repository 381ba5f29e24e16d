"""Streams of event files, and tables that a stream's batches append to exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import commit_batch
from ..tables import shared_folder, written


def event_source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_slices(rows: DataFrame, path: str, order: str, slices: int, file_rows: int = 250_000) -> int:
    """The rows as ``slices`` sets of files that follow each other in ``order``: what a service leaves behind over time. The
    borders are quantiles, so the sets are about equal. Returns the number of files of a set, the same for all: a file
    holds ``file_rows`` or more, so none is empty where a set has several, and tasks write and read them side by side."""
    rows = written(rows.withColumn("__at", F.col(order).cast("double")), "slices")
    edges = rows.approxQuantile("__at", [k / slices for k in range(1, slices)], 0.001) if slices > 1 else []
    parts = []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = rows if low is None else rows.where(F.col("__at") > low)
        parts.append(part if high is None else part.where(F.col("__at") <= high))
    files = max(1, min(part.count() for part in parts) // file_rows)
    for part in parts:
        part = part.drop("__at")
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return files


def append_batches(stream: DataFrame, table: str, checkpoint: str, mode: str = "append", also: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over all that is there, each micro-batch into its own folder of ``table``. A batch that is run again
    after a kill replaces its folder, so every row is there exactly once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if also:
            also(batch, number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def append_committed(stream: DataFrame, table: str, checkpoint: str, between: Callable[[], None] | None = None) -> None:
    """Run a stream over all that is there; each micro-batch is a batch of ``commit_batch``, named by its number."""

    def put(batch: DataFrame, number: int) -> None:
        commit_batch(batch, table, str(number), between)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def append_split(stream: DataFrame, flag: str, main: str, side: str, checkpoint: str) -> None:
    """One run of a stream with two outputs: rows with ``flag`` go to the folder ``side``, the others to ``main``. Each
    micro-batch is computed once, and run again replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where(~F.col(flag)).drop(flag).write.mode("overwrite").parquet(f"{main}/batch={number}")
        batch.where(flag).drop(flag).write.mode("overwrite").parquet(f"{side}/batch={number}")
        batch.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def replay(rows: DataFrame, order: str, form: Callable[[DataFrame], DataFrame], slices: int = 3, mode: str = "append") -> DataFrame:
    """The result of a streaming form over ``rows``, fed as ``slices`` sets of files, one a micro-batch; with the batch's number."""
    spark = rows.sparkSession
    base = shared_folder(spark, "stream")
    files = write_slices(rows, f"{base}/in", order, slices)
    stream = form(event_source(spark, f"{base}/in", rows.schema, files))
    append_batches(stream, f"{base}/out", f"{base}/checkpoint", mode)
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
