"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm._shared import materialize
from utterlake.llm.decontamination import drop_contaminated
from utterlake.llm.line_dedup import dedup_lines
from utterlake.llm.near_dup import keep_one
from utterlake.llm.packing import pack_documents
from utterlake.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject.

    NULL and empty texts are scored like any other; equal texts, and rows that repeat a doc_id or have none, are judged
    each by its text, with one score for equal ones. An empty table stays empty."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines; n_chars follows the text.

    A NULL text becomes ''; of equal lines the largest doc_id keeps all of its own; rows that repeat a doc_id count as
    one document; rows without a doc_id stay whole. An empty table stays empty."""
    return dedup_lines(docs, counts=None).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id.

    NULL and empty texts are one class; rows that repeat the doc_id of a kept document all stay, rows without a doc_id
    too. An empty table stays empty."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark.

    Each row is judged by its text alone, whatever its doc_id; NULL and empty texts stay; equal texts share a verdict. An
    empty table stays empty."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences.

    A NULL or empty text is its end id; repeated rows are packed as often as they come; of equally good places the
    smallest gap is taken. An empty table gives no pieces."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: The first stage is a fitted classifier; tests hold all stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
