"""Selection of sentences for even n-gram coverage, and budgets in minutes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import written


def _with_counts(added: dict[str, int]):
    """Rows (idx, size, grams of gram and n) with ``added`` added to n."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = np.array([*added.values(), 0])
        for batch in batches:
            own = batch["grams"]
            flat, edges = own.flatten(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            gram = flat.field("gram")
            at = pc.index_in(gram, pa.array(list(added), gram.type)).fill_null(len(added)).to_numpy()
            counts = pa.array(flat.field("n").to_numpy() + more[at])
            grams = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([gram, counts], ["gram", "n"]))
            yield pa.RecordBatch.from_arrays([batch["idx"], batch["size"], grams], ["idx", "size", "grams"])

    return find


def greedy_coverage(candidates: DataFrame, n: int, order: int = 3, seen: DataFrame | None = None, top: int = 200) -> list[int]:
    """The idx of ``n`` sentences (idx, norm), each the best at its turn: the sum over its n-grams of 1 / (1 + count so
    far) over the root of its length; ties to the smaller idx. ``seen`` (gram, n) counts what is there already.

    Scores only fall, so old ones are upper bounds. A round scores all rows in Spark and brings the ``top`` best; of
    these the driver picks exactly, until the best one no longer beats the bound of the rest. The rows and the counts at
    the start are made once, into a table; later rounds add the counts of picked sentences to it where its rows lie.
    """
    spark = candidates.sparkSession
    grams = candidates.select("idx", F.length("norm").alias("size"), tx.char_ngrams(F.col("norm"), order).alias("grams")).where(F.size("grams") > 0)
    start = seen.select("gram", F.col("n").cast("long").alias("n")) if seen is not None else spark.createDataFrame([], "gram string, n long")
    rows = grams.select("idx", "size", F.explode("grams").alias("gram")).join(start.groupBy("gram").agg(F.sum("n").alias("n")), "gram", "left")
    base = written(rows.groupBy("idx", "size").agg(F.sort_array(F.collect_list(F.struct("gram", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("grams")), "coverage")
    added: dict[str, int] = {}
    picked: list[int] = []
    while len(picked) < n:
        left = base.join(spark.createDataFrame([(i,) for i in picked], "idx long"), "idx", "left_anti").select("idx", "size", "grams")
        scored = left.mapInArrow(_with_counts(dict(added)), left.schema) if added else left
        total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + 1.0 / (1 + g["n"]))
        best = scored.withColumn("score", total / F.sqrt("size")).orderBy(F.desc("score"), "idx").limit(top + 1).collect()
        if not best:
            break
        bound = (-best[top]["score"], best[top]["idx"]) if len(best) > top else None
        pool = {r["idx"]: (r["size"], [(g["gram"], g["n"]) for g in r["grams"]]) for r in best[:top]}
        now: dict[str, int] = {}
        while pool and len(picked) < n:
            score = {i: -sum(1.0 / (1 + k + now.get(g, 0)) for g, k in own) / size**0.5 for i, (size, own) in pool.items()}
            first = min(score, key=lambda i: (score[i], i))
            if bound is not None and (score[first], first) > bound:
                break
            for g, _ in pool.pop(first)[1]:
                now[g] = now.get(g, 0) + 1
                added[g] = added.get(g, 0) + 1
            picked.append(first)
    return picked


def minute_budget(sentences: DataFrame, have: DataFrame, minutes: float, per_minute: int = 150) -> DataFrame:
    """have_words, mean_words, n in one row: how many sentences (n_words) fill up what is there to ``minutes``; half to
    even, and none if there is enough within a twentieth."""
    own = have.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("have_words"))
    pool = sentences.agg(F.avg("n_words").alias("mean_words"))
    budget = F.lit(minutes * per_minute) - F.col("have_words")
    n = F.when(F.lit(minutes) > F.col("have_words") / per_minute * 1.05, F.greatest(F.lit(0.0), F.rint(budget / F.col("mean_words")))).otherwise(0.0)
    return own.crossJoin(pool).withColumn("n", n.cast("long"))
