"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are normalised, projected to a few dimensions and put on several Hilbert curves, each shifted by an offset of
its own. Spark range-partitions every ordering by its key and cuts it into blocks of neighbours; a query looks at the
blocks around its own place on each curve. The merged windows give every query five good candidates and so a bound;
the remaining blocks of the first curve are visited only where the block's centre and radius allow a vector nearer
than that bound (cosine of the least possible angle). So the result is exact on any data: vectors without structure
cost more blocks, never recall. Scores are cosines of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize

_MARGIN = 1e-6


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points on a grid of 2**bits cells a side (rows of ``cells``), by the
    transposed Gray-code transform; the bits of the transform are interleaved into one integer."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    top = np.int64(1 << (bits - 1))
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            swap = (x[:, i] & q) == 0
            t = np.where(swap, (x[:, 0] ^ x[:, i]) & p, 0)
            x[:, 0] = np.where(swap, x[:, 0] ^ t, x[:, 0] ^ p)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, dims: int = 8, bits: int = 7) -> np.ndarray:
    """Hilbert keys of unit vectors on one curve: a projection and a shift drawn from the curve's number."""
    width = unit.shape[1]
    rng = np.random.default_rng(7919 + curve)
    axes = np.linalg.qr(rng.standard_normal((width, min(dims, width))))[0]
    spread = 3 / np.sqrt(width)  # three standard deviations of a coordinate of a random unit vector
    place = (unit @ axes / spread + 1) / 2  # 0 to 1, for nearly all
    cells = np.clip((place / 2 + rng.random(axes.shape[1]) / 2) * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_keys(cells.astype(np.int64), bits)


def usable_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, vector (doubles) of the rows whose vector has a length, is finite and not zero."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    found = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = found.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    return found.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that neither tiny nor huge components overflow."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def with_keys(vectors: DataFrame, curves: int, every: int) -> DataFrame:
    """vec_id, vector, its hash h1, h2, is_query, and the key on each curve."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            out = batch.assign(is_query=batch["vec_id"] % every == 0)
            for _, group in out.groupby(out["vector"].map(len)):
                unit = _unit(_stack(group["vector"]))
                yield group.assign(**{f"key{c}": curve_keys(unit, c) for c in range(curves)})

    schema = "vec_id long, vector array<double>, h1 long, h2 long, is_query boolean, " + ", ".join(f"key{c} long" for c in range(curves))
    return vectors.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")}).mapInPandas(keys, schema)


def curve_blocks(keyed: DataFrame, curve: int, rows: int, partitions: int) -> DataFrame:
    """The vectors in the order of one curve, in blocks of about ``rows`` neighbours within a range partition: width,
    curve, block, low and high key, ids, flat (doubles, little-endian), centre and radius (an angle)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held, number = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 8 * rows:
                table = pd.concat(held)
                full = len(table) // rows * rows
                for a in range(0, full, rows):
                    yield from _blocks(table.iloc[a : a + rows], curve, part, number)
                    number += 1
                held = [table.iloc[full:]]
        table = pd.concat(held) if held else pd.DataFrame({"vec_id": []})
        for a in range(0, len(table), rows):
            yield from _blocks(table.iloc[a : a + rows], curve, part, number)
            number += 1

    key = f"key{curve}"
    ordered = keyed.select("vec_id", "vector", F.col(key).alias("key")).repartitionByRange(partitions, "key", "vec_id").sortWithinPartitions("key", "vec_id")
    return ordered.mapInPandas(pack, "curve int, block long, width int, low long, high long, ids binary, flat binary, centre array<double>, radius double")


def _blocks(table: pd.DataFrame, curve: int, part: int, number: int) -> Iterator[pd.DataFrame]:
    for k, (width, group) in enumerate(table.groupby(table["vector"].map(len))):
        raw = _stack(group["vector"])
        unit = _unit(raw)
        centre = unit.mean(0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 1e-9 else unit[0]
        radius = float(np.arccos(np.clip((unit @ centre).min(), -1, 1)))
        keys = group["key"]
        yield pd.DataFrame([{"curve": curve, "block": (part << 32) + (number << 8) + k, "width": width, "low": keys.min(), "high": keys.max(), "ids": group["vec_id"].to_numpy(np.int64).tobytes(), "flat": raw.tobytes(), "centre": centre.tolist(), "radius": radius}])


_FOUND = "query_id long, vec_id long, score double"


def best_of(query: np.ndarray, ids: np.ndarray, unit: np.ndarray, rough: np.ndarray, k: int, bound: float | None = None) -> list[tuple[int, float]]:
    """(id, cosine) of the k nearest, ties to the smaller id; none below ``bound``, the k-th best known already.
    ``rough`` comes from a matrix product, whose last bits depend on a row's place; those near the k-th are summed again
    row by row, so that equal vectors score the same."""
    least = -2.0 if bound is None else bound
    if len(rough) > k:
        least = max(least, np.partition(rough, len(rough) - k)[len(rough) - k])
    near = np.flatnonzero(rough >= least - 1e-12)
    scores = (unit[near] * query).sum(1)
    order = np.lexsort((ids[near], -scores))[:k]
    return list(zip(ids[near][order].tolist(), scores[order].tolist(), strict=True))


def _search(pairs: DataFrame, blocks: DataFrame, k: int, chunk_rows: int = 256) -> DataFrame:
    """The best k of each (query, block) pair; pairs: curve, block, query_id, vector, bound. The queries of a block are
    gathered in chunks of about ``chunk_rows``, so a block that all queries visit is dealt to many tasks."""
    visits = pairs.groupBy("curve", "block").agg(F.ceil(F.count("*") / chunk_rows).alias("chunks"))
    dealt = pairs.join(visits, ["curve", "block"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")))
    asked = dealt.groupBy("curve", "block", "chunk").agg(F.collect_list(F.struct("query_id", "vector", "bound")).alias("queries"))
    joined = asked.join(blocks.select("curve", "block", "ids", "flat", "width"), ["curve", "block"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                unit = _unit(np.frombuffer(row.flat, np.float64).reshape(len(ids), row.width))
                queries = _unit(np.array([q["vector"] for q in row.queries], np.float64))
                out = []
                for q, own, rough in zip(row.queries, queries, queries @ unit.T, strict=True):
                    out += [(q["query_id"], *found) for found in best_of(own, ids, unit, rough, k, q["bound"])]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return joined.select("queries", "ids", "flat", "width").mapInPandas(best, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best different candidates of each query with their rank; Spark cuts each task's rows to k a query before
    the shuffle."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, k: int = 5, every: int = 50, curves: int = 4, window: int = 1, block_rows: int = 256, exact: bool = True, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query (ids divisible by ``every``), by cosine.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without an id, take no part;
    vectors of another width than the query's are no candidates. Of rows that repeat an id the one of the smallest
    vector counts. Equal vectors are one query and, as candidates, their smallest ids. Without ``exact`` only the
    windows are searched. An empty table gives an empty result.
    """
    keyed = materialize(with_keys(usable_vectors(rows, id_column, vector_column), curves, every), "curve-keys")
    # Of equal vectors no more than k + 1 can be among a query's k nearest and the query itself.
    first_ids = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    candidates = materialize(keyed.withColumn("__n", first_ids).where(F.col("__n") <= k + 1).drop("__n"), "candidates")
    partitions = max(1, min(1 << 14, -(-candidates.count() // (16 * block_rows))))
    blocks = materialize(_union(curve_blocks(candidates, c, block_rows, partitions) for c in range(curves)), "curve-blocks")
    members = keyed.where("is_query")
    chosen = members.groupBy("h1", "h2").agg(F.min("vec_id").alias("query_id"))
    members = materialize(members.select("vec_id", "h1", "h2").join(chosen, ["h1", "h2"]).select("vec_id", "query_id"), "query-members")
    queries = keyed.join(chosen.select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "vector", *[f"key{c}" for c in range(curves)], F.size("vector").alias("width"))
    queries = materialize(queries, "queries")

    # Each query's place among the blocks of a curve: blocks are numbered in key order, and a query takes those whose
    # number is within ``window`` of its own.
    ranked = materialize(_numbered(blocks.select("curve", "width", "block", "low", "high")), "block-order")
    near = _union(_place(queries.select("query_id", "width", F.col(f"key{c}").alias("key")), ranked.where(F.col("curve") == c), c, window) for c in range(curves))
    near = materialize(near.distinct(), "windows")
    unbounded = queries.select("query_id", "vector", F.lit(None).cast("double").alias("bound"))
    best = materialize(_ranked(_search(near.join(unbounded, "query_id"), blocks, k + 1), k + 1), "window-search")
    if exact:
        # Blocks of the first curve that may hold something nearer than the (k + 1)-th so far.
        bounds = queries.join(best.where(F.col("rank") == k + 1).select("query_id", F.col("score").alias("bound")), "query_id", "left").select("query_id", "vector", "width", "bound")
        visits = _visits(bounds, blocks.where("curve = 0").select("block", "width", "centre", "radius"))
        rest = visits.join(near.where("curve = 0").select("query_id", "block"), ["query_id", "block"], "left_anti").join(bounds.select("query_id", "vector", "bound"), "query_id")
        more = _search(rest.select(F.lit(0).alias("curve"), "block", "query_id", "vector", "bound"), blocks.where("curve = 0"), k + 1)
        best = _ranked(best.select("query_id", "vec_id", "score").unionByName(more), k + 1)
    found = members.select(F.col("vec_id").alias("member"), "query_id").join(best.select("query_id", "vec_id", "score"), "query_id").where("member <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.select(F.col("member").alias("query_id"), "vec_id", "score").withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _union(frames) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _numbered(borders: DataFrame) -> DataFrame:
    """Blocks of each curve and width with their number in key order. Range partitions are in key order and blocks in
    order within them, so the block id orders them."""
    part = F.shiftright("block", 32)
    sizes = borders.groupBy("curve", "width", part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.expr("a.curve = b.curve and a.width = b.width and b.part < a.part"), "left").groupBy("a.curve", "a.width", "a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    within = borders.withColumn("part", part).withColumn("at", F.expr("row_number() over (partition by curve, width, part order by block)"))
    return within.join(before, ["curve", "width", "part"]).select("curve", "width", "block", "low", "high", (F.col("before") + F.col("at")).alias("number"))


def _place(queries: DataFrame, ranked: DataFrame, curve: int, window: int) -> DataFrame:
    """(curve, block, query_id) of the blocks around each query's key: the last block that begins at or before the key
    and those within ``window`` of it. The starts and the keys are merged in order, part by part."""
    starts = ranked.select("width", F.col("low").alias("key"), "number", F.lit(None).cast("long").alias("query_id"))
    asked = queries.select("width", "key", F.lit(None).cast("long").alias("number"), "query_id")
    parts = F.shiftright("key", 40)
    merged = starts.unionByName(asked).withColumn("part", parts)
    # The last start before each part comes from the parts' own maxima.
    last = merged.groupBy("width", "part").agg(F.max("number").alias("top"))
    before = last.withColumn("before", F.max("top").over(Window.partitionBy("width").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    here = F.last("number", ignorenulls=True).over(Window.partitionBy("width", "part").orderBy("key", F.col("query_id").isNotNull(), "number"))
    own = merged.withColumn("here", here).where("query_id is not null").join(before.select("width", "part", "before"), ["width", "part"])
    own = own.withColumn("at", F.coalesce("here", "before", F.lit(1)))
    near = own.select("query_id", "width", F.explode(F.sequence(F.col("at") - window, F.col("at") + window)).alias("number"))
    return near.join(ranked, ["width", "number"]).select(F.lit(curve).alias("curve"), "block", "query_id")


def _visits(bounds: DataFrame, blocks: DataFrame, pack_rows: int = 512) -> DataFrame:
    """(query_id, block) where a block may hold a vector nearer than the query's bound: the least angle between the
    query and the block's cone is the angle to its centre less its radius. Queries and block centres meet in packs, a
    stated query set against all blocks."""
    groups = max(1, -(-blocks.count() // pack_rows))
    packs = max(1, -(-bounds.count() // pack_rows))
    q_packs = bounds.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(packs))).groupBy("width", "pack").agg(F.collect_list(F.struct("query_id", "vector", "bound")).alias("queries"))
    q_packs = q_packs.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    b_packs = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("width", "group").agg(F.collect_list(F.struct("block", "centre", "radius")).alias("blocks"))

    def open_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                vectors = np.array([q["vector"] for q in row.queries], np.float64)
                bound = np.array([-2.0 if q["bound"] is None else q["bound"] for q in row.queries])
                centres = np.array([b["centre"] for b in row.blocks], np.float64)
                radius = np.array([b["radius"] for b in row.blocks])
                angle = np.arccos(np.clip(_unit(vectors) @ centres.T, -1, 1)) - radius - _MARGIN
                q, b = np.nonzero(np.cos(np.clip(angle, 0, np.pi)) >= bound[:, None])
                ids, names = np.array([x["query_id"] for x in row.queries]), np.array([x["block"] for x in row.blocks])
                yield pd.DataFrame({"query_id": ids[q], "block": names[b]})

    return q_packs.join(b_packs, ["width", "group"]).select("queries", "blocks").mapInPandas(open_blocks, "query_id long, block long")


def op10_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
