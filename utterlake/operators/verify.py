"""Verification: trials, cosine scores, detection-error curves and their summaries."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import numbered, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays. The length is bound to a variable, as a lambda computes what it
    names anew for every element."""
    whole = lambda size: F.transform(v, lambda x: x / F.when(size > 0, size).otherwise(F.lit(1.0)))
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), whole), 1)


def order_key(seed: int, *columns: str) -> Column:
    """A fixed-seed order that any engine can repeat."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def trial_pairs(items: DataFrame, n_pairs: int, seed: int = 0, bucket_rows: int = 4096) -> DataFrame:
    """a, b, same: as many pairs of one speaker as of two, each unordered pair once, none with itself.

    ``n_pairs // 2`` pairs of each kind, fewer if there are not so many of the same speaker or of two. All pairs are
    never made: within a speaker an item meets the items at the next places of a hashed order, and an impostor candidate
    is the item at such a place in the hashed order of its bucket of about ``bucket_rows``. The number of places starts
    at what the quota needs on average and doubles until the quota is met or the largest group has no further place.
    Fewer than two speakers is an error.
    """
    if items.select("speaker").distinct().limit(2).count() < 2:
        raise ValueError("trials need at least two speakers")
    half, total = n_pairs // 2, items.count()
    buckets = max(1, total // bucket_rows)
    hashed = items.select("id", "speaker", order_key(seed, "id").alias("h")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets)))

    def ahead(by: str, partners: int) -> DataFrame:
        w = Window.partitionBy(by).orderBy("h")
        rows = hashed.withColumn("others", F.collect_list(F.struct("id", "speaker")).over(w.rowsBetween(1, partners)))
        pairs = rows.select("id", "speaker", F.explode("others").alias("o"))
        return pairs.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b"), (F.col("speaker") == F.col("o.speaker")).cast("long").alias("same")).distinct()

    def enough(by: str, rule: str, wanted: int) -> DataFrame:
        largest = hashed.groupBy(by).count().agg(F.max("count")).first()[0]
        partners = max(1, -(-2 * wanted // total))
        while True:
            found = ahead(by, partners).where(rule)
            if partners >= largest - 1 or found.limit(wanted).count() >= wanted:
                return found
            partners *= 2

    first = lambda df, n: df.withColumn("__h", order_key(seed, "a", "b")).orderBy("__h").limit(n).drop("__h")
    targets = first(enough("speaker", "same = 1 and a <> b", half), half)
    n = targets.count()
    others = first(enough("bucket", "same = 0", n), n)
    return (targets if others.count() >= n else first(targets, others.count())).unionByName(others)


def all_pairs(items: DataFrame, tile: int = 256, together: int = 8, most: int = 8192) -> DataFrame:
    """Every unordered pair: a, b, same. The rows are as many as the pairs, n (n - 1) / 2.

    Items are numbered by id and cut into tiles, and the items of ``together`` tiles meet the tile of their partners key by
    key, so a partner's ids follow each other in the same order again and again, which files hold in little room, the less
    the smaller a tile; what is shuffled is an item a tile, from tasks of some two million. A task that makes pairs has some four
    million, or more where ``most`` tasks are too few for that."""
    ranked = numbered(items.where("id is not null").select("id", "speaker"), ["id"], "k").withColumn("tile", F.floor(F.col("k") / tile))
    last = ranked.agg(F.coalesce(F.max("tile"), F.lit(0))).first()[0]
    keys = sum(t // together + 1 for t in range(last + 1))
    cores = items.sparkSession.sparkContext.defaultParallelism
    tasks = min(keys, most, max(8 * cores, (last * tile) ** 2 >> 23))
    ranked = ranked.repartition(max(cores, (last + 1) ** 2 * tile >> 22), "id")
    x = ranked.withColumn("group", F.floor(F.col("tile") / together)).withColumn("of", F.explode(F.sequence("tile", F.lit(last))))
    y = ranked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("tile") / together)))).withColumn("of", F.col("tile"))
    x, y = (z.repartition(tasks, "of", "group").sortWithinPartitions("of", "group", "id").alias(name) for z, name in ((x, "x"), (y, "y")))
    pairs = x.join(y.hint("merge"), F.expr("x.of = y.of and x.group = y.group and x.id < y.id"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr("cast(x.speaker = y.speaker as long)").alias("same"))


def score_trials(trials: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds score: the dot product of the two unit vectors."""
    left = vectors.select(F.col("id").alias("a"), unit(F.col("v")).alias("va"))
    right = vectors.select(F.col("id").alias("b"), unit(F.col("v")).alias("vb"))
    return trials.join(left, "a").join(right, "b").select("a", "b", "same", dot(F.col("va"), F.col("vb")).alias("score"))


def _pair_blocks(items: DataFrame, tasks: int, blocks: int, own: Column) -> DataFrame:
    """part, pair, low, high, side, id, speaker, v: vectors dealt into the ``blocks`` that ``own`` numbers, and each block sent to
    all pairs of blocks that it is in. A pair is whole in one partition, where its first block (side 0) comes before its second."""
    rows = items.where("id is not null").select("id", "speaker", unit(F.col("v")).alias("v"), own.alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    pair = F.floor(low * blocks - low * (low - 1) / 2 + high - low)
    rows = rows.select(F.pmod(pair, F.lit(tasks)).cast("int").alias("part"), pair.alias("pair"), low.alias("low"), high.alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "speaker", "v")
    return rows.repartitionById(tasks, "part").sortWithinPartitions("pair", "side")


class _Block:
    """The vectors of a block as a matrix, short ones filled up with zeros, in order of id."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("id")
        v = rows["v"].combine_chunks()
        self.ids, self.speakers, flat = rows["id"].to_numpy(), rows["speaker"].to_pandas(), v.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        self.sizes = v.value_lengths().fill_null(-1).to_numpy()
        edges = np.concatenate([[0], np.cumsum(np.maximum(self.sizes, 0))])
        lacks = np.diff(np.concatenate([[0], np.cumsum(~known)])[edges]) > 0
        self.data = np.zeros((len(self.ids), max(int(self.sizes.max(initial=0)), 0)))
        self.data[np.arange(self.data.shape[1]) < self.sizes[:, None]] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        self.sizes = np.where(lacks, -1, self.sizes)  # a vector that is null or holds one has no scores


def _half_up(score: float, digits: int) -> int:
    return int(Decimal(repr(score)).scaleb(digits).to_integral_value(ROUND_HALF_UP))


def _score_tiles(batches: Iterator[pa.RecordBatch], digits: int, rows: int = 1024, columns: int = 2048) -> Iterator[tuple]:
    """Tiles of all pairs of the blocks that ``_pair_blocks`` sends: both ids, the rounded score in units of its last digit
    (4 * 10 ** digits: not a number, one more: null), same (2: null), and which pairs count. Scores near half a unit are
    summed again element by element, as ``dot`` does, so that all round as single ones do."""
    unit_, odd = 10**digits, 4 * 10**digits

    def pairs() -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch["pair"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if held and end > start and held[-1]["pair"][0].as_py() != numbers[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                if end > start:
                    held.append(batch.slice(start, end - start))
        if held:
            yield pa.Table.from_batches(held)

    for table in pairs():
        second = table["side"].to_numpy() == 1
        own = table["low"][0] == table["high"][0]
        if not own and second.all() or not own and not second.any():
            continue  # the other block has no vectors
        x = _Block(table.filter(pa.array(~second)))
        y = x if own else _Block(table.filter(pa.array(second)))
        labels = pd.factorize(pd.concat([x.speakers, y.speakers], ignore_index=True))[0]
        lx, ly = labels[: len(x.ids)], labels[len(x.ids) :]
        width = max(x.data.shape[1], y.data.shape[1])
        u, w = (np.pad(z.data, ((0, 0), (0, width - z.data.shape[1]))) for z in (x, y))
        across = [(j, b := slice(j, j + columns), y.ids[b]) for j in range(0, len(w), columns)]
        for i in range(0, len(u), rows):
            a = slice(i, i + rows)
            for j, b, ids in across:
                if own and y.ids[b][-1] <= x.ids[a][0]:
                    continue
                scaled = (u[a] @ w[b].T) * unit_
                codes = np.rint(scaled)
                scaled -= codes
                np.abs(scaled, out=scaled)
                near = np.flatnonzero(scaled > 0.5 - 1e-6)
                codes[np.isnan(codes)] = odd
                codes = codes.astype(np.int64)
                if len(near):
                    r, c = np.divmod(near, codes.shape[1])
                    score = np.zeros(len(near))
                    for k in range(width):
                        score += u[i + r, k] * w[j + c, k]
                    codes[r, c] = [_half_up(s, digits) for s in score.tolist()]
                sx, sy = x.sizes[a], y.sizes[b]
                if (sx[0] < 0) or (sx != sx[0]).any() or (sy != sx[0]).any():
                    codes[(sx[:, None] != sy) | (sx[:, None] < 0)] = odd + 1
                same = (lx[a, None] == ly[b]).view(np.int8)
                if labels.min() < 0:
                    same[(lx[a, None] < 0) | (ly[b] < 0)] = 2
                yield x.ids[a], ids, codes, same, (x.ids[a][:, None] < ids) if own else None


def _checked(digits: int) -> int:
    if not 0 <= digits <= 6:
        raise ValueError("scores are rounded to 0 to 6 digits")
    return 10**digits


def all_pair_scores(items: DataFrame, digits: int = 6, block: int = 8192, tile: int = 1 << 24) -> DataFrame:
    """a, b, same, score of every unordered pair of items (id, speaker, v) of different ids, a < b; the score rounded to
    ``digits``. Vectors meet in blocks, whose scores are products of matrices, so no pair carries its vectors. A block has
    about ``block`` ids that follow each other, and a task two blocks.

    The rows are as many as the pairs, so what they take in files counts: about ``tile`` of them at a time come in order of
    score, as a score that is repeated takes little room, and a few thousand ids take 12 bits or so each."""
    unit_, total = _checked(digits), items.count()
    blocks = max(1, -(-total // block), min(total // 2048, int(2 * items.sparkSession.sparkContext.defaultParallelism**0.5)))
    edges = items.approxQuantile("id", [k / blocks for k in range(1, blocks)], 1 / (64 * blocks)) if blocks > 1 else []
    own = reduce(lambda before, edge: before + (F.col("id").cast("double") > edge).cast("int"), edges, F.lit(0))

    def rows(found: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        found.sort()
        for start in range(0, len(found), 1 << 17):
            key = found[start : start + (1 << 17)]
            code, kind = (key >> 40) - 2 * unit_, (key >> 38) & 3
            score, odd = code / unit_, code[-1] >= 4 * unit_  # in order, so the last one tells
            if odd:
                score[code == 4 * unit_] = np.nan
            yield pa.RecordBatch.from_arrays([pa.array(p[(key >> 20) & 0x3FFFF]), pa.array(q[key & 0xFFFFF]), pa.array(kind, mask=kind == 2), pa.array(score, mask=code == 4 * unit_ + 1 if odd else None)], ["a", "b", "same", "score"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, p, q = np.empty(0, np.int64), 0, np.empty(0, np.int64), None  # keys: 23 bits of score, 2 of same, 18 and 20 for the places in p and q
        for x, y, codes, same, counted in _score_tiles(batches, digits, 64, 1 << 15):
            if n and (y is not q or n + codes.size > len(keys) or len(p) + len(x) > 1 << 18):
                yield from rows(keys[:n], p, q)
                n, p = 0, p[:0]
            codes <<= 2
            codes += same
            codes <<= 38
            codes += (np.arange(len(p), len(p) + len(x)) << 20)[:, None] + (2 * unit_ << 40)
            codes += np.arange(len(y))
            if codes.size > len(keys):
                keys = np.empty(max(tile, codes.size), np.int64)
            new = codes.ravel() if counted is None else codes[counted]
            keys[n : n + len(new)] = new
            n, p, q = n + len(new), np.concatenate([p, x]), y
        if n:
            yield from rows(keys[:n], p, q)

    return _pair_blocks(items, blocks * (blocks + 1) // 2, blocks, own).mapInArrow(find, "a long, b long, same long, score double")


def all_pair_counts(items: DataFrame, digits: int = 6) -> DataFrame:
    """same, score, n: how many of ``all_pair_scores`` are alike, a table. A task adds up its pairs by rounded score and
    hands on one row a different one, so rows are bounded by ``digits``, however many pairs there are."""
    unit_, total = _checked(digits), items.count()
    tasks = min(64, max(items.sparkSession.sparkContext.defaultParallelism, total**2 >> 25))
    blocks = max(1, -(-total // 16_384), min(total // 64, int(2 * tasks**0.5)))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 * (6 * unit_ + 2), np.int64)  # scores of unit vectors lie within -2 and 2, however small they were
        for _, _, codes, same, counted in _score_tiles(batches, digits):
            codes += 2 * unit_
            codes *= 3
            codes += same
            at = (codes if counted is None else codes[counted]).ravel()
            if len(at):
                low = int(at.min())
                found = np.bincount(at - low)
                counts[low : low + len(found)] += found
        filled = np.flatnonzero(counts)
        for start in range(0, len(filled), 100_000):
            at = filled[start : start + 100_000]
            code, kind = at // 3 - 2 * unit_, at % 3
            score = np.where(code == 4 * unit_, np.nan, code / unit_)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64(), mask=kind == 2), pa.array(score, mask=code == 4 * unit_ + 1), pa.array(counts[at])], ["same", "score", "n"])

    found = _pair_blocks(items, tasks, blocks, own).mapInArrow(find, "same long, score double, n long")
    return written(found.groupBy("same", "score").agg(F.sum("n").alias("n")), "pair-counts")


def det_curve(scored: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """threshold, frr, far at every different score and one above all (score + 1): targets below the threshold are
    rejected, others at or above it accepted. Counts are combined by score before the cumulative window; use
    ``det_curve_ranged`` where the different scores do not fit one task."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    counts = scored.groupBy(*by, F.col("score").alias("threshold")).agg(F.sum(F.col("same") * w).alias("t"), F.sum((1 - F.col("same")) * w).alias("n"))
    last = counts.groupBy(*by).agg((F.max("threshold") + 1).alias("threshold")).withColumns({"t": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    points = counts.unionByName(last)
    order = Window.partitionBy(*by).orderBy("threshold")
    everything = Window.partitionBy(*by)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    return points.select(*by, "threshold", (F.coalesce(F.sum("t").over(below), F.lit(0)) / F.sum("t").over(everything)).alias("frr"), (1 - F.coalesce(F.sum("n").over(below), F.lit(0)) / F.sum("n").over(everything)).alias("far"))


def det_curve_ranged(scored: DataFrame, partitions: int = 64, weight: str | None = None) -> DataFrame:
    """The same curve by two-level sums: scores are range-partitioned, each range sums on its own, and the ranges'
    totals, one row a partition, are added up and sent back."""
    w = F.col(weight) if weight else F.lit(1)
    counts = scored.groupBy(F.col("score").alias("threshold")).agg(F.sum(F.col("same") * w).alias("t"), F.sum((1 - F.col("same")) * w).alias("n"))
    return curve_of_counts(written(counts, "score-counts"), partitions)


def curve_of_counts(counts: DataFrame, partitions: int = 64) -> DataFrame:
    """The curve of counts (threshold, t, n), a table: it is read more than once."""
    last = counts.agg((F.max("threshold") + 1).alias("threshold")).withColumns({"t": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    edges = counts.approxQuantile("threshold", [k / partitions for k in range(1, partitions)], 0.01)
    part = reduce(lambda acc, e: acc + (F.col("threshold") > e).cast("int"), sorted(set(edges)), F.lit(0))
    points = counts.unionByName(last).withColumn("part", part)
    totals = points.groupBy("part").agg(F.sum("t").alias("pt"), F.sum("n").alias("pn"))
    w = Window.orderBy("part")
    totals = totals.select("part", F.coalesce(F.sum("pt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("t0"), F.coalesce(F.sum("pn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"), F.sum("pt").over(Window.partitionBy()).alias("tt"), F.sum("pn").over(Window.partitionBy()).alias("nn"))
    inside = Window.partitionBy("part").orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    rows = points.withColumns({"tb": F.coalesce(F.sum("t").over(inside), F.lit(0)), "nb": F.coalesce(F.sum("n").over(inside), F.lit(0))}).join(totals, "part")
    return rows.select("threshold", ((F.col("t0") + F.col("tb")) / F.col("tt")).alias("frr"), (1 - (F.col("n0") + F.col("nb")) / F.col("nn")).alias("far"))


def eer(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """eer and threshold: the first threshold at which the two rates differ least, and their mean there."""
    gap = F.round(F.abs(F.col("far") - F.col("frr")), 12)
    return curve.groupBy(*(by or [])).agg(F.min_by(F.struct(((F.col("far") + F.col("frr")) / 2).alias("eer"), "threshold"), F.struct(gap, F.col("threshold"))).alias("e")).select(*(by or []), "e.eer", "e.threshold")


def min_dcf(curve: DataFrame, p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0) -> DataFrame:
    cost = c_miss * p_target * F.col("frr") + c_fa * (1 - p_target) * F.col("far")
    return curve.agg((F.min(cost) / min(c_miss * p_target, c_fa * (1 - p_target))).alias("min_dcf"))


def trial_summary(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """eer, threshold, min_dcf, mean_same, mean_different, separation in one row. Trials are scored once, into counts by
    score; the curve is made by ranges of scores."""
    t, w = F.col("same"), F.col(weight) if weight else F.lit(1)
    counts = written(scored.groupBy("score").agg(F.sum(t * w).alias("t"), F.sum((1 - t) * w).alias("n")), "score-counts")
    curve = curve_of_counts(counts.withColumnRenamed("score", "threshold"))
    found = eer(curve).crossJoin(min_dcf(curve))  # one row each
    mean = lambda n: F.sum(F.col("score") * F.col(n)) / F.sum(n)
    means = counts.agg(mean("t").alias("mean_same"), mean("n").alias("mean_different"))
    return found.crossJoin(means).withColumn("separation", F.col("mean_same") - F.col("mean_different"))


def bootstrap_eer(scored: DataFrame, replicates: int = 500, level: float = 0.95, seed: int = 0, bins: int = 8192, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """low, high: quantiles of the EER over resampled trials; replicates without both classes are left out.

    Trials are counted once, by class and by ``bins`` equal bins of [low, high], which is all that leaves the executors; a
    replicate draws counts instead of trials, so it costs the number of bins whatever the number of trials. An EER is off
    by the trials of one bin at most."""
    place = F.least(F.greatest(F.floor((F.col("score") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy(place.alias("bin"), "same").agg(F.count("*").alias("n")).toPandas()
    cells = np.zeros(2 * bins)
    cells[counts["bin"] + bins * (counts["same"] == 1)] = counts["n"]
    total = int(cells.sum())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for rep in batch["id"].tolist():
                drawn = np.random.default_rng([seed, rep]).multinomial(total, cells / max(total, 1))
                n, t = drawn[:bins], drawn[bins:]
                if n.any() and t.any():
                    frr = np.append(0, np.cumsum(t)) / t.sum()
                    far = 1 - np.append(0, np.cumsum(n)) / n.sum()
                    at = int(np.argmin(np.round(np.abs(far - frr), 12)))
                    found.append((far[at] + frr[at]) / 2)
            yield pd.DataFrame({"eer": found}, dtype=float)

    found = scored.sparkSession.range(replicates).mapInPandas(draw, "eer double")
    return found.agg(F.percentile("eer", F.lit((1 - level) / 2)).alias("low"), F.percentile("eer", F.lit((1 + level) / 2)).alias("high"))


def feature_stats(rows: DataFrame, kind: str = "set") -> DataFrame:
    """band, mean, std of (band, x [, valid]): ``set``: sample deviation, at least 1e-3; ``cmvn``: sample deviation +
    1e-5; ``masked``: population deviation of valid rows, variance at least 1e-8."""
    if kind == "masked":
        rows = rows.where("valid")
    std = {"set": F.greatest(F.stddev_samp("x"), F.lit(1e-3)), "cmvn": F.stddev_samp("x") + 1e-5, "masked": F.sqrt(F.greatest(F.var_pop("x"), F.lit(1e-8)))}[kind]
    return rows.groupBy("band").agg(F.avg("x").alias("mean"), std.alias("std"))


def stats_embedding(rows: DataFrame) -> DataFrame:
    """key, v: each key's band means, then band sample deviations, to unit length; rows have key, band, x."""
    s = rows.groupBy("key", "band").agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    ordered = s.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("band", "m", "s"))).alias("l"))
    return ordered.select("key", unit(F.concat(F.transform("l", lambda x: x["m"]), F.transform("l", lambda x: x["s"]))).alias("v"))


def center_embeddings(vectors: DataFrame) -> DataFrame:
    """id, v: vectors less the mean vector, to unit length again."""
    parts = vectors.select("id", F.posexplode("v").alias("i", "x"))
    means = parts.groupBy("i").agg(F.avg("x").alias("m"))
    moved = parts.join(means, "i").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("x") - F.col("m")).alias("x")))).alias("l"))
    return moved.select("id", unit(F.transform("l", lambda x: x["x"])).alias("v"))


def pca_project(vectors: DataFrame, k: int = 2) -> DataFrame:
    """id and the first k principal components of the centred vectors; the sign of each is arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector("v").alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="c").fit(rows).transform(rows)
    return PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred).select("id", vector_to_array("p").alias("p"))
