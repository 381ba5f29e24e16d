"""Near-dedup by order MinHash with verification by banded alignment.

k-mers are runs of five words (A-Z lower-cased), each labelled with how often it came before in its document. For each
of ``tables`` seeds a document takes its ``keep`` smallest labelled k-mers; every two of them, in text order, are a
sketch. Documents agree on a sketch about as likely as an optimal alignment keeps both k-mers, so sketches follow edit
similarity. Two documents are linked if the edit similarity of their word sequences, 1 - distance / longer length, is at
least ``threshold``; the distance comes from an alignment within the band that the threshold allows.

Documents of equal word sequences are one class at once. For the others every bucket of equal sketches chooses its
smallest document as pivot by a map-side combined minimum and each member is aligned with its pivot. Classes are the
connected components of all links. Where a bucket's members are still of different classes, those outside its largest
class are aligned with all others; they are few, as the largest class of a bucket of copies holds nearly all. A bucket
with very many outside comes of a passage that many unlike documents share. The members of all such buckets meet each
other in blocks: within a task lengths, parities and counts of words rule out the pairs that cannot be near enough, and
only the others become rows and are aligned. So no pair that shares a sketch is left out, no bucket is one task, and
nothing about single documents goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import LOWER, SMALL_CHUNK, WORD, discard, materialize, mix64, prefix_sums, release, span_hashes, token_spans, utf8_chunks

_MAX = np.uint64(2**64 - 1)


def _doc_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each document's words begin (one entry more)."""
    data = LOWER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts, ends = token_spans(data, WORD)
    marks = np.flatnonzero(cut[:-1])
    inside = marks[np.searchsorted(starts, marks, "left") > np.searchsorted(ends, marks, "right")]
    if len(inside):  # words do not cross documents
        starts, ends = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))
    return span_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words; of fewer words, but not none, one run of all of them."""
    if len(words) == 0:
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    h = np.full(n, 0x8445D61A4E774912, np.uint64)
    for i in range(width):
        h = mix64(h ^ words[i : i + n]) + np.uint64(i)
    return h


def labelled(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with the number of its earlier occurrences."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    head = np.ones(len(kmers), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(kmers))
    occurrence = np.empty(len(kmers), np.int64)
    occurrence[order] = at - np.maximum.accumulate(np.where(head, at, 0))
    return mix64(kmers + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(words: np.ndarray, tables: int = 24, keep: int = 3, k: int = 5) -> np.ndarray:
    """Hashes of the pairs, in text order, of the ``keep`` smallest labelled k-mers of each table: keep * (keep - 1) / 2
    a table, so that documents that agree on two of the smallest still meet. A document of one k-mer has that alone."""
    kmers = labelled(shingles(words, k))
    keep = min(keep, len(kmers))
    seeds = mix64(np.arange(1, tables + 1, dtype=np.uint64))
    out = []
    step = max(1, (1 << 18) // max(len(kmers), 1))  # tables at a time, so that long documents need no more memory
    for first in range(0, tables, step):
        own = seeds[first : first + step]
        ranks = (kmers[None, :] ^ own[:, None]) * np.uint64(0x9FB21C651E98DF25)
        ranks ^= ranks >> np.uint64(29)
        ranks *= np.uint64(0xD6E8FEB86659FD93)
        row, least = np.arange(len(own)), np.empty((len(own), keep), np.int64)
        for j in range(keep):
            least[:, j] = ranks.argmin(1)
            ranks[row, least[:, j]] = _MAX
        least.sort(1)
        if keep == 1:
            out.append(mix64(own ^ kmers[least[:, 0]]))
        for i in range(keep):
            for j in range(i + 1, keep):
                out.append(mix64(mix64(own ^ kmers[least[:, i]]) + kmers[least[:, j]]))
    return np.concatenate(out)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two multisets."""
    both = np.concatenate([a, b])
    values, inverse = np.unique(both, return_inverse=True)
    return int(np.minimum(np.bincount(inverse[: len(a)], minlength=len(values)), np.bincount(inverse[len(a) :], minlength=len(values))).sum())


def rough_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A cheaper lower bound: counts of words by 9 bits of their codes, of which an edit changes two by one at most."""
    counts = np.bincount(a & 511, minlength=512) - np.bincount(b & 511, minlength=512)
    return max(abs(len(a) - len(b)), (int(np.abs(counts).sum()) + 1) // 2)


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: an edit takes at most one word and two word pairs from what is shared."""
    n = max(len(a), len(b))
    words = n - _shared(a, b)
    if min(len(a), len(b)) < 2:
        return words
    u, v = a.astype(np.uint64), b.astype(np.uint64)
    pairs = n - 1 - _shared((u[:-1] << np.uint64(32)) | u[1:], (v[:-1] << np.uint64(32)) | v[1:])
    return max(words, -(-pairs // 2))


def edit_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The edit distance of two sequences if it is at most ``band``, else ``band + 1``.

    Equal ends are cut first; then the alignment runs over the diagonals -band to band only, all of a column at once.
    """
    if abs(len(a) - len(b)) > band:
        return band + 1
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return min(max(len(a), len(b)), band + 1)
    # Column by column of the alignment, the band's vertical steps (+1, -1) and zero diagonals are the bits of integers:
    # bit k of column j stands for row j - band + k, so the bits move down by one from column to column.
    m, band = len(a), min(band, max(len(a), len(b)))
    width = 2 * band + 1
    mask, places = (1 << width) - 1, {}
    for i, code in enumerate(a.tolist()):
        places[code] = places.get(code, 0) | (1 << i)
    up, down = mask ^ ((1 << band) - 1), 0
    distance, spare = min(band, m), len(b) - m + band
    for j, code in enumerate(b.tolist(), 1):
        equal = places.get(code, 0)
        equal = (equal >> (j - band - 1) if j > band else equal << (band + 1 - j)) & mask
        zero = ((((equal & up) + up) ^ up) | equal | down) & mask
        right, left = down | (mask ^ (zero | up)), zero & up
        if j <= m - band:  # along the band's lower edge to the last row, then along that row
            distance += not zero >> (width - 1)
            if distance > band + spare:  # what is left of the last row cannot make up for it
                return band + 1
        else:
            k = m - j + band
            distance += (right >> k & 1) - (left >> k & 1)
        zero >>= 1
        up, down = left | (mask ^ (zero | right)), zero & right
    return min(distance, band + 1)


def allowed(n: int, m: int, threshold: float) -> int:
    """The largest distance at which lengths n and m are similar enough."""
    return int(np.floor((1 - threshold) * max(n, m) + 1e-9))


#: Bits of the parities that bound the distance of two texts.
_PARITIES = 256


def parities(codes: np.ndarray) -> np.ndarray:
    """Whether each of ``_PARITIES`` bins, by the lowest bits of the codes, holds an odd number of words, as the bits of
    64-bit integers. An edit changes two of them at most, so texts that differ in h bits are at least h / 2 edits apart."""
    return np.packbits((np.bincount(codes & (_PARITIES - 1), minlength=_PARITIES) & 1).astype(np.uint8)).view(np.int64)


def may_link(n, m, bits, other, threshold: float):
    """Whether two texts of n and m words and these parities can be near enough: false only where they cannot."""
    differ = sum((F.bit_count(bits[i].bitwiseXOR(other[i])) for i in range(_PARITIES // 64)), F.lit(0))
    most = F.floor((1 - threshold) * F.greatest(n, m) + 1e-9)
    return (F.abs(n - m) <= most) & (differ <= 2 * most)


def word_rows(docs: DataFrame, tables: int, keep: int, k: int) -> DataFrame:
    """For each row: doc_id, the hash pair of its word sequence, the word hashes as 4-byte integers, their parities, the
    sketches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for first, data, offsets in utf8_chunks(batch["text"], SMALL_CHUNK):
                h1, h2, codes, bits, sketch = [], [], [], [], []
                words, edges = _doc_words(data, offsets)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    own = words[a:b]
                    digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                    h1.append(int(digest[0]))
                    h2.append(int(digest[1]))
                    short = (own >> np.uint64(32)).astype("<u4")
                    codes.append(short.tobytes())
                    bits.append(parities(short))
                    sketch.append(sketches(own, tables, keep, k).astype(np.int64) if len(own) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(h1)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(codes, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "codes", "bits", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, h1 long, h2 long, codes binary, bits array<long>, sketch array<long>")


def _aligned(pairs: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b) whose lengths and parities allow a link, with the allowed distance and their distance, or a lower bound of it
    where it is not allowed."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance, limit = [], []
            for x, y in zip(batch["codes_a"], batch["codes_b"], strict=True):
                u, v = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                limit.append(allowed(len(u), len(v), threshold))
                bound = rough_distance(u, v)
                bound = bound if bound > limit[-1] else max(bound, least_distance(u, v))
                distance.append(bound if bound > limit[-1] else max(bound, edit_distance(u, v, limit[-1])))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(distance, pa.int32()), pa.array(limit, pa.int32())], ["a", "b", "distance", "allowed"])

    left = codes.select(F.col("rep").alias("a"), F.col("codes").alias("codes_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = codes.select(F.col("rep").alias("b"), F.col("codes").alias("codes_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    near = may_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), threshold)
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "codes_a", "codes_b").mapInArrow(align, "a long, b long, distance int, allowed int")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id connected with each id of ``links`` (a, b).

    First every id that is the larger one of a link hangs on the smallest id it is linked with; its other links become
    links between these, so only ids that are the smaller one of some link go on: a pivot of very many copies is one
    node with few links. Alternating large-star and small-star steps settle these, in rounds that grow with the logarithm of the
    longest path. The last join, by the id that others hang on, is salted.
    """
    spark = links.sparkSession
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    parents = materialize(edges.groupBy("u").agg(F.min("v").alias("p")), "parents")
    inner = edges.select(F.col("v").alias("u")).distinct()
    between = edges.join(parents, "u").where("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v"))
    upward = parents.join(inner, "u", "left_semi").select("u", F.col("p").alias("v"))
    core = materialize(between.union(upward).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    release(spark)
    signature = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now, steps = signature(core), [edges, parents, core]
    while now[0]:
        both = core.union(core.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        core, before = materialize(small, "links"), now
        steps.append(core)
        now = signature(core)
        if now == before:
            break
    # Salted: an id that a third of all others hang on is spread over many tasks.
    salts = 32
    tops = core.select("u", "v").union(inner.join(core, "u", "left_anti").select("u", F.col("u").alias("v")))
    tops = tops.select(F.col("u").alias("p"), F.col("v").alias("root"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    leaves = parents.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int")).join(tops, ["p", "salt"]).select(F.col("u").alias("id"), "root")
    inner_roots = tops.where("salt = 0 and p <> root").select(F.col("p").alias("id"), "root")
    found = materialize(leaves.union(inner_roots).groupBy("id").agg(F.min("root").alias("root")), "roots")
    discard(*steps)
    return found


def _bucket_pairs(live: DataFrame, roots: DataFrame, codes: DataFrame, limit: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For buckets (sig, rep) whose members are of different classes: the pairs to align next, the members (rep) of those
    with more than ``limit`` members outside their largest class, for ``_crowded_links``, and the table that both come from.

    In the other buckets members outside the largest class meet all members of other classes, so such a bucket costs no
    more than ``limit`` looks a member. The members outside come to each member as one row, of which it keeps the list of
    those that lengths and parities allow; the lists of a text are united before they become pairs. So the join has a row
    a member, and a pair is one row however many buckets the two share (at most ``limit`` times the sketches a text).
    """
    rows = live.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = rows.groupBy("sig", "root").agg(F.count("*").alias("n"))  # a class of a bucket is a row, not a member
    state = sizes.groupBy("sig").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1")
    state = state.select("sig", F.col("top.root").alias("largest"), (F.col("n") - F.col("top.n")).alias("outside"))
    mixed = materialize(rows.join(state, "sig"), "mixed-buckets")
    few = mixed.where(F.col("outside") <= limit).join(codes.select("rep", "n", "bits"), "rep")
    salts = 8  # the few members outside are copied, so that the many of a hot bucket need not be in one task
    outside = few.where("root <> largest").groupBy("sig").agg(F.collect_list(F.struct("rep", "root", "n", "bits")).alias("others"))
    outside = outside.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meets(x):
        once = (F.col("root") == F.col("largest")) | (x["rep"] < F.col("rep"))  # of two members outside, the larger one lists the other
        return (x["root"] != F.col("root")) & once & may_link(F.col("n"), x["n"], F.col("bits"), x["bits"], threshold)

    met = few.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")).join(outside, ["sig", "salt"])
    met = met.select("rep", F.transform(F.filter("others", meets), lambda x: x["rep"]).alias("others"))
    met = met.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    met = met.select("rep", F.explode("others").alias("x"))
    pairs = met.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
    return pairs, mixed.where(F.col("outside") > limit).select("rep").distinct(), mixed


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    most = allowed(len(a), len(b), threshold)
    return least_distance(a, b) <= most and edit_distance(a, b, most) <= most


#: Bins of the counts of words that bound the distance of two texts of crowded buckets.
_BINS = 512


def _near_enough(x: dict, y: dict, own: bool, threshold: float, rows: int = 256, columns: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (their places in x and y) of different classes that lengths, parities and counts of words allow to link,
    a tile at a time; with ``own``, x and y are the same block and each pair comes once."""
    for i in range(0, len(x["rep"]), rows):
        a = slice(i, i + rows)
        for j in range(i // columns * columns if own else 0, len(y["rep"]), columns):
            b = slice(j, j + columns)
            n, m = x["n"][a, None], y["n"][None, b]
            most = np.floor((1 - threshold) * np.maximum(n, m) + 1e-9).astype(np.int64)
            near = (np.abs(n - m) <= most) & (x["root"][a, None] != y["root"][None, b])
            if own:
                near &= np.arange(i, i + near.shape[0])[:, None] < np.arange(j, j + near.shape[1])
            differ = np.zeros(near.shape, np.int16)
            for k in range(_PARITIES // 64):
                differ += np.bitwise_count(x["bits"][a, None, k] ^ y["bits"][None, b, k])
            r, c = np.nonzero(near & (differ <= 2 * most))
            for at in range(0, len(r), 8192):
                u, w = r[at : at + 8192], c[at : at + 8192]
                apart = np.abs(x["counts"][i + u].astype(np.int16) - y["counts"][j + w]).sum(1, dtype=np.int64)
                fits = apart <= 2 * most[u, w]
                if fits.any():
                    yield i + u[fits], j + w[fits]


def _crowded_links(members: DataFrame, roots: DataFrame, codes: DataFrame, threshold: float, block: int = 16_384, words: int = 1 << 22) -> DataFrame:
    """All links (a, b) between ``members`` (rep) of different classes, a table.

    Texts that may be near enough are of the same or of the next band of lengths. A band is dealt into blocks of about
    ``block`` texts, of ``words`` words at most unless a single text has more, and each block goes to all blocks of its own
    and of the bands beside it. A task holds two blocks, aligns what the exact bounds allow and hands on links alone. The
    looks grow with the square of a band's members, the rows that are sent with the members times the number of blocks."""
    spark = members.sparkSession
    found = codes.select("rep", "n", "bits", "codes").join(members, "rep", "left_semi")
    found = found.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    base = min(max(1.0001 / max(threshold, 1e-3), 1.1), 1e3)  # a little wider than what the threshold allows, for rounding
    found = materialize(found.withColumn("band", F.floor(F.log("n") / float(np.log(base))).cast("int")), "crowded")
    sizes = found.groupBy("band").agg(F.count("*").alias("size"), F.max("n").alias("n")).orderBy("band").collect()  # few: bands of lengths
    block = min(block, max(512, sum(r["size"] for r in sizes) // 16))
    dealt = {r["band"]: -(-r["size"] // max(1, min(block, words // r["n"]))) for r in sizes}
    blocks = [(band, i) for band, n in dealt.items() for i in range(n)]
    met = [(x, y) for x in blocks for y in blocks if x <= y and (y[0] - x[0] <= 1 or threshold < 1e-3)]
    places = [(p, x == y, side, *z) for p, (x, y) in enumerate(met) for side, z in enumerate((x, y)[: 1 + (x != y)])]
    places = spark.createDataFrame(places, "pair int, own boolean, side int, band int, block int")
    counts = F.create_map(*[F.lit(z) for x in dealt.items() for z in x])
    rows = found.withColumn("block", F.pmod(F.xxhash64("rep"), counts[F.col("band")]).cast("int")).join(F.broadcast(places), ["band", "block"])
    rows = rows.select("pair", "own", "side", "rep", "root", "n", "bits", "codes").repartition(max(1, min(len(met), 512)), "pair").sortWithinPartitions("pair", "side")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch["pair"].to_numpy()
            for start, end in zip([0, *(edges := (np.flatnonzero(np.diff(numbers)) + 1).tolist())], [*edges, len(numbers)], strict=True):
                if held and end > start and held[-1]["pair"][0].as_py() != numbers[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                if end > start:
                    held.append(batch.slice(start, end - start))
        if held:
            yield pa.Table.from_batches(held)

    def side(table: pa.Table) -> dict:
        bits = table["bits"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
        codes = [np.frombuffer(x.as_py(), "<u4") for x in table["codes"]]
        counts = np.array([np.minimum(np.bincount(x & (_BINS - 1), minlength=_BINS), 255) for x in codes], np.uint8)
        return {c: table[c].to_numpy() for c in ("rep", "root", "n")} | {"bits": np.frombuffer(bits, np.uint64).reshape(-1, _PARITIES // 64), "counts": counts, "codes": codes}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            second, own = table["side"].to_numpy() == 1, table["own"][0].as_py()
            x = side(table.filter(pa.array(~second)))
            y = x if own else side(table.filter(pa.array(second)))
            for r, c in _near_enough(x, y, own, threshold):
                near = np.array([_alike(x["codes"][i], y["codes"][j], threshold) for i, j in zip(r.tolist(), c.tolist(), strict=True)])
                p, q = x["rep"][r[near]], y["rep"][c[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    links = materialize(rows.mapInArrow(meet, "a long, b long"), "crowded-links")
    discard(found)
    return links


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tables: int = 24, keep: int = 3, k: int = 5, limit: int = 64) -> DataFrame:
    """One row for each row of ``docs`` with a doc_id: doc_id, class_id (the smallest doc_id of its class).

    Any two documents that share a sketch are linked if they are alike: they are compared with the bucket's pivot, with each
    other while a bucket has no more than ``limit`` members outside its largest class, and in fuller buckets with all that
    exact bounds do not rule out. So recall is probabilistic by the sketches alone.

    NULL texts count as empty; documents without any word are one class. Rows that repeat a doc_id are one document; if
    their words differ, those of the smallest hash count. Rows whose doc_id is NULL are in no class and are left out.
    Of equal ranks within a sketch the earlier k-mer comes first, so equal texts always agree. Texts of any length are
    handled whole; other columns are not read. Empty tables give empty results.
    """
    spark = docs.sparkSession
    rows = materialize(word_rows(docs.where("doc_id is not null"), tables, keep, k), "words")
    main = rows.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("k")).select("doc_id", "k.h1", "k.h2")
    # Written first, so that the joins with it have exchanges of their own, which can be split at a text of many copies.
    reps = materialize(main.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "representatives")
    member = materialize(main.join(reps, ["h1", "h2"]).select("doc_id", "rep"), "members")
    own = reps.select("h1", "h2", F.col("rep").alias("doc_id"))
    buckets = rows.join(own, ["doc_id", "h1", "h2"], "left_semi").select(F.col("doc_id").alias("rep"), F.explode("sketch").alias("sig"))
    shared = buckets.groupBy("sig").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").drop("last")
    shared = materialize(shared, "shared-sketches")
    live = materialize(buckets.join(shared, "sig").select("sig", "rep", "pivot").distinct(), "bucketed")
    discard(shared)
    release(spark)
    # Only texts that share a bucket need their words again.
    wanted = own.join(live.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    codes = rows.join(wanted, ["doc_id", "h1", "h2"], "left_semi").select(F.col("doc_id").alias("rep"), (F.octet_length("codes") / 4).cast("long").alias("n"), "bits", "codes").dropDuplicates(["rep"])
    codes = materialize(codes, "codes")
    discard(rows, reps)
    release(spark)

    def aligned(pairs: DataFrame) -> DataFrame:
        found = materialize(_aligned(pairs, codes, threshold), "aligned")
        release(spark)
        return found

    linked = lambda found: found.where("distance <= allowed").select("a", "b")
    found = aligned(live.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    done, links = found.select("a", "b"), linked(found)
    roots = components(links)
    pairs, crowded, mixed = _bucket_pairs(live.select("sig", "rep"), roots, codes, limit, threshold)
    found = aligned(pairs.join(done, ["a", "b"], "left_anti"))
    links = links.union(linked(found))
    crowded = materialize(crowded, "crowded-members")
    if not found.isEmpty():
        roots = components(links)
    if not crowded.isEmpty():
        roots = components(links.union(_crowded_links(crowded, roots, codes, threshold)))
    discard(mixed)
    return member.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each near-duplicate class; rows without a doc_id stay, and
    of rows that repeat a kept doc_id all stay."""
    gone = near_duplicates(docs, **parameters).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
