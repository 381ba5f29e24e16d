"""Dedup of repeated byte strings by suffix order around anchors.

A position's longest previous factor is the longest string starting there that also starts earlier; its neighbours in
suffix order give it. Here every string of ``length`` bytes goes that starts anywhere else too, so neighbours on both
sides count, not only those of smaller positions, and a factor matters only up to ``length`` bytes.

To spread this over Spark, every window of ``length`` bytes is handled at its anchor: the position of the smallest hash
among the window's ``gram``-byte strings. Equal windows have equal anchors, so windows can repeat only where an anchor
does. Anchors are counted by their hashes alone, with a map-side combine; a second pass over the texts keeps the marks
of those that occur twice or more. Equal surroundings of an anchor are one kind and are counted, not collected: a
passage that a third of all documents share is one row. An anchor of one kind needs no comparison. The bytes of the
others are fetched once each kind and ordered: to the right of the anchor in suffix order, to the left in the order of
the reversed prefixes, both with the lengths of common prefixes taken from the bytes. A window that begins ``lead``
bytes before its anchor repeats if another kind agrees with it on ``lead`` bytes to the left and the rest to the right.
An anchor of very many kinds is dealt by the bytes that windows of some leads must share, so its kinds meet in many
smaller groups with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, gram_hashes, materialize, mix64, prefix_sums, release, span_hashes, utf8_chunks

_KEY = ["k1", "k2"]


# --- anchors ---------------------------------------------------------------------------------------------------


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values (van Herk: running minima of blocks from both ends)."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width + width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(sums: np.ndarray, start: int, end: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions (relative to ``start``) of the text [start, end) behind ``sums``, and their hashes. All
    positions that attain a window's minimum are anchors, so the choice depends on the window's bytes alone."""
    n = end - start - gram + 1
    if end - start < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(sums, start, n, gram)
    width = length - gram + 1
    least = _sliding_min(hashes, width)
    # best: the largest minimum of the windows over each position
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    best = ~_sliding_min(~padded, width)
    chosen = np.flatnonzero(best == hashes)
    return chosen, hashes[chosen]


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (NULL as '') and its 128-bit hash k1, k2."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def anchor_counts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, n: how often each anchor occurs, over all texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in utf8_chunks(batch["text"]):
                sums = prefix_sums(data)
                found = [anchors(sums, a, b, length, gram)[1] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return texts.select("text").mapInArrow(rows, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


#: ``place`` packs the anchor's position, the bytes of its surroundings before it, and their size.
_MARKS = "k1 long, k2 long, anchor long, c long, place long"


def anchor_marks(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """One row a text and anchor position; c is the hash of the surroundings, all bytes that the anchor's windows may
    reach, and of the anchor's place in them."""
    reach = length - gram

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for first, data, offsets in utf8_chunks(batch["text"]):
                sums = prefix_sums(data)
                found = [anchors(sums, a, b, length, gram) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                doc = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                at, hashes = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                low, high = np.maximum(at - reach, 0), np.minimum(at + length, np.diff(offsets)[doc])
                before, size = at - low, high - low
                c = mix64(span_hashes(sums, offsets[doc] + low, offsets[doc] + high) + (before * 1024 + 1).astype(np.uint64))
                place = (at << 24) | (before << 12) | size
                columns = [k1[first + doc], k2[first + doc], hashes.view(np.int64), c.view(np.int64), place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k1", "k2", "anchor", "c", "place"])

    return texts.select("k1", "k2", "text").mapInArrow(rows, _MARKS)


def _position(place):
    return F.shiftright(place, 24)


def _before(place):
    return F.shiftright(place, 12).bitwiseAND(4095)


def _size(place):
    return place.bitwiseAND(4095)


# --- windows around repeated anchors ---------------------------------------------------------------------------


def common_prefixes(rows: list[bytes], groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of their group and bytes, and how many bytes (at most ``depth``) each has in common with
    the row before it in this order; 0 with a row of another group."""
    order = np.array(sorted(range(len(rows)), key=lambda i: (groups[i], rows[i])), np.int64)
    sizes = np.array([len(x) for x in rows], np.int64)[order]
    table = np.frombuffer(b"".join(rows[i][:depth].ljust(depth, b"\0") for i in order.tolist()), np.uint8).reshape(len(rows), depth)
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(1), differ.argmax(1), depth)
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    common[groups[order][1:] != groups[order][:-1]] = 0
    return order, np.concatenate([[0], common])


def repeated_leads(groups: np.ndarray, before: np.ndarray, around: list[bytes], counts: np.ndarray, length: int, gram: int, leads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each kind of surroundings the largest and the smallest lead of a window that starts elsewhere too, in a kind
    of the same group or because its own counts more than once; -1 where there is none. ``leads``, by row: the first and
    the last to look at."""
    n, reach = len(around), length - gram
    left = [around[i][: before[i]][::-1] for i in range(n)]
    right = [around[i][before[i] :] for i in range(n)]
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    order_left, common_left = common_prefixes(left, groups, max(reach, 1))
    order_right, common_right = common_prefixes(right, groups, length)
    largest, smallest = np.full(n, -1), np.full(n, -1)
    class_left, class_right = np.empty(n, np.int64), np.empty(n, np.int64)
    bounds = leads if leads is not None else np.tile([0, reach], (n, 1))
    # Groups are cut by a common prefix of 0, which no depth accepts but that of a lead of 0; so groups come first.
    head_left = np.concatenate([[True], groups[order_left][1:] != groups[order_left][:-1]])
    for lead in range(int(bounds[:, 0].min()), int(bounds[:, 1].max()) + 1):
        own = np.flatnonzero((n_left >= lead) & (n_right >= length - lead) & (bounds[:, 0] <= lead) & (lead <= bounds[:, 1]))
        if not len(own):
            continue
        class_left[order_left] = np.cumsum(head_left | (common_left < lead))
        class_right[order_right] = np.cumsum(common_right < length - lead)
        key = class_left[own] * (n + 1) + class_right[own]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        repeated = counts[own] > 1
        repeated[order[1:]] |= same
        repeated[order[:-1]] |= same
        found = own[repeated]
        largest[found] = lead
        fresh = found[smallest[found] < 0]
        smallest[fresh] = lead
    return largest, smallest


_KINDS = "part long, leads int, anchor long, c long, n long, before int, around binary"


def lead_ranges(length: int, gram: int, ranges: int) -> list[tuple[int, int]]:
    """All leads from 0 to ``length - gram``, in consecutive ranges (both ends inclusive)."""
    return [(int(x[0]), int(x[-1])) for x in np.array_split(np.arange(length - gram + 1), ranges) if len(x)]


def _kind_bytes(held: DataFrame, parts: int, length: int, gram: int, group_limit: int, ranges: int) -> DataFrame:
    """The bytes of the kinds listed for each text, dealt to ``parts`` groups by their anchors; kinds of an anchor with
    more than ``group_limit`` of them once for each range of leads, by the bytes that windows of these leads share."""
    spans = lead_ranges(length, gram, ranges)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = [], None
        for batch in batches:
            for key, text, kinds in zip(zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), strict=True), batch["text"].cast(pa.binary()), batch["kinds"], strict=True):
                if key == last:  # the same text again
                    continue
                text, last = text.as_py(), key
                for m in kinds.as_py():
                    before, size = (m["place"] >> 12) & 4095, m["place"] & 4095
                    at = m["place"] >> 24
                    around = text[at - before : at - before + size]
                    if m["kinds"] <= group_limit:
                        out.append((m["anchor"] % parts, -1, m["anchor"], m["c"], m["n"], before, around))
                        continue
                    for k, (low, high) in enumerate(spans):
                        if before >= low and size - before >= length - high:
                            part = xxhash.xxh3_64_intdigest(around[before - low : before + length - high], (m["anchor"] + k) % 2**64) % parts
                            out.append((part, k, m["anchor"], m["c"], m["n"], before, around))
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return held.mapInArrow(rows, _KINDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "leads", "anchor", "c", "n", "before", "around"])


def _compared(kinds: DataFrame, length: int, gram: int, ranges: int) -> DataFrame:
    """anchor, c, back, ahead: how far from the anchor the repeated windows of a kind reach, all of which hold it."""
    spans = np.array([(0, length - gram), *lead_ranges(length, gram, ranges)])

    def find(table: pa.Table) -> pa.Table:
        anchor, c, leads = (table[x].to_numpy() for x in ("anchor", "c", "leads"))
        # A kind comes more than once if copies of its text did.
        one, group = _once(anchor, leads, c)
        around = [x.as_py() for x in table["around"].take(pa.array(one))]
        before, n = table["before"].to_numpy()[one].astype(np.int64), table["n"].to_numpy()[one]
        largest, smallest = repeated_leads(group, before, around, n, length, gram, spans[leads[one] + 1])
        hit = np.flatnonzero(largest >= 0)
        columns = [pa.array(anchor[one][hit]), pa.array(c[one][hit]), pa.array(largest[hit].astype(np.int32)), pa.array((length - smallest[hit]).astype(np.int32))]
        return pa.Table.from_arrays(columns, ["anchor", "c", "back", "ahead"])

    return kinds.groupBy("part").applyInArrow(find, "anchor long, c long, back int, ahead int")


def _once(anchor: np.ndarray, leads: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each (anchor, leads, c), and the number of its (anchor, leads)."""
    order = np.lexsort((c, leads, anchor))
    new_group = np.ones(len(order), bool)
    new_group[1:] = (anchor[order][1:] != anchor[order][:-1]) | (leads[order][1:] != leads[order][:-1])
    new = new_group.copy()
    new[1:] |= c[order][1:] != c[order][:-1]
    return order[new], np.cumsum(new_group)[new]


def repeated_spans(texts: DataFrame, length: int = 200, gram: int = 16, group_limit: int = 4_000, ranges: int = 4, group_rows: int = 4_000) -> DataFrame:
    """k1, k2 and spans (sorted) of the bytes of each different text that repeated strings of ``length`` bytes cover;
    ``texts`` is from ``keyed_texts``, one row a document."""
    spark = texts.sparkSession
    repeated = materialize(anchor_counts(texts, length, gram).where("n > 1").select("anchor"), "repeated-anchors")
    release(spark)
    marks = materialize(anchor_marks(texts, length, gram).join(repeated, "anchor", "left_semi"), "repeated-marks")
    release(spark)
    kinds = marks.groupBy("anchor", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    kinds = materialize(kinds.select("anchor", "c", "n", "one.k1", "one.k2", "one.place"), "kinds")
    release(spark)
    of_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    several = materialize(of_anchor.where("kinds > 1"), "anchors-of-several-kinds")
    # An anchor with one kind of surroundings needs no comparison: its windows repeat if the kind does.
    place = F.col("place")
    alone = kinds.join(several, "anchor", "left_anti").where("n > 1").where(_size(place) >= length)
    alone = alone.select("anchor", "c", _before(place).cast("int").alias("back"), F.least(F.lit(length), _size(place) - _before(place)).cast("int").alias("ahead"))
    listed = kinds.join(several, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "c", "n", "kinds", "place")).alias("kinds"))
    parts = max(1, -(-kinds.count() // group_rows))
    held = texts.select("k1", "k2", "text").join(listed, _KEY)
    found = _compared(_kind_bytes(held, parts, length, gram, group_limit, ranges), length, gram, ranges)
    covered = materialize(found.unionByName(alone), "covered")
    release(spark)

    spans = marks.join(covered, ["anchor", "c"]).select("k1", "k2", F.struct((_position(place) - F.col("back")).alias("from"), (_position(place) + F.col("ahead")).alias("to")).alias("span"))
    merged = materialize(spans.groupBy(*_KEY).agg(F.sort_array(F.collect_set("span")).alias("spans")), "repeated-spans")
    discard(repeated, marks, kinds, several, covered)
    release(spark)
    return merged


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, merged where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 16, group_limit: int = 4_000, ranges: int = 4) -> DataFrame:
    """doc_id, n_bytes, kept (binary), n_removed, n_spans of each row: every byte goes that a string of ``length``
    bytes covers which also starts anywhere else, judged on the input.

    NULL texts count as empty; rows that repeat a doc_id are documents of their own and, being equal, repeat each other;
    a NULL doc_id is carried as it is; a text shorter than ``length`` stays whole, one of any length is a row; other
    columns are not read; empty tables give empty results.
    """
    texts = keyed_texts(docs)
    spans = repeated_spans(texts, length, gram, group_limit, ranges)
    joined = texts.join(spans, _KEY, "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, kept, runs = [], [], []
            for raw, found in zip(batch["text"].cast(pa.binary()), batch["spans"], strict=True):
                raw = raw.as_py()
                gone = _union([(x["from"], x["to"]) for x in found.as_py()]) if found.is_valid else []
                edges = [0, *(p for span in gone for p in span), len(raw)]
                size.append(len(raw))
                runs.append(len(gone))
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array([a - len(b) for a, b in zip(size, kept, strict=True)], pa.int64()), pa.array(runs, pa.int64())], ["doc_id", "n_bytes", "kept", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, kept binary, n_removed long, n_spans long")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
