"""Token-id files written by an adaptive context-mixing range coder.

A segment holds the ids of some consecutive documents. Its ids are replaced by their ranks in the segment's frequency
order, and cut into blocks of ``BLOCK`` tokens that are coded independently: all adaptive state starts anew, and each
block carries a checksum. Within a block three models predict the next rank: order 2 and order 1 name the rank that
last followed the same two or one ranks, order 0 gives every rank a share by adaptive counts over ranges of ranks.
The mixed distribution gives the two named ranks weights that adapt to their success, the rest goes to order 0, and an
arithmetic coder with 16-bit digits codes the interval; a rank's place within its range is stored plain.

Blocks do not depend on each other, so all blocks of a segment are coded side by side by NumPy, one token of each a
step. Files are Parquet rows with one segment each, written and read by Spark in ascending doc_id order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize
from .tokens import encoder, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
BLOCK = 2048
#: Tokens after which a segment is closed at the end of a document.
SEGMENT = 1 << 22
_MAGIC = b"CMRC1\0\0\0"
_SLOTS = 1 << 10  # of each block's context tables
_TOTAL, _ZERO = 16, 13  # bits of the coder's total and of order 0's total
_TOP = 1 << 32
_CARRY = 1 << 48
#: Steps before which the order-0 tables are made anew.
_REBUILDS = {0, 8, 32, 64, 128, *range(256, BLOCK, 256)}


def _rank_ranges(size: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """First rank and number of plain bits of each range: 64 single ranks, then eight ranges an octave."""
    firsts, bits, at, width = list(range(64)), [0] * 64, 64, 3
    while at < size:
        for _ in range(8):
            firsts.append(at)
            bits.append(width)
            at += 1 << width
        width += 1
    return np.array(firsts, np.int64), np.array(bits, np.int64)


_FIRST, _BITS = _rank_ranges()
_N = len(_FIRST)
_RANGE_OF = np.repeat(np.arange(_N), np.diff(np.append(_FIRST, 2 * _FIRST[-1])))[: 1 << 17].astype(np.int64)


_NONE = np.zeros(0, np.int64)


class _Mixer:
    """The adaptive state of all blocks of a segment, the same for coding and decoding."""

    def __init__(self, lanes: int, inverse: bool = False):
        lane = np.arange(lanes)
        self.one = np.full(lanes * _SLOTS, -1, np.int32)
        self.two = np.full(lanes * _SLOTS, -1, np.int32)
        self.base, self.count_base, self.edge_base, self.inverse_base = lane * _SLOTS, lane * _N, lane * (_N + 1), lane << _ZERO
        self.last, self.mark = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.weight_one = np.full(lanes, 4096, np.int64)
        self.weight_two = np.full(lanes, 8192, np.int64)
        self.counts = np.ones(lanes * _N, np.int32)
        self.wants_inverse = inverse
        self.step = 0

    def _tables(self) -> None:
        """Order 0: where each range begins in its total; for decoding also the range at each place of the total."""
        table = self.counts.reshape(-1, _N)
        scale = ((1 << _ZERO) - _N) / table.sum(1, keepdims=True)
        share = 1 + (table * scale).astype(np.int64)
        share[:, 0] += (1 << _ZERO) - share.sum(1)
        edges = np.zeros((len(table), _N + 1), np.int64)
        np.cumsum(share, 1, out=edges[:, 1:])
        self.edges = edges.ravel()
        if self.wants_inverse:
            self.range_at = np.repeat(np.tile(np.arange(_N, dtype=np.uint8), len(table)), share.ravel())

    def predict(self) -> None:
        """The ranks that orders 2 and 1 name, and the weights that they have now."""
        if self.step in _REBUILDS:
            self._tables()
        self.step += 1
        self.slot_one = self.base + (self.mark & (_SLOTS - 1))
        self.slot_two = self.base + ((self.mark >> 16) & (_SLOTS - 1))
        self.named_one, self.named_two = self.one[self.slot_one], self.two[self.slot_two]
        self.has_two = self.named_two >= 0
        self.has_one = (self.named_one >= 0) & (self.named_one != self.named_two)
        self.share_two = self.weight_two * self.has_two
        self.named = self.share_two + self.weight_one * self.has_one
        self.rest = (1 << _TOTAL) - self.named

    def begin(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the ranges' intervals."""
        at = self.edge_base + kind
        a = self.edges[at]
        a *= self.rest
        a >>= _ZERO
        a += self.named
        at += 1
        b = self.edges[at]
        b *= self.rest
        b >>= _ZERO
        b += self.named
        return a, b

    def update(self, rank: np.ndarray, kind: np.ndarray, hit_two: np.ndarray, hit_one: np.ndarray) -> None:
        """Count the rank; ``hit_two`` and ``hit_one`` are the places where orders 2 and 1 named it."""
        grown_two, grown_one = self.weight_two[hit_two], self.weight_one[hit_one]
        self.weight_two += ((256 - self.weight_two) >> 5) * self.has_two
        self.weight_one += ((256 - self.weight_one) >> 5) * self.has_one
        self.weight_two[hit_two] = grown_two + ((36000 - grown_two) >> 4)
        self.weight_one[hit_one] = grown_one + ((16000 - grown_one) >> 4)
        self.one[self.slot_one] = rank
        self.two[self.slot_two] = rank
        self.counts[self.count_base + kind] += 24
        # The low bits hash the last rank, the bits from 16 up the last two.
        single = rank * 40503
        self.mark = ((single ^ (single >> 9)) & 0xFFFF) + (((single + self.last * 30011) & 0xFFFFF) << 16)
        self.last = rank


def _grid(ranks: np.ndarray) -> np.ndarray:
    """Ranks by step and block; the last block is filled up with rank 0 if there are others."""
    lanes = -(-len(ranks) // BLOCK)
    steps = BLOCK if lanes > 1 else len(ranks)
    grid = np.zeros(lanes * steps, np.int32)
    grid[: len(ranks)] = ranks
    return np.ascontiguousarray(grid.reshape(lanes, steps).T)


def encode_blocks(ranks: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Code and plain bits of each block of ``ranks``."""
    if not len(ranks):
        return [], []
    grid = _grid(ranks)
    steps, lanes = grid.shape
    mixer = _Mixer(lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, _CARRY - 1, np.int64)
    width = steps + 4
    flat = np.zeros(lanes * width, np.int32)
    used = np.arange(lanes) * width
    by_zero = np.ones((steps, lanes), bool)
    kinds = _RANGE_OF[grid].astype(np.uint8)
    for t in range(steps):
        rank, kind = grid[t].astype(np.int64), kinds[t]
        mixer.predict()
        a, b = mixer.begin(kind)
        hit_two = np.flatnonzero(mixer.named_two == rank)
        hit_one = np.flatnonzero((mixer.named_one == rank) & mixer.has_one)
        if len(hit_two):
            a[hit_two], b[hit_two] = 0, mixer.share_two[hit_two]
            by_zero[t, hit_two] = False
        if len(hit_one):
            a[hit_one], b[hit_one] = mixer.share_two[hit_one], mixer.named[hit_one]
            by_zero[t, hit_one] = False
        unit = span >> _TOTAL
        b -= a
        a *= unit
        low += a
        span = b * unit
        over = np.flatnonzero(low >= _CARRY)
        if len(over):
            low[over] -= _CARRY
            flat[used[over] - 1] += 1  # a carry always has a digit before it; spread at the end
        small = np.flatnonzero(span < _TOP)
        if len(small):
            part = low[small]
            flat[used[small]] = part >> 32
            used[small] += 1
            low[small] = (part & (_TOP - 1)) << 16
            span[small] <<= 16
        mixer.update(rank, kind, hit_two, hit_one)
    for shift in (32, 16, 0):  # what is left of low
        flat[used] = (low >> shift) & 0xFFFF
        used += 1
    digits = flat.reshape(lanes, width)
    while (digits > 0xFFFF).any():
        carry = digits >> 16
        digits &= 0xFFFF
        digits[:, :-1] += carry[:, 1:]
    used -= np.arange(lanes) * width
    codes = [digits[i, : used[i]].astype("<u2").tobytes() for i in range(lanes)]
    return codes, [x for a in range(0, lanes, 64) for x in _plain_bits(grid[:, a : a + 64], kinds[:, a : a + 64], by_zero[:, a : a + 64])]


def _plain_bits(grid: np.ndarray, kinds: np.ndarray, by_zero: np.ndarray) -> list[bytes]:
    """For each lane (column), the places within their ranges of the ranks that order 0 coded, most significant bit
    first, from a byte's border on. Lanes are laid out one behind the other, so all bits are set together."""
    lanes = grid.shape[1]
    kinds = np.ascontiguousarray(kinds.T).ravel()
    at = np.flatnonzero((_BITS[kinds] > 0) & np.ascontiguousarray(by_zero.T).ravel())
    lane, kind = at // len(grid), kinds[at]
    bits, place = _BITS[kind], np.ascontiguousarray(grid.T).ravel()[at] - _FIRST[kind]
    ends = np.cumsum(bits)
    first = np.searchsorted(lane, np.arange(lanes + 1))
    edge = np.concatenate([[0], ends])[first]  # unpadded bits before each lane
    size = (np.diff(edge) + 7) // 8  # bytes
    at = np.concatenate([[0], np.cumsum(size)])
    begin = ends - bits + (8 * at[:-1] - edge[:-1])[lane]
    out = np.zeros(8 * int(at[-1]), np.uint8)
    for k in range(int(bits.max(initial=0))):  # all k-th bits from the left at once
        if k:
            longer = bits > k
            bits, place, begin = bits[longer], place[longer], begin[longer]
        out[begin + k] = (place >> (bits - 1 - k)) & 1
    packed = np.packbits(out).tobytes()
    return [packed[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def decode_blocks(codes: list[bytes], plain: list[bytes], n: int) -> np.ndarray:
    """The ranks behind the blocks; ``n`` of them."""
    lanes = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    steps = BLOCK if lanes > 1 else n

    def side_by_side(parts: list[bytes], kind: str, spare: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.frombuffer(x, kind) for x in parts]
        width = max(map(len, parts)) + spare
        out = np.zeros((lanes, width), np.int64)
        for i, x in enumerate(parts):
            out[i, : len(x)] = x
        return out.ravel(), np.arange(lanes) * width

    digits, used = side_by_side(codes, "<u2", 4)
    raw, bits_used = side_by_side(plain, "u1", 5)
    packed = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # the four bytes from each place
    bits_used = bits_used * 8
    out = np.zeros((steps, lanes), np.int32)
    mixer = _Mixer(lanes, inverse=True)
    code = (digits[used] << 32) | (digits[used + 1] << 16) | digits[used + 2]
    used += 3
    span = np.full(lanes, _CARRY - 1, np.int64)
    for t in range(steps):
        mixer.predict()
        unit = span >> _TOTAL
        target = (code / unit).astype(np.int64)  # below 2**53, so the quotient is exact
        np.minimum(target, (1 << _TOTAL) - 1, out=target)
        named = target < mixer.named
        # The last range that begins at or before the target: begin * rest < (target - named + 1) * total.
        place = target - mixer.named
        place += 1
        place <<= _ZERO
        place -= 1
        place = (place / mixer.rest).astype(np.int64)
        np.maximum(place, 0, out=place)
        kind = mixer.range_at[mixer.inverse_base + place]
        a, b = mixer.begin(kind)
        take = _BITS[kind]
        hit_two = hit_one = _NONE
        any_named = np.flatnonzero(named)
        if len(any_named):
            second = target[any_named] < mixer.share_two[any_named]
            hit_two, hit_one = any_named[second], any_named[~second]
            a[hit_two], b[hit_two] = 0, mixer.share_two[hit_two]
            a[hit_one], b[hit_one] = mixer.share_two[hit_one], mixer.named[hit_one]
            take[any_named] = 0
        rank = packed[bits_used >> 3]
        rank >>= 32 - (bits_used & 7) - take
        rank &= (1 << take) - 1
        rank += _FIRST[kind]
        bits_used += take
        if len(any_named):
            rank[hit_two], rank[hit_one] = mixer.named_two[hit_two], mixer.named_one[hit_one]
            np.minimum(rank, (1 << 17) - 1, out=rank)
            kind[any_named] = _RANGE_OF[rank[any_named]]
        out[t] = rank
        b -= a
        a *= unit
        code -= a
        span = b * unit
        small = np.flatnonzero(span < _TOP)
        if len(small):
            code[small] = (code[small] << 16) | digits[used[small]]
            used[small] += 1
            span[small] <<= 16
        mixer.update(rank, kind, hit_two, hit_one)
    return out.T.ravel()[:n]


def encode_segment(ids: np.ndarray) -> bytes:
    """A segment's file format: magic, counts, the ids in rank order, the blocks' sizes and checksums, the blocks."""
    if len(ids) and ids.max() >= 1 << 20:
        values, ids_at, count = np.unique(ids, return_inverse=True, return_counts=True)
    else:  # a table of all ids up to the largest is short
        ids_at, count = ids, np.bincount(ids)
        values = np.arange(len(count))
    order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    rank_of = np.zeros(len(count), np.int32)
    rank_of[order] = np.arange(len(order))
    codes, plain = encode_blocks(rank_of[ids_at])
    checks = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) for i in range(len(codes))]
    table = np.array([[len(c), len(p), x] for c, p, x in zip(codes, plain, checks, strict=True)], "<u4").reshape(-1, 3)
    head = np.array([len(ids), len(order), len(codes)], "<u8").tobytes() + values[order].astype("<u4").tobytes() + table.tobytes()
    return _MAGIC + np.array([zlib.crc32(head)], "<u4").tobytes() + head + b"".join(x for pair in zip(codes, plain, strict=True) for x in pair)


def decode_segment(raw: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if the header or a block does not agree with its checksum."""
    n, n_values, n_blocks = (int(x) for x in np.frombuffer(raw, "<u8", 3, 12))
    body = 36 + 4 * n_values + 12 * n_blocks
    if raw[:8] != _MAGIC or zlib.crc32(raw[12:body]) != int(np.frombuffer(raw, "<u4", 1, 8)[0]):
        raise ValueError("damaged segment header")
    values = np.frombuffer(raw, "<u4", n_values, 36)
    table = np.frombuffer(raw, "<u4", 3 * n_blocks, 36 + 4 * n_values).reshape(-1, 3).astype(np.int64)
    codes, plain, at = [], [], body
    for code, bits, _ in table.tolist():
        codes.append(raw[at : at + code])
        plain.append(raw[at + code : at + code + bits])
        at += code + bits
    ranks = decode_blocks(codes, plain, n)
    if n and ranks.max() >= n_values:
        raise ValueError("damaged segment")
    ids = values[ranks]
    for i, check in enumerate(table[:, 2].tolist()):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != check:
            raise ValueError(f"damaged block {i}")
    return ids


_SEGMENTS = "part int, segment int, n_tokens long, doc_ids array<long>, lengths array<int>, payload binary"


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order; the files, as a DataFrame.

    NULL texts count as empty, a NULL doc_id comes first, rows that repeat a doc_id follow each other. ``part`` is the
    range partition, so (part, segment) is the files' order.
    """
    path = path or tokenizer_path(TOKENIZER)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, names, found, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(found)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            row = [part, number, len(ids), names, [len(x) for x in found], encode_segment(ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "segment", "n_tokens", "doc_ids", "lengths", "payload"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder(path).encode(batch["text"]), strict=True):
                names.append(doc_id)
                found.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= SEGMENT:
                    yield close()
                    number, names, found, size = number + 1, [], [], 0
        if found:
            yield close()

    return materialize(ordered.mapInArrow(segments, _SEGMENTS), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian 32-bit) of each document, in the files' order."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("part", before.alias("before"))  # one row a partition
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "segment", "n_tokens").withColumn("within", within).join(parts, "part").select("part", "segment", (F.col("before") + F.col("within")).alias("start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_segment(batch["payload"][i].as_py()).astype("<u4")
                lengths = np.array(batch["lengths"][i].as_py(), np.int64)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                raw = [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_ids"][i].values, pa.array(edges[:-1] + batch["start"][i].as_py()), pa.array(lengths), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.join(starts, ["part", "segment"]).select("doc_ids", "lengths", "payload", "start").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
