"""Best-fit packing by the sum-of-squares rule.

Documents are cut into pieces of at most ``capacity`` tokens; pieces are dealt by hash into groups of about
``group_rows``, and each group is packed on its own: longest first, every piece goes to the open sequence for which
the sum of the squared counts of open sequences per residual gap becomes smallest; a new sequence is opened only
when no open one has room. A group's state is one counter for each gap, so memory is bounded by the group size, and
what a group wastes is about one sequence in a few thousand pieces. Only piece lengths are shuffled, never texts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, row_slices
from .tokens import encoder, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of ``n`` tokens begin: only the first may be shorter than ``capacity``."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)] if n else []


def token_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The pieces of every document: its ids, then ``end_id``, cut into pieces of at most ``capacity``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for batch in row_slices(batches):
            rows = []
            for doc_id, found in zip(batch["doc_id"].to_pylist(), encoder(path).encode(batch["text"]), strict=True):
                ids = np.concatenate([found, end]).astype("<u4").tobytes()
                n = len(ids) // 4
                points = cut_points(n, capacity)
                for k, (a, b) in enumerate(zip(points, [*points[1:], n], strict=True)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, _PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (all from 1 to ``capacity``)."""
    open_at: dict[int, list[int]] = defaultdict(list)
    count = np.zeros(capacity + 1, np.int64)  # of open sequences by gap; a gap of 0 is closed
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        # Taking a sequence from gap g to g - size changes the sum of squares by 2 * (count[g - size] - count[g]) + 2;
        # an exact fit only removes one.
        change = np.where(count[size:] > 0, count[: capacity + 1 - size] - count[size:], np.iinfo(np.int64).max)
        best = int(change.argmin())
        if count[size + best]:
            gap = size + best
            at = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, at, used = capacity, used, used + 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > size:
            open_at[gap - size].append(at)
            count[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 4096) -> DataFrame:
    """``pieces`` (with a column length, 1 to ``capacity``) with sequence_id and offset added.

    Pieces within a sequence are gapless from offset 0. Repeated rows are packed as often as they come. Rows are
    dealt to groups by a hash of the whole row and a spreading number, so neither a hot document nor repeats unbalance
    the groups. An empty table gives an empty result.
    """
    pieces = materialize(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in pieces.columns], F.monotonically_increasing_id()), F.lit(groups))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, __group long"

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = sum_of_squares(rows["length"].to_numpy(np.int64), capacity)
        return rows.assign(sequence_id=(np.int64(key[0]) << 32) + sequence, offset=offset)

    return pieces.withColumn("__group", spread.cast("long")).groupBy("__group").applyInPandas(place, schema).drop("__group")


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = 2048, group_rows: int = 4096) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL or empty text has the end id alone, so every document has a piece; a NULL doc_id is carried as it is;
    documents that repeat a doc_id are packed each for itself; of equally good places the smallest gap is taken, of
    sequences of one gap the one that came to it last; further columns of ``docs`` are not read.
    """
    return pack(token_pieces(docs, path or tokenizer_path(TOKENIZER), end_id, capacity), capacity, group_rows)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
