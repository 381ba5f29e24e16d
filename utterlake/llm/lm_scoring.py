"""Language-model scores from an interpolated modified Kneser-Ney n-gram model.

Tokens are the white-space words of a text, A-Z lower-cased, then one end. Spark counts words and word pairs of the
training documents: every task sends, for each shard of the hash space, one packed array of hashes with counts, and one
task a shard merges them. A context's pairs share a shard, except those of contexts that make up a thousandth of all
tokens (at most a thousand words), which are spread. The merged shards are stored as sorted hash arrays; the workers
that score map these files into memory and look their sorted queries up, so no process holds the model and pages are
shared. Nothing of the corpus goes through the driver but count-of-count sums and the frequent words' sums.

The files live under ``spark.checkpoint.dir``, which must be reachable as a path on every worker (a mounted folder).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import LOWER, NOT_SPACE, crc32_mod, discard, materialize, mix64, new_path, prefix_sums, release, span_hashes, token_spans, utf8_chunks

#: Hashes of the end of a text, and of what comes before its first token.
_END, _BEGIN = np.uint64(0xE7D1A5B9C3F08261), np.uint64(0xB5297A4D3F84D5B5)


def text_tokens(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, edges): token hashes of a chunk of texts, each text's end included, and where each text's begin."""
    for _, data, offsets in utf8_chunks(column):
        data = LOWER[data]
        starts, ends = token_spans(data, NOT_SPACE)
        cut = np.unique(offsets[:-1][offsets[:-1] < len(data)])
        inside = cut[np.searchsorted(starts, cut, "left") > np.searchsorted(ends, cut, "right")]
        if len(inside):  # tokens do not cross texts
            starts, ends = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))
        own = np.searchsorted(starts, offsets)
        hashes = np.insert(span_hashes(prefix_sums(data), starts, ends), own[1:], _END)
        yield hashes, own + np.arange(len(own))


def contexts(tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The token before each token; before a text's first one stands the begin mark."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[edges[:-1][np.diff(edges) > 0]] = _BEGIN
    return before


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One hash for a context and the upper 48 bits of the token that follows."""
    return mix64(before + mix64(after ^ np.uint64(0xA24BAED4963EE407)))


def upper(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(16)


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different values, sorted, and the sums of their weights (by default 1 each)."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, weights = values[order], weights[order]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    sums = np.diff(np.append(heads, len(values))) if weights is None else np.add.reduceat(weights, heads) if len(heads) else weights
    return values[heads], sums


def pack_counts(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences in as few bytes as the largest needs, counts in one byte or eight."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    small = counts < 255
    return np.array([len(values), width], "<u8").tobytes() + raw.tobytes() + np.where(small, counts, 255).astype(np.uint8).tobytes() + counts[~small].astype("<u8").tobytes()


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, 16).reshape(n, width)
    counts = np.frombuffer(blob, np.uint8, n, 16 + n * width).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<u8", offset=16 + n * (width + 1)).astype(np.int64)
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64), counts


def shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    return (values >> np.uint64(40)) % np.uint64(shards)


class _Tally:
    """Sums of counts over a task's chunks, merged whenever the chunks outgrow what is merged."""

    def __init__(self):
        self.values, self.counts, self.parts, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((values, counts))
        self.waiting += len(values)
        if self.waiting > max(500_000, len(self.values)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self.values, self.counts = counted(np.concatenate([self.values, *(p[0] for p in self.parts)]), np.concatenate([self.counts, *(p[1] for p in self.parts)]))
            self.parts, self.waiting = [], 0
        return self.values, self.counts


def shards_for(n_bytes: int, shard_bytes: int = 1 << 24) -> int:
    return max(4, -(-n_bytes // shard_bytes))


def _split(own: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by shard, and (shard, from, to) of those that occur."""
    order = np.argsort(own, kind="stable")
    found, heads = np.unique(own[order], return_index=True)
    edges = np.append(heads, len(own)).tolist()
    return order, list(zip(found.tolist(), edges[:-1], edges[1:], strict=True))


#: Different entries after which a task sends what it has.
FLUSH = 2_000_000
_ROWS = "shard int, packed binary"


def _frame(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "packed"])


def word_counts(texts: DataFrame, shards: int) -> DataFrame:
    """Packed counts of the tokens of each task, by shard of the token."""

    def send(tally: _Tally) -> pa.RecordBatch:
        values, counts = tally.merge()
        order, parts = _split(shard_of(values, shards), shards)  # stable: hashes stay sorted
        return _frame([(k, pack_counts(values[order[x:y]], counts[order[x:y]])) for k, x, y in parts])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for tokens, _ in text_tokens(batch["text"]):
                tally.add(*counted(tokens))
            if len(tally.values) + tally.waiting > FLUSH:
                yield send(tally)
                tally = _Tally()
        yield send(tally)

    return texts.select("text").mapInArrow(count, _ROWS)


def pack_pairs(before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs by context: the contexts as packed counts of their pairs, then six bytes a token and the counts."""
    order = np.argsort(before)
    before, after, counts = before[order], after[order], counts[order]
    head = pack_counts(*counted(before, np.ones(len(before), np.int64)))
    small = counts < 255
    tail = after.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + np.where(small, counts, 255).astype(np.uint8).tobytes() + counts[~small].astype("<u8").tobytes()
    return np.array([len(head), len(before)], "<u8").tobytes() + head + tail


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, n = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    values, times = unpack_counts(blob[16 : 16 + size])
    at = 16 + size
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
    counts = np.frombuffer(blob, np.uint8, n, at + 6 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<u8", offset=at + 7 * n).astype(np.int64)
    return np.repeat(values, times), raw.view("<u8").ravel(), counts


def pair_shard(before: np.ndarray, keys: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    """The pairs of a context share a shard, but those of a frequent context are spread over all."""
    own = shard_of(before, shards)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, before), len(frequent) - 1)
        own = np.where(frequent[at] == before, shard_of(keys, shards), own)
    return own


def _distinct_pairs(before: np.ndarray, after: np.ndarray, counts: np.ndarray | None = None):
    keys = pair_keys(before, after)
    order = np.argsort(keys)
    ranked = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(heads, len(keys))) if counts is None else np.add.reduceat(counts[order], heads) if len(heads) else counts
    return ranked[heads], before[order[heads]], after[order[heads]], sums


def pair_counts(texts: DataFrame, shards: int, frequent: np.ndarray) -> DataFrame:
    """Packed counts of the token pairs of each task, by shard."""

    def send(parts: list[tuple]) -> pa.RecordBatch:
        keys, before, after, counts = _distinct_pairs(*(np.concatenate([p[k] for p in parts]) for k in range(3))) if parts else [np.zeros(0, np.uint64)] * 4
        order, spans = _split(pair_shard(before, keys, frequent, shards), shards)
        return _frame([(k, pack_pairs(before[order[x:y]], after[order[x:y]], counts[order[x:y]])) for k, x, y in spans])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            for tokens, edges in text_tokens(batch["text"]):
                _, *found = _distinct_pairs(contexts(tokens, edges), upper(tokens))
                parts.append(found)
                waiting += len(found[0])
                if waiting > FLUSH:
                    yield send(parts)
                    parts, waiting = [], 0
        if parts:
            yield send(parts)

    return texts.select("text").mapInArrow(count, _ROWS)


# --- the stored model --------------------------------------------------------------------------------------------


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Whole or not at all: a task that is run again replaces the file by an equal one."""
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(draft, "wb") as file:
        np.save(file, values)
    os.replace(draft, f"{folder}/{name}.npy")


@lru_cache(maxsize=20_000)
def _mapped(folder: str, name: str) -> np.ndarray:
    path = f"{folder}/{name}.npy"
    if os.path.exists(path):
        return np.load(path, mmap_mode="r")
    if not os.path.exists(f"{folder}/model.npy"):  # a worker that does not see the folder must not score by nothing
        raise FileNotFoundError(f"no model in {folder}: it must be mounted on every worker")
    return np.zeros(0, np.uint64)  # no hash of the corpus falls into this shard


def _times(counts: np.ndarray) -> list[float]:
    """How many counts are 1, 2, 3, 4."""
    return [float((counts == k).sum()) for k in (1, 2, 3, 4)]


def _discounts(n: list[float]) -> np.ndarray:
    """Modified Kneser-Ney discounts of the counts 0, 1, 2, 3 and more from the counts of counts 1 to 4; where one
    cannot be estimated, half its count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


_STATS = "kind string, key long, shard int, packed binary, v array<double>"


def _merge_words(folder: str):
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_counts(x) for x in rows["packed"]]
        values, counts = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        _save(folder, f"word-{key[0]}", values)
        _save(folder, f"word-count-{key[0]}", counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64))
        return pd.DataFrame({"shard": [key[0]], "n": [int(counts.sum())], "v": [len(values)]})

    return merge


def _merge_pairs(folder: str, shards: int, frequent: np.ndarray):
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_pairs(x) for x in rows["packed"]]
        keys, before, after, counts = _distinct_pairs(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        _save(folder, f"pair-{key[0]}", keys)
        _save(folder, f"pair-count-{key[0]}", counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64))
        out = [("times", 0, -1, None, _times(counts))]
        # Each context: how often it occurs, and how many tokens follow it once, twice, more often.
        order = np.argsort(before)
        ranked = before[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        known = ranked[heads]
        table = np.stack([np.add.reduceat(x[order], heads) for x in (counts, counts == 1, counts == 2, counts > 2)], 1).astype(np.float64)
        is_frequent = np.isin(known, frequent)
        out += [("frequent", int(u.view(np.int64)), -1, None, row.tolist()) for u, row in zip(known[is_frequent], table[is_frequent], strict=True)]
        _save(folder, f"context-{key[0]}", known[~is_frequent])
        _save(folder, f"context-table-{key[0]}", table[~is_frequent].astype(np.uint32))
        follows, times = counted(after)
        own, spans = _split(follows % np.uint64(shards), shards)
        out += [("follows", 0, k, pack_counts(follows[own[x:y]], times[own[x:y]]), None) for k, x, y in spans]
        return pd.DataFrame(out, columns=["kind", "key", "shard", "packed", "v"])

    return merge


def _merge_follows(folder: str):
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_counts(x) for x in rows["packed"]]
        values, counts = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        _save(folder, f"follow-{key[0]}", values)
        _save(folder, f"follow-count-{key[0]}", counts.astype(np.uint32))
        return pd.DataFrame({"n": [float(counts.sum())], "t": [[*_times(counts), float((counts > 2).sum())]]})

    return merge


@dataclass
class KneserNey:
    """Where the model's files are, and its few global numbers."""

    folder: str
    shards: int
    n_tokens: int
    n_words: int
    frequent: np.ndarray
    frequent_table: np.ndarray
    pair_discount: np.ndarray
    follow_discount: np.ndarray
    n_pairs: float
    follow_rest: float

    def _find(self, kind: str, shard: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted hashes in a mapped array, and whether they are there."""
        stored = _mapped(self.folder, f"{kind}-{shard}")
        if not len(stored):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)
        return at, stored[at] == wanted

    def _lookup(self, kind: str, table: str, wanted: np.ndarray, shard: np.ndarray, width: int = 0) -> np.ndarray:
        """Stored values of hashes, 0 where there are none."""
        out = np.zeros((len(wanted), width) if width else len(wanted))
        order, parts = _split(shard, self.shards)
        for k, a, b in parts:
            own = order[a:b]
            own = own[np.argsort(wanted[own])]
            at, there = self._find(kind, k, wanted[own])
            if there.any():
                out[own[there]] = _mapped(self.folder, f"{table}-{k}")[at[there]]
        return out

    def score(self, tokens: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base score and model score of each text."""
        words, back = np.unique(tokens, return_inverse=True)
        count = self._lookup("word", "word-count", words, shard_of(words, self.shards))
        follow = self._lookup("follow", "follow-count", upper(words), upper(words) % np.uint64(self.shards))
        base = np.log10((count + 1) / (self.n_tokens + 1 * (self.n_words + 1)))
        total = max(self.n_pairs, 1)
        lower = np.maximum(follow - self.follow_discount[np.minimum(follow, 3).astype(int)], 0) / total + (self.follow_rest if self.n_pairs else 1.0) / (self.n_words + 1)

        keys, before, after, _ = _distinct_pairs(contexts(tokens, edges), upper(tokens))
        pairs = self._lookup("pair", "pair-count", keys, pair_shard(before, keys, self.frequent, self.shards))
        seen, where = np.unique(before, return_inverse=True)
        table = self._lookup("context", "context-table", seen, shard_of(seen, self.shards), 4)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, seen), len(self.frequent) - 1)
            hot = self.frequent[at] == seen
            table[hot] = self.frequent_table[at[hot]]
        occurs = table[:, 0]
        rest = np.where(occurs > 0, table[:, 1:] @ self.pair_discount[1:] / np.maximum(occurs, 1), 1.0)
        own = np.maximum(pairs - self.pair_discount[np.minimum(pairs, 3).astype(int)], 0) / np.maximum(occurs[where], 1)
        # Back from different pairs to tokens.
        at = np.searchsorted(keys, pair_keys(contexts(tokens, edges), upper(tokens)))
        p = own[at] + rest[where[at]] * lower[back]
        text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        add = lambda x: np.bincount(text, x, len(edges) - 1)
        return add(count[back] > 0).astype(np.int64), add(base[back]), add(np.log10(p))


def _local(path: str) -> str:
    place = urlparse(path)
    if place.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped: {path} must be a mounted folder")
    return place.path


def fit_kneser_ney(docs: DataFrame) -> KneserNey:
    """Count and store the model of all texts of ``docs``.

    NULL counts as empty; every row counts, repeated ones as often as they come and those without a doc_id too; texts of
    any length are counted whole; only ``text`` is read. Without rows every token is unknown and equally likely.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = shards_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    folder = _local(new_path(spark, "kneser-ney"))
    _save(folder, "model", np.array([shards]))
    by_shard = word_counts(texts, shards).groupBy("shard").applyInPandas(_merge_words(folder), "shard int, n long, v long")
    n_tokens, n_words = by_shard.agg(F.sum("n"), F.sum("v")).first()
    n_tokens, n_words = n_tokens or 0, n_words or 0

    # Words that make up a thousandth of all tokens: never more than a thousand.
    def heavy(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        values, counts = _mapped(folder, f"word-{k}"), _mapped(folder, f"word-count-{k}")
        return pd.DataFrame({"word": np.asarray(values[counts >= n_tokens / 1000]).view(np.int64)})

    listed = spark.range(shards).groupBy("id").applyInPandas(heavy, "word long").collect()
    frequent = np.unique(np.array([_BEGIN, *(np.int64(r["word"]).view(np.uint64) for r in listed)], np.uint64))

    merged = pair_counts(texts, shards, frequent).groupBy("shard").applyInPandas(_merge_pairs(folder, shards, frequent), _STATS)
    merged = materialize(merged, "pair-counts")
    release(spark)
    sums = merged.where("kind <> 'follows'").groupBy("kind", "key").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(4)]).collect()
    table = np.zeros((len(frequent), 4))
    times = [0.0] * 4
    for row in sums:  # at most one row a frequent word, and one
        values = [row[f"v{k}"] for k in range(4)]
        if row["kind"] == "times":
            times = values
        else:
            table[np.searchsorted(frequent, np.int64(row["key"]).view(np.uint64))] = values
    follows = merged.where("kind = 'follows'").groupBy("shard").applyInPandas(_merge_follows(folder), "n double, t array<double>")
    found = follows.agg(F.sum("n").alias("n"), *[F.sum(F.col("t")[k]).alias(f"t{k}") for k in range(5)]).first()
    discard(merged)
    release(spark)
    n_pairs = found["n"] or 0.0
    t = [found[f"t{k}"] or 0.0 for k in range(5)]
    discount = _discounts(t[:4])
    rest = (discount[1] * t[0] + discount[2] * t[1] + discount[3] * t[4]) / max(n_pairs, 1)
    return KneserNey(folder, shards, n_tokens, n_words, frequent, table, _discounts(times), discount, n_pairs, rest)


def score_texts(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row.

    NULL texts count as empty and have the end alone. Repeated rows and a NULL doc_id are carried as they are; other
    columns are not read; an empty table gives an empty result. A worker that cannot see the model's folder fails.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for tokens, edges in text_tokens(batch["text"]):
                known, base, own = model.score(tokens, edges)
                n = len(edges) - 1
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, n), pa.array(np.diff(edges).astype(np.int64)), pa.array(known), pa.array(base), pa.array(own)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                first += n

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those whose crc32 of the doc_id's text modulo 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc32_mod(F.col("doc_id"), 7) == 2
    model = fit_kneser_ney(docs.where(~held_out))
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
