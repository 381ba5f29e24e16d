"""Alignment of the tokens of two tokenizers over the same texts.

A text is tokenised whole by both. Wherever a token of A and a token of B end at the same byte and the next token of
each begins with a space, the text is cut; what lies between two cuts is a window, a pair of tuples of ids. Words repeat,
so windows do: a worker aligns each pair of tuples once and remembers it. Two tokens that end at the same byte are
linked, so the bytes of one are a suffix of the other's: the pairs that can ever be linked follow from the vocabularies
alone (``Vocabularies.pairs``, at most the bytes of all entries of both, twice), which is the proven bound of the
corpus-wide counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import _POWERS, materialize, mix64, prefix_sums, span_hashes, utf8_chunks
from .tokens import _ALPHABET, CHUNK, _distinct, encoder, tokenizer_path

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words and windows that a worker remembers; when full it starts anew.
MAX_WORDS, MAX_WINDOWS = 1_000_000, 1_000_000
#: Windows of more tokens are aligned each time they come: they are long runs without a space and hardly repeat.
MEMO_TOKENS = 64

_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<int>, times array<int>"


class _Flat:
    """Arrays of different lengths in one, found by number."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1 << 12, kind), 0
        self.at, self.size, self.n = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def add(self, values, sizes: list[int]) -> None:
        """Arrays of these sizes, one after another."""
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.n + len(sizes) > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.data[self.used : self.used + len(values)] = values
        self.size[self.n : self.n + len(sizes)] = sizes
        self.at[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(values), self.n + len(sizes)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers one after another, and where each begins (one entry more)."""
        size = self.size[numbers]
        edges = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=edges[1:])
        return self.data[np.repeat(self.at[numbers] - edges[:-1], size) + np.arange(edges[-1])], edges


class _Numbers:
    """Numbers of 64-bit hashes, in sorted arrays."""

    def __init__(self):
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        where = np.searchsorted(self.hashes, hashes)
        found = np.full(len(hashes), -1, np.int64)
        inside = np.flatnonzero(where < len(self.hashes))
        inside = inside[self.hashes[where[inside]] == hashes[inside]]
        found[inside] = self.numbers[where[inside]]
        return found

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Hashes that are not there yet, sorted."""
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.numbers = np.insert(self.hashes, where, hashes), np.insert(self.numbers, where, numbers)


class SpacedEncoder:
    """Ids by a sentencepiece file none of whose pieces has a space mark after another character, so that no merge crosses
    the start of a run of spaces: texts are cut there, and each part is encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self._model.id_to_piece(i).lstrip("▁") for i in range(self._model.vocab_size()))
        if any("▁" in piece for piece in pieces):
            raise ValueError(f"{path} has pieces that cross words")
        self._forget()

    def _forget(self) -> None:
        self._known, self._ids = _Numbers(), _Flat(np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        mark = [self._model.piece_to_id("▁")]
        found = [ids if word else mark for word, ids in zip(words, self._model.encode(words, num_threads=1), strict=True)]
        self._known.add(hashes, self._ids.n + np.arange(len(words)))
        self._ids.add(list(chain.from_iterable(found)), list(map(len, found)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that each begin with a space, the one that the model itself adds; and where each text's begin."""
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes, first, inverse = _distinct(span_hashes(prefix_sums(data), starts, ends))
        if self._ids.n + len(first) > MAX_WORDS:
            self._forget()
        numbers = self._known.find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a + 1 : b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            numbers = self._known.find(hashes)
        ids, edges = self._ids.gather(numbers[inverse])
        return ids, edges[np.searchsorted(starts, offsets)]


class Vocabularies:
    """The bytes of the entries of both tokenizers and the pairs that can be linked."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        byte_of = {c: b for b, c in _ALPHABET.items()}
        tokenizer = encoder(path_a)._tokenizer
        a = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        b = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes_a, self.bytes_b = a, b
        self.flat_a, self.flat_b = _Flat(np.uint8), _Flat(np.uint8)
        self.flat_a.add(np.frombuffer(b"".join(a), np.uint8), list(map(len, a)))
        self.flat_b.add(np.frombuffer(b"".join(b), np.uint8), list(map(len, b)))
        self.size_a, self.size_b = list(map(len, a)), list(map(len, b))

    @property
    def pairs(self) -> np.ndarray:
        """a * 2^32 + b, sorted, of all pairs of entries of which one's bytes are a suffix of the other's."""
        if not hasattr(self, "_pairs"):
            found = set()
            for left, right, swap in ((self.bytes_a, self.bytes_b, False), (self.bytes_b, self.bytes_a, True)):
                ids: dict[bytes, list[int]] = {}
                for j, entry in enumerate(right):
                    ids.setdefault(entry, []).append(j)
                for i, entry in enumerate(left):
                    for k in range(len(entry)):
                        for j in ids.get(entry[k:], ()):
                            found.add(j << 32 | i if swap else i << 32 | j)
            self._pairs = np.sort(np.fromiter(found, np.int64, len(found)))
        return self._pairs


@lru_cache(maxsize=2)
def _worker(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align_window(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[bytes, list[int]]:
    """The groups of a window as text, and its links as a * 2^32 + b; sizes are in bytes, by id. Both lists cover the same
    bytes."""
    groups, links, i, j, ahead, from_a, from_b = [], [], 0, 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if ahead <= 0 and i < len(a):  # by how much the tokens of A so far end after those of B
            ahead += size_a[a[i]]
            i += 1
        else:
            ahead -= size_b[b[j]]
            j += 1
        if not ahead:
            groups.append(",".join(map(str, a[from_a:i])) + "|" + ",".join(map(str, b[from_b:j])))
            links.append(a[i - 1] << 32 | b[j - 1])
            from_a, from_b = i, j
    return ";".join(groups).encode(), links


def _id_sums(ids: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.upto(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * up[: len(ids)], out=sums[1:])
    return sums


class Aligner:
    """Aligns the texts of a worker, with its memory of windows."""

    def __init__(self, path_a: str, path_b: str):
        self.vocabularies = Vocabularies(path_a, path_b)
        self._a, self._b = encoder(path_a), SpacedEncoder(path_b)
        self._space_a = np.array([entry[:1] == b" " for entry in self.vocabularies.bytes_a])
        self._space_b = np.array([entry[:1] == b" " for entry in self.vocabularies.bytes_b])
        self._forget()

    def _forget(self) -> None:
        self._known = _Numbers()
        self._texts: list[bytes] = []
        self._ids_a, self._ids_b, self._links = _Flat(np.uint32), _Flat(np.uint32), _Flat(np.int32)

    def _aligned(self, windows: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """The numbers of the alignments of new windows."""
        v, links, sizes = self.vocabularies, [], []
        for a, b in windows:
            text, found = align_window(a, b, v.size_a, v.size_b)
            self._texts.append(text)
            links += found
            sizes.append(len(found))
        for flat, side in ((self._ids_a, 0), (self._ids_b, 1)):
            flat.add(list(chain.from_iterable(w[side] for w in windows)), [len(w[side]) for w in windows])
        self._links.add(np.searchsorted(v.pairs, np.array(links, np.int64)), sizes)
        return np.arange(len(self._texts) - len(windows), len(self._texts))

    @staticmethod
    def _right(flat: _Flat, ids: np.ndarray, edges: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: whether its tokens' bytes, joined, are the text."""
        size = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(flat.size[ids], out=size[1:])
        right = np.diff(size[edges]) == np.diff(offsets)
        if right.all():
            wrong = np.flatnonzero(flat.gather(ids)[0] != data)
            right[np.searchsorted(offsets, wrong, "right") - 1] = False
        else:
            for i in np.flatnonzero(right).tolist():
                right[i] = np.array_equal(flat.gather(ids[edges[i] : edges[i + 1]])[0], data[offsets[i] : offsets[i + 1]])
        return right

    @staticmethod
    def _keep(keep: np.ndarray, values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(edges)
        return values[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])])

    def _windows(self, a: np.ndarray, edges_a: np.ndarray, b: np.ndarray, edges_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of right texts, one after another: the numbers of their windows, and where each text's windows begin."""
        flat_a, flat_b = self.vocabularies.flat_a, self.vocabularies.flat_b
        ends_a, ends_b = np.cumsum(flat_a.size[a]), np.cumsum(flat_b.size[b])
        token_a = np.full(int(ends_a[-1]) + 1, -1, np.int64)  # of each byte: the token that ends there
        token_a[ends_a] = np.arange(len(a))
        last_b = np.flatnonzero(token_a[ends_b] >= 0)  # tokens of B that end with one of A
        last_a = token_a[ends_b[last_b]]
        final = np.zeros(len(b), bool)
        final[edges_b[1:] - 1] = True
        inner = np.flatnonzero(~final[last_b])
        anchor = final[last_b]
        anchor[inner] = self._space_a[a[last_a[inner] + 1]] & self._space_b[b[last_b[inner] + 1]]
        stop_a, stop_b = last_a[anchor] + 1, last_b[anchor] + 1
        start_a, start_b = np.concatenate([[0], stop_a[:-1]]), np.concatenate([[0], stop_b[:-1]])
        _, down = _POWERS.upto(max(len(a), len(b)) + 1)
        sums_a, sums_b = _id_sums(a), _id_sums(b)
        hash_a = mix64((sums_a[stop_a] - sums_a[start_a]) * down[start_a])
        hash_b = (sums_b[stop_b] - sums_b[start_b]) * down[start_b]
        hashes, first, inverse = _distinct(mix64(hash_a + hash_b))

        def align(windows: np.ndarray) -> np.ndarray:
            spans = zip(*(x[windows].tolist() for x in (start_a, stop_a, start_b, stop_b)), strict=True)
            return self._aligned([(a[i:j].tolist(), b[k:m].tolist()) for i, j, k, m in spans])

        known = self._known.find(hashes)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = align(first[new])
            short = new[(stop_a - start_a + stop_b - start_b)[first[new]] <= MEMO_TOKENS]
            self._known.add(hashes[short], known[short])
        numbers = known[inverse]
        other = np.zeros(len(numbers), bool)  # windows that share a hash with other ids
        for start, stop, ids, flat in ((start_a, stop_a, a, self._ids_a), (start_b, stop_b, b, self._ids_b)):
            other |= flat.size[numbers] != stop - start
            if not other.any():
                other[np.searchsorted(stop, np.flatnonzero(flat.gather(numbers)[0] != ids), "right")] = True
        if other.any():
            other |= np.isin(hashes[inverse], hashes[inverse][other])
            numbers[other] = align(np.flatnonzero(other))
        return numbers, np.searchsorted(stop_b, edges_b[1:], "right")

    def __call__(self, texts: pa.Array) -> Iterator[tuple]:
        """For each chunk of texts (each with its leading space; NULL has no tokens): n_a, n_b, the groups' texts, and the
        numbers of the linked pairs with the edges of each text's."""
        for first, data, offsets in utf8_chunks(texts, CHUNK):
            n = len(offsets) - 1
            if len(self._texts) > MAX_WINDOWS:
                self._forget()
            found = list(self._a.encode(texts.slice(first, n)))
            a, edges_a = np.concatenate([*found, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in found])])
            full = np.diff(offsets) > 1  # of NULL nothing is left, of an empty text the space
            whole, inner = self._keep(full, data, offsets)
            b, edges_b = self._b(whole, inner) if len(whole) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
            a, edges_a = self._keep(full, a, edges_a)
            right = self._right(self.vocabularies.flat_a, a, edges_a, whole, inner)
            right &= self._right(self.vocabularies.flat_b, b, edges_b, whole, inner)
            a, edges_a = self._keep(right, a, edges_a)
            b, edges_b = self._keep(right, b, edges_b)
            at = np.flatnonzero(full)[right]
            n_a, n_b, groups = np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n
            n_a[at], n_b[at] = np.diff(edges_a), np.diff(edges_b)
            sizes, pairs = np.zeros(n, np.int64), np.zeros(0, np.int32)
            if len(at):
                numbers, stops = self._windows(a, edges_a, b, edges_b)
                pairs, edges = self._links.gather(numbers)
                listed, start = numbers.tolist(), 0
                for i, stop in zip(at.tolist(), stops.tolist(), strict=True):
                    groups[i] = b";".join([self._texts[k] for k in listed[start:stop]])
                    start = stop
                sizes[at] = np.diff(edges[np.concatenate([[0], stops])])
            yield n_a, n_b, groups, pairs, np.concatenate([[0], np.cumsum(sizes)])


def _counted(pairs: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of each text, how often each comes, and the texts' edges."""
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges)).astype(np.int64)
    kinds, times = np.unique(text << 32 | pairs, return_counts=True)
    return (kinds & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32), np.searchsorted(kinds >> 32, np.arange(len(edges))).astype(np.int32)


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (text: ``a1,a2|b1;a3|b2,b3``), pairs and times (the different linked pairs, as
    numbers in ``Vocabularies.pairs``, and how many links of the text have each), one row for each row of ``docs``.

    Texts that are NULL or empty, or whose tokens' bytes are not the text after a space, have no tokens, no groups and no
    pairs. Rows are aligned each for itself, so repeated rows and a NULL doc_id stay as they are; further columns are not
    read. A text passes as a whole, however long; an empty table gives no rows.
    """
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(path_a, path_b)
        for batch in batches:
            at = 0
            for n_a, n_b, groups, pairs, edges in worker(batch["spaced"]):
                kinds, times, inner = _counted(pairs, edges)
                columns = [batch["doc_id"].slice(at, len(n_a)), pa.array(n_a), pa.array(n_b), pa.array(np.diff(edges)), pa.array(groups, pa.binary()).cast(pa.string()),
                           pa.ListArray.from_arrays(inner, pa.array(kinds)), pa.ListArray.from_arrays(inner, pa.array(times))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])
                at += len(n_a)

    return docs.select(F.col("doc_id").cast("long"), F.concat(F.lit(" "), F.col("text").cast("string")).alias("spaced")).mapInArrow(align, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of all rows of ``align_documents`` have each pair. Tasks add up their own rows first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            pairs, times = batch["pairs"].flatten().to_numpy(), batch["times"].flatten().to_numpy()
            found = np.bincount(pairs, weights=times).astype(np.int64) if len(pairs) else np.zeros(1, np.int64)
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(total[pairs])], ["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(add, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_scores(aligned: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``aligned`` (a table: it is read twice) with n_links, n_best (links whose pair has the highest count of all pairs
    with its B id, ties included) and count_sum (the sum of the counts over links).

    The counts of all pairs go to every worker: their number is at most that of ``Vocabularies.pairs``, whatever the
    corpus. A row without links has zeros."""
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)
    possible = Vocabularies(path_a, path_b).pairs
    found = pair_counts(aligned).toArrow()
    counts = np.zeros(len(possible), np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    b = possible & 0xFFFFFFFF
    most = np.zeros(int(b.max()) + 1, np.int64)
    np.maximum.at(most, b, counts)
    held = aligned.sparkSession.sparkContext.broadcast((counts, counts == most[b]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = held.value
        for batch in batches:
            pairs, times = batch["pairs"], batch["times"].flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(batch)), pairs.value_lengths().to_numpy())
            kinds, sums = pairs.flatten().to_numpy(), []
            for each in (times, times * best[kinds], times * count[kinds]):
                total = np.zeros(len(batch), np.int64)
                np.add.at(total, row, each)
                sums.append(pa.array(total))
            names = [name for name in batch.schema.names if name not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch[name] for name in names), *sums], [*names, "n_links", "n_best", "count_sum"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name not in ("pairs", "times"))
    return aligned.mapInArrow(score, f"{kept}, n_links long, n_best long, count_sum long")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("groups_sha256", digest).drop("groups")
    scored = link_scores(materialize(aligned, "aligned"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
