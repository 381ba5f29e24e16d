"""Token ids of whole texts by a public tokenizer file.

The files' pre-tokenizers cut a text into pieces that are encoded one by one, so a worker keeps the ids of the pieces
it has met, in sorted hash arrays, and asks the tokenizers library for new pieces only. Pieces of texts in printable
Latin-1 are found by byte classes over whole Arrow batches; every other text, and one with an apostrophe (whose
contractions need the pattern itself), goes to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers

from ._shared import prefix_sums, span_hashes, utf8_chunks

#: Pieces that a worker remembers, at about 40 bytes each; when full it starts anew.
MAX_PIECES = 2_000_000
#: Bytes of text that are cut into pieces at a time.
CHUNK = 1 << 19

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each one-byte character, and of each two-byte character U+0080 to U+00FF by its last byte plus 64
    times whether its first byte is C3; 9 for what is not plain."""
    one, two = np.full(256, 9, np.uint8), np.full(256, 9, np.uint8)
    one[0x20:0x7F] = _OTHER
    one[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
    one[0x30:0x3A] = _NUMBER
    one[0x41:0x5B] = one[0x61:0x7B] = _LETTER
    one[ord("'")] = 9
    # Letters and numbers of U+00A1 to U+00FF.
    for point in range(0xA1, 0x100):
        kind = _LETTER if point in (0xAA, 0xB5, 0xBA) or point >= 0xC0 and point not in (0xD7, 0xF7) else _NUMBER if point in (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE) else _OTHER
        two[0x80 + (point & 0x3F) + 64 * (point >= 0xC0) - 0x80] = kind
    return one, two


_ONE, _TWO = _classes()


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_level()


def _class_of_bytes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character; 9 where it is not plain."""
    kind = _ONE[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    lead = lead[lead + 1 < len(data)]
    trail = data[lead + 1]
    both = np.where((trail & 0xC0) == 0x80, _TWO[(trail & 0x3F) + np.uint8(64) * (data[lead] == 0xC3)], np.uint8(9))
    kind[lead] = both
    kind[lead + 1] = both
    return kind


def _runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one class, cut at the texts' borders."""
    cut = np.ones(len(kind) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    return edges[:-1], edges[1:]


def _byte_bpe_pieces(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray):
    """Runs of letters, numbers and others, each with one space before it; the white space that is left."""
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = _runs(kind, offsets)
    final = np.zeros(len(data) + 1, bool)
    final[offsets] = True
    flag = np.zeros(len(data) + 1, bool)
    flag[starts] = True
    last = ends[(kind[starts] == _SPACE) & ~final[ends]] - 1  # the white space before another run
    flag[last] = True
    flag[last[data[last] == 0x20] + 1] = False
    flag[len(data)] = True
    edges = np.flatnonzero(flag)
    return data, edges[:-1], edges[1:]


def _word_bpe_pieces(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray):
    """Runs of letters and of others, single numbers; lower case, white space dropped."""
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 32
    upper = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = upper[(data[upper] < 0x9F) & (data[upper] != 0x97)]
    data[upper] += 32
    starts, ends = _runs(kind, offsets)
    keep = kind[starts] != _SPACE
    starts, ends = starts[keep], ends[keep]
    numbers = np.flatnonzero(kind[starts] == _NUMBER)
    if len(numbers):
        at = np.flatnonzero((kind == _NUMBER) & ((data & 0xC0) != 0x80))
        ends_at = at + 1 + ((data[at] & 0xC0) == 0xC0)
        letters = kind[starts] != _NUMBER
        starts, ends = np.concatenate([starts[letters], at]), np.concatenate([ends[letters], ends_at])
        order = np.argsort(starts)
        starts, ends = starts[order], ends[order]
    return data, starts, ends


_PIECES = {"byte_bpe_50k.json": _byte_bpe_pieces, "word_bpe_49k.json": _word_bpe_pieces}


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As numpy.unique with an index and the inverse, by an unstable sort, which is much faster."""
    order = np.argsort(values)
    ranked = values[order]
    head = np.ones(len(values), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=head[1:])
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(head) - 1
    return ranked[head], order[head], inverse


class PieceEncoder:
    """Encodes texts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._pieces = _PIECES.get(os.path.basename(path))
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)  # sorted
        self._at = np.zeros(0, np.int64)  # of each hash: the first of its ids
        self._size = np.zeros(0, np.int64)
        self._ids = np.zeros(1 << 16, np.uint32)
        self._used = 0

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Add new pieces; their hashes are sorted."""
        tokenize = self._tokenizer.model.tokenize
        found = [[t.id for t in tokenize(piece.decode("latin-1").translate(_ALPHABET))] for piece in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = list(chain.from_iterable(found))
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(ids)] = ids
        at = self._used + np.cumsum(sizes) - sizes
        self._used += len(ids)
        where = np.searchsorted(self._hashes, hashes)
        self._hashes, self._at, self._size = np.insert(self._hashes, where, hashes), np.insert(self._at, where, at), np.insert(self._size, where, sizes)

    def _plain(self, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, and where each text's ids begin (one entry more)."""
        data, starts, ends = self._pieces(data, kind, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, first, inverse = _distinct(span_hashes(prefix_sums(data), starts, ends))
        if len(self._hashes) + len(hashes) > MAX_PIECES:
            self._forget()
        where = np.searchsorted(self._hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = where < len(self._hashes)
        new[inside] = self._hashes[where[inside]] != hashes[inside]
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            where = np.searchsorted(self._hashes, hashes)
        at, size = self._at[where][inverse], self._size[where][inverse]
        edges = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=edges[1:])
        ids = self._ids[np.repeat(at - edges[:-1], size) + np.arange(edges[-1])]
        return ids, edges[np.searchsorted(starts, offsets)]

    def encode(self, column) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text of an Arrow string column, in order; NULL has none."""
        for _, data, offsets in utf8_chunks(column, CHUNK):
            kind = _class_of_bytes(data)
            plain = np.ones(len(offsets) - 1, bool)
            if self._pieces is None:
                plain[:] = False
            else:
                plain[np.searchsorted(offsets, np.flatnonzero(kind == 9), "right") - 1] = False
            if plain.all():
                ids, edges = self._plain(data, kind, offsets)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    yield ids[a:b]
                continue
            keep = np.repeat(plain, np.diff(offsets))
            sizes = np.diff(offsets)[plain]
            inner = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=inner[1:])
            ids, edges = self._plain(data[keep], kind[keep], inner)
            k = 0
            for i, is_plain in enumerate(plain.tolist()):
                if is_plain:
                    yield ids[edges[k] : edges[k + 1]]
                    k += 1
                else:
                    yield self._direct(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker and file, so that its pieces outlive a task."""
    return PieceEncoder(path)


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)
