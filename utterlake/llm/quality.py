"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Every document becomes a short vector of character and word statistics, computed in one pass over its bytes. Spark sums
weights, vectors and outer products of the labelled rows by class; the driver sees only these d x d sums, shrinks each
class covariance towards the pooled one and a scaled identity, and keeps its Cholesky factor. Scores are the logistic
of the difference of the class log-densities (Mahalanobis distance plus log-determinant) and the log prior. Labels,
language, source and doc_id are never inputs of a score. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import LOWER, NOT_SPACE, SMALL_CHUNK, crc32_mod, materialize, mix64, prefix_sums, span_hashes, token_spans, utf8_chunks

#: What each entry of a document's vector is made of.
FEATURES = ["upper", "digits", "symbols", "punctuation", "marks_inside", "pipes", "word_length", "length_spread", "repeats", "distinct", "line_repeats", "short_lines", "sentences", "log_words", "word_ends"]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"*$#%&@^~<>{}[]\\_=+|")] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?")] = True


def _share(part, whole):
    return part / np.maximum(whole, 1)


def _logit(share):
    """A share, stretched near 0 and 1."""
    return np.log(share + 0.01) - np.log(1.01 - share)


def _distinct_in(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """How many different hashes each document has."""
    keys = mix64(hashes ^ mix64(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    fresh = np.ones(len(keys), bool)
    np.not_equal(keys[order][1:], keys[order][:-1], out=fresh[1:])
    return np.bincount(doc[order], fresh, n_docs)


def document_vectors(column) -> np.ndarray:
    """One vector a text; NULL counts as the empty text."""
    parts = [_vectors(data, offsets) for _, data, offsets in utf8_chunks(column, SMALL_CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n_docs = len(offsets) - 1

    def count(flags) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    upper = (data >= 65) & (data <= 90)
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    upper[lead[data[lead + 1] < 0x9F]] = True
    letters = upper | ((data >= 97) & (data <= 122)) | (data >= 0xC3)
    punctuation, symbols = _PUNCTUATION[data], _SYMBOLS[data]
    n_letters, n_bytes = count(letters), np.diff(offsets)

    lowered = LOWER[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts, ends = token_spans(data, NOT_SPACE)
    if len(starts):  # words do not cross documents
        marks = np.flatnonzero(border[:-1])
        inside = marks[np.searchsorted(starts, marks, "left") > np.searchsorted(ends, marks, "right")]
        starts, ends = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    words = np.diff(first)
    hashes = span_hashes(prefix_sums(lowered), starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    size = (ends - starts).astype(float)
    ends_in = data[ends - 1] if len(ends) else data[:0]
    marked = _SYMBOLS[ends_in] | (ends_in == ord("!"))
    per_doc = lambda values: np.bincount(doc, values, n_docs)
    mean = _share(per_doc(size), words)
    spread = np.sqrt(np.maximum(_share(per_doc(size * size), words) - mean**2, 0))
    distinct = _distinct_in(hashes, doc, n_docs)

    newline = data == 10
    lines = count(newline) + 1
    line_edges = np.union1d(np.flatnonzero(newline) + 1, offsets[:-1])
    line_edges = line_edges[line_edges < len(data)] if len(data) else line_edges[:0]
    line_doc = np.searchsorted(offsets, line_edges, "right") - 1
    line_size = np.diff(np.append(line_edges, len(data)))
    short = np.bincount(line_doc, line_size < 30, n_docs)
    line_hash = span_hashes(prefix_sums(lowered), line_edges, line_edges + np.maximum(line_size - 1, 0))
    line_repeats = np.bincount(line_doc, minlength=n_docs) - _distinct_in(line_hash, line_doc, n_docs)

    out = [
        _logit(_share(count(upper), n_letters)),
        _logit(_share(count((data >= 48) & (data <= 57)), n_bytes)),
        _logit(_share(count(symbols), n_bytes)),
        _logit(_share(count(punctuation), n_bytes)),
        _logit(_share(count(data == ord("!")), n_bytes)),
        _logit(_share(count(data == ord("|")), words)),
        np.log1p(mean),
        np.log1p(spread),
        _logit(_share(per_doc(same), words)),
        _logit(np.minimum(distinct / np.maximum(words, 1) ** 0.8, 1.0)),
        _logit(_share(line_repeats, lines)),
        _logit(_share(short, lines)),
        _logit(np.minimum(_share(count((data == 46) | (data == 63) | (data == 33)), words), 1.0)),
        np.log1p(words) / 4,
        _logit(_share(per_doc(marked), words)),
    ]
    return np.stack([np.asarray(x, float) for x in out], 1)


@dataclass
class QuadraticDiscriminant:
    """Class means, inverse Cholesky factors, log-determinants and log priors; entry 1 is the good class."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    temperature: float

    @classmethod
    def fit(cls, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.15, ridge: float = 0.02, temperature: float = 3.0):
        """``sums``: for each class the number of rows, the sum of vectors and of outer products. A class without
        rows takes the other's shape and a prior of one row; without any row all scores are 0.5."""
        d = len(FEATURES)
        empty = (0.0, np.zeros(d), np.zeros((d, d)))
        rows = [sums.get(k, empty) for k in (0, 1)]
        total = sum(r[0] for r in rows)
        if not total:
            return cls(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), np.zeros(2), temperature)
        overall = sum(r[1] for r in rows) / total
        means = [r[1] / r[0] if r[0] else overall for r in rows]
        scatter = [r[2] - r[0] * np.outer(m, m) for r, m in zip(rows, means, strict=True)]
        pooled = sum(scatter) / max(total - 2, 1)
        inverse, log_det = [], []
        for (n, _, _), s in zip(rows, scatter, strict=True):
            own = s / max(n - 1, 1) if n > 1 else pooled
            weight = shrink + (1 - shrink) * d / (d + n)
            cov = (1 - weight) * own + weight * pooled
            cov += ridge * (np.trace(cov) / d + 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            inverse.append(np.linalg.inv(factor))
            log_det.append(2 * np.log(np.diag(factor)).sum())
        prior = np.log([max(r[0], 1) / total for r in rows])
        return cls(np.stack(means), np.stack(inverse), np.array(log_det), prior, temperature)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of the good class, softened by the temperature."""
        density = [-0.5 * (((x - m) @ inv.T) ** 2).sum(1) - 0.5 * ld for m, inv, ld in zip(self.mean, self.inverse, self.log_det, strict=True)]
        z = (density[1] - density[0]) / self.temperature + self.log_prior[1] - self.log_prior[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def with_vectors(docs: DataFrame) -> DataFrame:
    """doc_id and the vector of each row, as a table in the shared folder, so that texts are read once."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = document_vectors(batch["text"])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.astype(np.float32).ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], values], ["doc_id", "vector"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(vectors, "doc_id long, vector array<float>")
    return materialize(rows, "quality-vectors")


def fit_quality(vectors: DataFrame, labels: DataFrame, folds: int = 5) -> QuadraticDiscriminant:
    """Fit on the labelled rows outside fold 0 (crc32 of the doc_id's text modulo ``folds``). All of them count;
    labels other than 0 and 1, NULLs and a doc_id labelled both ways are left out; equal repeats count once."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(crc32_mod(F.col("doc_id"), folds) != 0)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"), F.max("quality").cast("int").alias("__y")).where("y = __y").drop("__y")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for y, rows in batch.groupby("y"):
                x = np.stack(rows["vector"].to_numpy()).astype(float)
                now = held.setdefault(int(y), [0, 0, 0])
                held[int(y)] = [now[0] + len(x), now[1] + x.sum(0), now[2] + x.T @ x]
        for y, (n, total, outer) in held.items():  # a partition without labelled rows has nothing to send
            yield pd.DataFrame({"y": [y], "n": [float(n)], "s": [total.tolist()], "o": [outer.ravel().tolist()]})

    parts = vectors.join(usable, "doc_id").mapInPandas(partial, "y int, n double, s array<double>, o array<double>")
    d = len(FEATURES)
    flat = parts.select("y", F.posexplode(F.concat(F.array("n"), "s", "o"))).groupBy("y", "pos").agg(F.sum("col").alias("v"))
    sums: dict[int, np.ndarray] = {}
    for row in flat.collect():  # at most 2 * (1 + d + d * d) rows
        sums.setdefault(row["y"], np.zeros(1 + d + d * d))[row["pos"]] = row["v"]
    return QuadraticDiscriminant.fit({y: (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for y, v in sums.items()})


def score_vectors(vectors: DataFrame, model: QuadraticDiscriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for each row of ``vectors``."""

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = model.score(np.stack(batch["vector"].to_numpy()).astype(float)) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": s, "predicted": (s >= threshold).astype("int32")})

    return vectors.mapInPandas(scores, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns unchanged.

    NULL and empty texts are scored like any other. Texts are scored again where they stand, so neither a repeated
    nor a NULL doc_id matters and no text is shuffled.
    """
    model = fit_quality(with_vectors(docs), labels, folds)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in utf8_chunks(batch["text"].cast(pa.string()), SMALL_CHUNK):
                x = _vectors(data, offsets).astype(np.float32).astype(float)
                yield batch.slice(first, len(x)).filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(keep, T.StructType(docs.schema.fields))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vectors = with_vectors(docs)
    model = fit_quality(vectors, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_vectors(vectors, model).select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
