"""What a Python worker holds must follow the slice it works on, not the whole Arrow batch."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from utterlake.llm import line_dedup, near_dup, packing, quality


class _Caught:
    """Stands for documents and keeps the function that an operator hands to mapInArrow."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def select(self, *_):
        return self

    def mapInArrow(self, f, *_):
        return f


def _functions(monkeypatch):
    monkeypatch.setattr(quality, "materialize", lambda rows, _: rows)
    monkeypatch.setattr(quality, "fit_quality", lambda *_: quality.QuadraticDiscriminant.fit({}))
    return {
        "quality": quality.keep_good(_Caught(), None),
        "lines": line_dedup.line_keys(_Caught(), 5),
        "near_duplicates": near_dup.word_rows(_Caught(), 2, 3, 5),
        "pack": packing.token_pieces(_Caught(), packing.tokenizer_path(packing.TOKENIZER)),
    }


@pytest.mark.parametrize("stage", ["quality", "lines", "near_duplicates", "pack"])
def test_a_large_batch_comes_back_in_parts(spark, stage, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    texts = [None if i % 97 == 5 else "" if i % 89 == 4 else " ".join(rng.choices(words, k=70)) for i in range(4200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    f = _functions(monkeypatch)[stage]
    parts = list(f(iter([batch.slice(0, 0), batch])))
    alone = [b for i in range(0, len(texts), 700) for b in f(iter([batch.slice(i, 700)]))]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches(alone)) and sum(b.num_rows for b in parts) >= len(texts) - 50 * (stage == "lines") - 50
    assert max(b.num_rows for b in parts) < len(texts) // 3
