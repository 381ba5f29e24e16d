"""Cross-tokenizer alignment against a brute-force version."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from utterlake.llm import alignment as al
from utterlake.llm._shared import materialize
from utterlake.llm.tokens import _ALPHABET, tokenizer_path

SCHEMA = "doc_id long, text string, n_a string, pairs long"


def brute(rows):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 by the two libraries and lists of ends."""
    first = Tokenizer.from_file(tokenizer_path(al.TOKENIZER_A))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(al.TOKENIZER_B))
    byte_of = {c: b for b, c in _ALPHABET.items()}
    found, count = [], Counter()
    for i, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            want = (" " + text).encode()
            a = [(t, bytes(byte_of[c] for c in first.id_to_token(t))) for t in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, bytes([int(second.id_to_piece(t)[3:5], 16)]) if second.is_byte(t) else second.id_to_piece(t).replace("▁", " ").encode()) for t in second.encode(text)]
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                n_a, n_b = len(a), len(b)
                ends = []
                for side in (a, b):
                    at, mine = 0, {}
                    for k, (_, x) in enumerate(side):
                        at += len(x)
                        mine[at] = k
                    ends.append(mine)
                before = (0, 0)
                for at in sorted(ends[0].keys() & ends[1].keys()):
                    k, m = ends[0][at], ends[1][at]
                    groups.append(",".join(str(t) for t, _ in a[before[0] : k + 1]) + "|" + ",".join(str(t) for t, _ in b[before[1] : m + 1]))
                    links.append((a[k][0], b[m][0]))
                    before = (k + 1, m + 1)
        count.update(links)
        found.append((i, n_a, n_b, links, ";".join(groups)))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(
        [(i, n_a, n_b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, n_a, n_b, links, g in found],
        key=str,
    )


def aligned(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], SCHEMA)
    return [tuple(r) for r in scored(docs).collect()]


def scored(docs):
    from pyspark.sql import functions as F

    found = al.align_documents(docs).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    return al.link_scores(materialize(found, "aligned")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a  b   c ", "<s> </s> <|endoftext|> <unk> <0x41>", "▁x and ▁", "don't we'll I'M", "tabs\tand\r\nlines\n\n\n  end  ", "日本語のテキスト。", "👩‍👩‍👧 é 　   ﻿ ​", "\x00 nul \x01",
    "x" * 3000, " " * 500, "éàü ßÖ ½²", "ﬁ ligature ㎞ Ⅳ", "１２３ full width", "ÀÉ" * 50 + " ende",
]


def test_odd_texts_equal_brute_force(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(ODD)] + [(3, "same text twice"), (3, "same text twice"), (40, "word " * 40_000)]
    assert sorted(aligned(spark, rows), key=str) == brute(rows)
    assert scored(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(5)
    letters = "abcdeé 　▁\n\t'.,<>0x41日\U0001f600́ " + " " * 8
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(200)))) for i in range(300)]
    assert sorted(aligned(spark, rows), key=str) == brute(rows)


def test_all_documents_of_the_smallest_table(spark):
    from utterlake.llm.alignment import op13_tokenizer_alignment

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op13_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()], key=str) == brute(rows)


def test_memory_of_windows_is_bounded_and_forgotten(monkeypatch):
    monkeypatch.setattr(al, "MAX_WINDOWS", 3)
    monkeypatch.setattr(al, "MAX_WORDS", 3)
    worker = al.Aligner(tokenizer_path(al.TOKENIZER_A), tokenizer_path(al.TOKENIZER_B))
    texts = pa.array([" one two three", " four five six", None, " one two three"])
    first = [tuple(map(list, x)) for x in worker(texts)]
    assert [tuple(map(list, x)) for x in worker(texts)] == first and first[0][2][0] == first[0][2][3]


def test_equal_hashes_do_not_mix_windows(monkeypatch):
    """With all hashes of windows equal, every window is still aligned by its own ids."""
    paths = tokenizer_path(al.TOKENIZER_A), tokenizer_path(al.TOKENIZER_B)
    texts = pa.array([" one two three, four", " wonderful things", " a b c d e f"])
    want = [x[2] for x in al.Aligner(*paths)(texts)]
    monkeypatch.setattr(al, "_id_sums", lambda ids: al.np.zeros(len(ids) + 1, al.np.uint64))
    assert [x[2] for x in al.Aligner(*paths)(texts)] == want


def test_number_of_pairs_is_bounded():
    both = al.Vocabularies(tokenizer_path(al.TOKENIZER_A), tokenizer_path(al.TOKENIZER_B))
    assert len(both.pairs) <= 2 * (sum(map(len, both.bytes_a)) + sum(map(len, both.bytes_b)))


def test_a_model_with_pieces_across_words_is_refused(monkeypatch):
    class Model:
        def __init__(self, model_file):
            pass

        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError):
        al.SpacedEncoder("x")
