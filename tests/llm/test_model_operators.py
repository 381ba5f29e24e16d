"""Token files, packing, the classifier, language model, neighbours and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from utterlake.llm import ann, lm_scoring, near_dup, packing, quality, token_output
from utterlake.llm.tokens import encoder, tokenizer_path

DATA = "/root/testdata/sf0.001"


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \t\n sSTtéÉßÀÿ÷×½²°ªa1_.!?:, REi \r") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(" \n'sSTtéß œ—…a1²_.<|endoftext|> I'll REİ") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["", None]
    plain = library(name)
    assert [x.tolist() for x in encoder(tokenizer_path(name)).encode(pa.array(texts))] == [plain(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 5, 4096, 4097, 20000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for most in (1, 3, 50, 49000):
        ids = (rng.zipf(1.3, n) % most).astype(np.uint32)
        raw = token_output.encode_segment(ids)
        assert (token_output.decode_segment(raw) == ids).all()
    ids = np.array([5, 2**31, 7, 5], np.uint32)
    assert (token_output.decode_segment(token_output.encode_segment(ids)) == ids).all()


def test_coder_compresses_and_detects_damage():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    raw = token_output.encode_segment(ids)
    assert len(raw) < len(ids) // 2
    for at in (20, len(raw) // 2):
        broken = bytearray(raw)
        broken[at] ^= 0x55
        with pytest.raises((ValueError, IndexError, OverflowError)):
            token_output.decode_segment(bytes(broken))


def table(spark):
    rows = [(i, f"Document {i} says hello, world! " * (i % 7), "en") for i in range(40)] + [(50, None, "x"), (51, "", "x"), (3, "again", "x"), (None, "no id", "x"), (60, "word " * 9000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string"), rows


def test_token_files(spark):
    df, rows = table(spark)
    got = token_output.read_tokens(token_output.write_tokens(df, partitions=3)).collect()
    got.sort(key=lambda r: r.start)
    encode, at = library("word_bpe_49k.json"), 0
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(encode(t) + [1])
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(got) == len(rows)
    for r in got:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert own in texts[r.doc_id] and r.start == at and r.n_tokens == len(own)
        at += len(own)
    assert token_output.read_tokens(token_output.write_tokens(df.limit(0))).count() == 0


def test_packing(spark):
    df, rows = table(spark)
    got = packing.pack_documents(df, capacity=64, group_rows=20).collect()
    encode = library("byte_bpe_50k.json")
    by_doc, places = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t, _ in rows:
        if i == 3:
            continue  # two documents
        ids, at = encode(t) + [0], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 64)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spans in places.values():
        ends = 0
        for a, n in sorted(spans):
            assert a == ends
            ends += n
        assert ends <= 64
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_sum_of_squares_fills():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2049, 3000)
    sequence, _ = packing.sum_of_squares(lengths, 2048)
    least = max(-(-lengths.sum() // 2048), (lengths > 1024).sum())  # no two of more than half fit together
    assert sequence.max() + 1 <= least * 1.01


@pytest.mark.parametrize(("capacity", "low", "n"), [(12, 1, 200), (30, 4, 300), (64, 20, 300)])
def test_sum_of_squares_takes_the_best_place(capacity, low, n):
    """Each length, longest first, against all open sequences tried one by one."""
    lengths = np.random.default_rng(capacity).integers(low, capacity + 1, n)
    sequence, offset = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, chosen = int(lengths[i]), int(sequence[i])
        if chosen not in gaps:
            assert not any(g >= size for g in gaps.values()), "a sequence was opened although one has room"
            gaps[chosen] = capacity
        else:
            squares = {}
            for gap in {g for g in gaps.values() if g >= size}:
                counts = Counter(g for g in gaps.values() if g)
                counts[gap] -= 1
                counts[gap - size] += gap > size
                squares[gap] = sum(c * c for c in counts.values())
            assert gaps[chosen] == min(squares, key=lambda g: (squares[g], g))
        assert offset[i] == capacity - gaps[chosen]
        gaps[chosen] -= size
    assert sum(capacity - g for g in gaps.values()) == lengths.sum()


def test_quality_on_held_out(spark):
    path = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in quality.op6_quality_classifier(spark, path).collect()}
    labels = [(scores[r.doc_id], r.quality) for r in spark.read.parquet(f"{path}/labels.parquet").collect()]
    held = [(s.predicted, y) for s, y in labels if s.held_out]
    assert all(0 <= s.score <= 1 for s in scores.values())
    assert np.mean([p == y for p, y in held]) > 0.95


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Some words."), (3, "a " * 200_000), (3, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, none).count() == 5
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == 5
    assert quality.keep_good(docs.limit(0), none).count() == 0


def test_quality_with_more_partitions_than_labels(spark):
    docs = spark.createDataFrame([(i, f"Text number {i}. It has words.") for i in range(40)], "doc_id long, text string").repartition(16)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        assert quality.keep_good(docs, labels).count() == 40
        model = quality.fit_quality(quality.with_vectors(docs).repartition(16), labels)
        assert model.mean.shape == (2, len(quality.FEATURES))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_discriminant(train, x, shrink=0.15, ridge=0.02, temperature=3.0):
    """Class densities by matrix inverses and determinants, row by row."""
    d = x.shape[1]
    groups = [np.array([v for v, y in train if y == k]) for k in (0, 1)]
    pooled = sum((len(g) - 1) * np.cov(g.T) for g in groups) / (len(train) - 2)
    logs = []
    for g in groups:
        w = shrink + (1 - shrink) * d / (d + len(g))
        cov = (1 - w) * np.cov(g.T) + w * pooled
        cov = cov + ridge * (np.trace(cov) / d + 1e-3) * np.eye(d)
        diff = x - g.mean(0)
        logs.append((-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.log(np.linalg.det(cov))) / temperature + np.log(len(g) / len(train)))
    return 1 / (1 + np.exp(logs[0] - logs[1]))


def test_quality_equals_a_plain_discriminant(spark):
    path = "/root/testdata/sf0.01"
    vectors = {r.doc_id: np.array(r.vector, float) for r in quality.with_vectors(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    train = [(vectors[i], y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5]
    ids = sorted(vectors)
    want = plain_discriminant(train, np.stack([vectors[i] for i in ids]))
    got = {r.doc_id: r.score for r in quality.op6_quality_classifier(spark, path).collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-6)


def test_kneser_ney(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("the a Cat dog sat ran É x y z".split()) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(90, None), (91, "unseen\tWords\x0bhere")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [(i, t) for i, t in rows if i < 90]
    model = lm_scoring.fit_kneser_ney(df.where("doc_id < 90"))
    got = {r.doc_id: r for r in lm_scoring.score_texts(df, model).collect()}
    cut = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + ["end"]
    c = Counter(w for _, t in train for w in cut(t))
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for _, t in train for p in zip(["begin", *cut(t)], cut(t), strict=False))
    total, kinds, follow = Counter(), defaultdict(Counter), Counter()
    for (a, b), k in pairs.items():
        total[a] += k
        kinds[a][min(k, 3)] += 1
        follow[b] += 1
    times = lambda values: lm_scoring._discounts([float(sum(x == k for x in values)) for k in (1, 2, 3, 4)])
    d, e = times(list(pairs.values())), times(list(follow.values()))
    rest = sum(e[min(x, 3)] for x in follow.values()) / sum(follow.values())
    low = lambda w: max(follow[w] - e[min(follow[w], 3)], 0) / sum(follow.values()) + rest / (v + 1)
    p = lambda a, b: low(b) if not total[a] else max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / total[a] + sum(d[k] * kinds[a][k] for k in (1, 2, 3)) / total[a] * low(b)
    for i, t in rows:
        w, r = cut(t), got[i]
        assert (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["begin", *w], w, strict=False)))
    empty = lm_scoring.fit_kneser_ney(df.limit(0))
    assert lm_scoring.score_texts(df, empty).where("n_known > 0 or isnan(score)").count() == 0


def test_scoring_fails_without_the_model(spark, tmp_path):
    model = lm_scoring.fit_kneser_ney(spark.createDataFrame([("a b",)], "text string"))
    model.folder = str(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="mounted"):
        lm_scoring.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()


def test_kneser_ney_edge_cases(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", "y"), (2, None, "z"), (3, "long " * 100_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = lm_scoring.score_texts(df, lm_scoring.fit_kneser_ney(df)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 4), ("1", 4), ("2", 1), ("3", 100_001), ("None", 3)]
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and all(r.score < 0 for r in got)


def brute_nearest(rows, k, every):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in usable.items()}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in unit.items()}
    out = {}
    for q in usable:
        if q % every == 0:
            near = sorted((-float((unit[q] * unit[i]).sum()), i) for i in usable if i != q and len(usable[i]) == len(usable[q]))[:k]
            out[q] = [i for _, i in near]
    return out


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(120)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] + [1.0] * 7), (1004, [None] + [1.0] * 7), (None, [1.0] * 8), (1010, [1.0, 2.0]), (1020, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, k=5, every=10, block_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == brute_nearest(rows, 5, 10)
    assert ann.nearest(df.limit(0)).count() == 0


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(np.arange(8), np.arange(8), indexing="ij"), -1).reshape(-1, 2)
    order = np.argsort(ann.hilbert_keys(cells, 3))
    assert sorted(ann.hilbert_keys(cells, 3).tolist()) == list(range(64))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def plain_pipeline(spark, folder):
    """The pipeline's documents before packing, stage by stage on the driver; only the fitted model is the operator's."""
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    model = quality.fit_quality(quality.with_vectors(spark.read.parquet(f"{folder}/documents.parquet")), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.score(quality.document_vectors(pa.array([r["text"] for r in rows])).astype(np.float32).astype(float))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    key = lambda line: re.sub(rb"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", b"", line.encode()).lower()
    holders = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line).decode()) >= 40:
                holders[key(line)].add(r["doc_id"])
    keeper = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    for r in rows:
        r["text"] = "\n".join(x for x in (r["text"] or "").split("\n") if keeper.get(key(x), r["doc_id"]) == r["doc_id"])
    cut = lambda text: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())]
    rows.sort(key=lambda r: r["doc_id"])
    code = {}
    words = [np.array([code.setdefault(w, len(code)) for w in cut(r["text"])], np.uint32) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):  # all pairs
        for j in range(i):
            band = near_dup.allowed(len(words[i]), len(words[j]), 0.8)
            if near_dup.rough_distance(words[i], words[j]) <= band and near_dup.edit_distance(words[i], words[j], band) <= band:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    items = [cut(r.text or "") for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(q[s : s + 13]) for q in items for s in range(max(1, len(q) - 12)) if q}
    sizes = {len(w) for w in windows}
    kept = []
    for r in rows:
        own, hit = cut(r["text"]), set()
        for k in sizes:
            for s in range(len(own) - k + 1):
                if tuple(own[s : s + k]) in windows:
                    hit.update(range(s, s + k))
        if not hit or 20 * len(hit) < len(own):
            kept.append(r)
    return {r["doc_id"]: r["text"] for r in kept}


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns and docs.count() <= n
        n = docs.count()
    assert docs.where("n_chars <> char_length(text)").count() == 0
    want = plain_pipeline(spark, DATA)
    assert {r.doc_id: r.text for r in docs.collect()} == want
    packed, encode = corpus_pipeline.run(spark, DATA).collect(), library("byte_bpe_50k.json")
    lengths, places = Counter(), defaultdict(list)
    for r in packed:
        lengths[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert lengths == {i: len(encode(t)) + 1 for i, t in want.items()}
    for spans in places.values():
        assert [a for a, _ in sorted(spans)] == [sum(x for _, x in sorted(spans)[:k]) for k in range(len(spans))] and sum(x for _, x in spans) <= 2048


def test_pipeline_stages_with_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "Some good text without an id.", "en", None, 29), (3, "again", None, "s", 5), (3, "again", None, "s", 5), (4, "word " * 50_000, "en", "s", 250_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("lang", "h1").withColumnRenamed("source", "row_id")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, DATA)
            assert name == "pack" or out.columns == table.columns
            assert out.count() >= (1 if table is docs else 0)
