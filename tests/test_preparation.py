"""Tokenizer, batches, coverage, crops and files against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from utterlake.functions import text as tx
from utterlake.operators import batching, coverage, tokenizer, verify
from utterlake.sources import files
from utterlake.tables import numbered


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "idx long, norm string")


def plain_bpe(rows, merges, min_freq=2):
    words = Counter("▁" + w for t in rows for w in t.split())
    pieces, found = {w: list(w) for w in words}, []
    while len(found) < merges:
        pairs = Counter()
        for w, p in pieces.items():
            for x in zip(p, p[1:], strict=False):
                pairs[x] += words[w]
        best = min((x for x in pairs if pairs[x] >= min_freq), key=lambda x: (-pairs[x], x), default=None)
        if best is None:
            break
        found.append(best)
        for p in pieces.values():
            i = 0
            while i + 1 < len(p):
                if (p[i], p[i + 1]) == best:
                    p[i : i + 2] = ["".join(best)]
                i += 1
    return found, pieces


@pytest.mark.parametrize("seed", [1, 2])
def test_bpe_equals_one_merge_at_a_time(spark, seed):
    rng = random.Random(seed)
    rows = [" ".join("".join(rng.choice("aab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 8))) for _ in range(30)]
    merges = tokenizer.bpe_train(texts(spark, rows), 8)
    want, pieces = plain_bpe(rows, 8)
    assert merges == want
    got = {r.word: r.pieces for r in tokenizer.word_pieces(texts(spark, rows), merges).collect()}
    assert got == pieces
    vocab = tokenizer.vocabulary(texts(spark, rows), merges)
    encoded = tokenizer.bpe_encode(texts(spark, rows), ["idx"], merges, vocab)
    back = {r.idx: r.text for r in encoded.select("idx", tokenizer.bpe_decode(encoded["ids"], vocab).alias("text")).collect()}
    assert [back[i] for i in range(len(rows))] == [" ".join(t.split()) for t in rows]


def plain_greedy(rows, n, seen):
    grams = lambda t: {(" " + t + " ")[i : i + 3] for i in range(len(t))}
    counts, left, out = Counter(seen), dict(enumerate(rows)), []
    while len(out) < n and left:
        best = min(left, key=lambda i: (-sum(1 / (1 + counts[g]) for g in sorted(grams(left[i]))) / max(len(left[i]), 1) ** 0.5, i))
        counts.update(grams(left.pop(best)))
        out.append(best)
    return out


def test_lazy_coverage_equals_full_greedy(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 20))).strip() or "a" for _ in range(120)]
    seen = spark.createDataFrame([("abc", 3), (" ab", 1)], "gram string, n long")
    assert coverage.greedy_coverage(texts(spark, rows), 25, seen=seen, top=10) == plain_greedy(rows, 25, {"abc": 3, " ab": 1})


@pytest.mark.parametrize("chunk", [32, 150])
def test_every_item_is_in_one_batch_within_bounds(spark, chunk):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, rng.random() * 20) for i in range(500)], "id long, duration double")
    found = batching.length_batches(items, "id", 12_000, 32, chunk).toPandas()
    assert sorted(found["id"]) == list(range(500))
    for _, b in found.groupby(["part", "batch"]):
        assert len(b) <= 32 and (len(b) == 1 or b["frames"].max() * len(b) <= 12_000)


def test_padding_crops_and_masks(spark):
    items = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [])], "batch int, ids array<int>")
    got = sorted((r.batch, r.length, r.ids, r["mask"]) for r in batching.ragged_pad(items, "batch").collect())
    assert got == [(0, 1, [4, 0, 0], [1, 0, 0]), (0, 3, [1, 2, 3], [1, 1, 1]), (1, 0, [], [])]
    series = spark.createDataFrame([(k, n, float(n)) for k, size in ((1, 5), (2, 40)) for n in range(size)], "key long, n long, x double")
    crop = {}
    for r in batching.random_crop(series, 12, 3).collect():
        crop.setdefault(r.key, {})[r.i] = r.x
    for key, size in ((1, 5), (2, 40)):
        x = [crop[key][i] for i in range(12)]
        assert all((b - a) % size == 1 for a, b in zip(x, x[1:], strict=False))
    keys = spark.createDataFrame([(k, 100) for k in range(30)], "key long, frames long")
    spans = batching.mask_spans(keys, 80).collect()
    assert all(0 <= s.low < s.high <= (80 if s.axis == "band" else 100) for s in spans)
    assert all(s.high - s.low <= (27 if s.axis == "band" else 5) for s in spans)


def test_files_round_trip(spark, tmp_path):
    assert np.allclose(files.pcm16_decode(files.pcm16_encode(np.array([0.5, -2.0, 2.0]))), np.array([16383, -32767, 32767]) / 32768)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.trans.txt").write_text("id-1 HELLO  THERE\nno\nid-2 A\n")
    (tmp_path / "a" / "x.txt").write_text("id-3 NOT THIS\n")
    found = files.scan_transcripts(spark, str(tmp_path))
    assert sorted((r.utt_id, r.text) for r in found.collect()) == [("id-1", "HELLO  THERE"), ("id-2", "A")]
    for name, seconds in (("short", 0.5), ("good", 1.0), ("long", 20.0)):
        (tmp_path / f"{name}.wav").write_bytes(files.wave_bytes(np.zeros(int(16_000 * seconds))))
    waves = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(tmp_path))
    assert [r.path.endswith("good.wav") for r in files.audio_manifest(waves).collect()] == [True]
    blocks = files.decode_blocks(waves, 5_000).where("path like '%good.wav'").collect()
    assert sorted((r.block, len(r.samples)) for r in blocks) == [(0, 5000), (1, 5000), (2, 5000), (3, 1000)]
    rows = spark.createDataFrame([("u1", 'say "a|b"', "raw", 1.23456)], files.MANIFEST)
    files.write_manifest(rows, str(tmp_path / "m"))
    (tmp_path / "m" / "bad.csv").write_text("a|b|c\nd|e|f|1.0|g\n")
    back = files.read_manifest(spark, str(tmp_path / "m"))
    assert [tuple(r) for r in back.collect()] == [("u1", 'say "a|b"', "raw", 1.235)] and back.count() == 1
    ids = files.next_ids(spark.createDataFrame([("utt-0041",)], "utt_id string"), spark.createDataFrame([("b",), ("a",)], "t string"), ["t"])
    assert sorted((r.t, r.utt_id) for r in ids.collect()) == [("a", "utt-0042"), ("b", "utt-0043")]
    with pytest.raises(ValueError, match="fingerprint"):
        files.guard(rows, "x", "y")


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "x long").repartition(7)
    got = sorted((r.x, r.k) for r in numbered(rows, ["x"], "k").collect())
    assert [k for _, k in got] == list(range(300))


def test_word_errors_of_whole_texts(spark):
    rng = random.Random(4)
    rows = [tuple(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 300))) for _ in range(2)) for _ in range(8)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for k, y in enumerate(b):
                new.append(min(row[k] + (x != y), row[k + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    df = spark.createDataFrame(rows, "hyp string, ref string")
    got = {(r.hyp, r.ref): r.e for r in df.select("hyp", "ref", tx.word_errors(df["hyp"], df["ref"]).alias("e")).collect()}
    assert all(got[h, r] == distance(h.split(), r.split()) for h, r in rows)


def test_bootstrap_brackets_the_eer_and_pca_finds_the_axis(spark):
    rng = np.random.default_rng(2)
    scored = spark.createDataFrame([(i, i + 1000, int(i % 2), float(rng.normal(i % 2, 1.0))) for i in range(400)], "a long, b long, same int, score double")
    point = verify.eer(verify.det_curve(scored)).first().eer
    low, high = verify.bootstrap_eer(scored, 60, low=-5.0, high=6.0).first()
    assert low <= point <= high and high - low < 0.2
    vectors = spark.createDataFrame([(i, [float(3 * t), float(4 * t), float(e)]) for i, (t, e) in enumerate(zip(rng.normal(size=200), rng.normal(size=200) * 0.01, strict=True))], "id long, v array<double>")
    got = {r.id: abs(r.p[0]) for r in verify.pca_project(vectors).collect()}
    raw = np.array([r.v for r in vectors.orderBy("id").collect()])
    want = np.abs((raw - raw.mean(0)) @ np.linalg.svd(raw - raw.mean(0))[2][0])
    assert np.allclose([got[i] for i in range(200)], want, atol=1e-6)
