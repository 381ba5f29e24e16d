"""Operators against plain versions: percentiles, lags, resampling, edit distance, merges, distances, commits and sources."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.functions import text as tx
from utterlake.operators import batching, prep, scoring, series, tokenizer, verify
from utterlake.sources import files
from utterlake.streaming import session_logs, sources


@pytest.mark.parametrize("window,chunk", [(5, 7), (50, 10), (1, 3), (9, 1000)])
def test_rolling_percentile_over_chunks(spark, window, chunk):
    rng = random.Random(window)
    rows = [("hot" if i % 3 else f"s{i % 5}", rng.randrange(20) / 2, i // 2, i, "kept") for i in range(400)]
    got = scoring.rolling_percentile(spark.createDataFrame(rows, "stage string, ms double, ts long, event_id long, more string"), 0.95, window, chunk)
    assert got.columns == ["stage", "ms", "ts", "event_id", "more", "pct"]
    want = {}
    for stage in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == stage), key=lambda r: r[2:4])
        for k, r in enumerate(mine):
            last = sorted(x[1] for x in mine[max(0, k - window + 1) : k + 1])
            want[r[3]] = last[round(0.95 * (len(last) - 1))]
    assert {r.event_id: r.pct for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()


def test_edit_distance_of_many_words(spark):
    many = [f"w{i}" for i in range(40_000)]  # more different words than there are characters of two bytes
    moved = many[:35_500] + ["x"] + many[35_502:] + ["y"]
    rows = spark.createDataFrame([(" ".join(many), " ".join(moved)), ("", "a  b"), ("a b", ""), ("", ""), (None, "a"), ("a", None)], "h string, r string")
    start = time.time()
    assert [r.e for r in rows.select(tx.word_errors(F.col("h"), F.col("r")).alias("e")).collect()] == [3, 2, 2, 0, None, None]
    assert time.time() - start < 30
    a, b = many[:2000], many[1000:3000]
    start = time.time()
    assert tx.edit_distance(a, b) == 2000 and time.time() - start < 0.5


def test_edit_distance_equals_the_table():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for k, y in enumerate(b):
                new.append(min(row[k] + (x != y), row[k + 1] + 1, new[-1] + 1))
            row = new
        assert tx.edit_distance(a, b) == row[-1]


def test_merges_equal_one_at_a_time():
    rng = random.Random(3)
    for _ in range(2000):
        tokens, merges = list("ab"), []
        for _ in range(rng.randrange(8)):
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair not in merges:
                merges.append(pair)
                tokens.append("".join(pair))
        rank = {pair: i for i, pair in enumerate(merges)}
        word = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        pieces = list(word)
        while found := sorted((rank[p], i) for i, p in enumerate(zip(pieces, pieces[1:], strict=False)) if p in rank):
            i = found[0][1]
            pieces = [*pieces[:i], pieces[i] + pieces[i + 1], *pieces[i + 2 :]]
        assert tokenizer.apply_merges(word, rank) == pieces
    start = time.time()
    assert len(tokenizer.apply_merges("ab" * 50_000, {("a", "b"): 0})) == 50_000 and time.time() - start < 5


def test_lag_equals_all_products(spark):
    rng = np.random.default_rng(4)
    ref, est, want = [], [], {}
    for key in range(30):
        n, m, first = rng.integers(1, 60), rng.integers(1, 60), int(rng.integers(-9, 9))
        r, e = rng.integers(-3, 4, n).astype(float), rng.integers(-3, 4, m).astype(float)
        ref += [(key, i, float(x)) for i, x in enumerate(r)]
        est += [(key, i + first, float(x)) for i, x in enumerate(e)]
        at = {i + first: x for i, x in enumerate(e)}
        scores = []
        for lag in range(-16, 17, 4):
            both = [(r[i], at[i + lag]) for i in range(n) if i + lag in at]
            if len(both) >= max(1, n // 2):
                scores.append((-sum(a * b for a, b in both), lag))
        if scores:
            want[key] = min(scores)[1]
    schema = "key long, n long, x double"
    got = series.best_lag(spark.createDataFrame(ref, schema), spark.createDataFrame(est, schema), 16)
    assert {r.key: r.lag for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_equals_resampling_of_trials(spark):
    rng = np.random.default_rng(6)
    same = np.arange(1200) % 3 == 0
    score = np.clip(rng.normal(same * 0.3, 0.2), -1, 1)

    def rate(s, y):
        thresholds = np.append(np.unique(s), s.max() + 1)
        t, n = np.sort(s[y]), np.sort(s[~y])
        frr, far = np.searchsorted(t, thresholds) / len(t), 1 - np.searchsorted(n, thresholds) / len(n)
        at = np.argmin(np.abs(far - frr))
        return (far[at] + frr[at]) / 2

    draws = [rate(score[i], same[i]) for i in (rng.integers(0, 1200, 1200) for _ in range(1000))]
    scored = spark.createDataFrame([(int(y), float(s)) for y, s in zip(same, score, strict=True)], "same long, score double")
    low, high = verify.bootstrap_eer(scored, 1000).first()
    assert (low, high) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=0.008)
    one = spark.createDataFrame([(1, 0.5)], "same long, score double")
    assert verify.bootstrap_eer(one, 10).first().low is None


def test_summary_of_sampled_trials(spark):
    rng = np.random.default_rng(7)
    items = spark.createDataFrame([(i, i % 6, [float(x) for x in rng.normal(size=4) + np.eye(6)[i % 6][:4]]) for i in range(120)], "id long, speaker long, v array<double>")
    trials = verify.score_trials(verify.trial_pairs(items, 400), items)
    rows = trials.collect()
    got = verify.trial_summary(trials).first()
    t, n = np.array([r.score for r in rows if r.same]), np.array([r.score for r in rows if not r.same])
    assert len(t) == len(n) == 200
    points = [*sorted(r.score for r in rows), max(r.score for r in rows) + 1]
    curve = [((t < p).mean(), (n >= p).mean(), p) for p in points]
    best = min(curve, key=lambda c: (round(abs(c[0] - c[1]), 12), c[2]))
    assert (got.eer, got.threshold) == pytest.approx(((best[0] + best[1]) / 2, best[2]))
    assert got.min_dcf == pytest.approx(min(0.01 * a + 0.99 * b for a, b, _ in curve) / 0.01)
    assert (got.mean_same, got.mean_different, got.separation) == pytest.approx((t.mean(), n.mean(), t.mean() - n.mean()))


def test_spectral_distance_equals_numpy(spark):
    rng = np.random.default_rng(8)
    a = {k: rng.normal(size=40) for k in range(3)}
    b = {k: x + 0.1 * rng.normal(size=40) for k, x in a.items()}
    frame = lambda data: spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "key long, n long, x double")
    resolutions = [(8, 4), (16, 8), (64, 16)]  # the last is longer than the series
    got = {r.key: r.distance for r in series.spectral_distance(frame(a), frame(b), resolutions).collect()}
    for key in a:
        total = 0.0
        for length, hop in resolutions[:2]:
            window = np.sqrt(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length))
            mags = [np.sqrt(np.maximum(np.abs(np.fft.rfft(np.array([x[s : s + length] * window for s in range(0, 40 - length + 1, hop)]))) ** 2, 1e-14)) for x in (a[key], b[key])]
            total += np.linalg.norm(mags[0] - mags[1]) / np.linalg.norm(mags[0]) + np.abs(np.log(mags[0]) - np.log(mags[1])).mean()
        assert got[key] == pytest.approx(total / 3, rel=1e-9)


def test_a_batch_that_is_killed_before_its_manifest_row_does_no_harm(spark, tmp_path):
    table, schema = str(tmp_path / "corpus"), "x long"
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], schema)
    seen = lambda: sorted(r.x for r in files.read_committed(spark, table, schema).collect())

    def die():
        raise RuntimeError("killed")

    assert files.commit_batch(rows(1, 2), table, "a")
    with pytest.raises(RuntimeError):
        files.commit_batch(rows(3), table, "b", die)
    assert (tmp_path / "corpus" / "data" / "batch=b").exists() and seen() == [1, 2]
    assert files.commit_batch(rows(4, 4), table, "b") and seen() == [1, 2, 4, 4]
    assert not files.commit_batch(rows(9), table, "a") and seen() == [1, 2, 4, 4]
    assert sorted(tuple(r) for r in files.committed(spark, table).collect()) == [("a", 2), ("b", 2)]


def test_a_stream_that_is_killed_between_data_and_manifest(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as x", "timestamp_seconds(1700000000 + id) as ts")
    sources.write_slices(rows, f"{tmp_path}/in", "x", 4)
    stream = lambda: sources.event_source(spark, f"{tmp_path}/in", rows.schema).select("x")
    calls = []

    def die():
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        sources.append_committed(stream(), f"{tmp_path}/out", f"{tmp_path}/c", die)
    assert files.read_committed(spark, f"{tmp_path}/out", "x long").count() == 20
    sources.append_committed(stream(), f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted(r.x for r in files.read_committed(spark, f"{tmp_path}/out", "x long").collect()) == list(range(40))


def test_an_artifact_of_another_corpus_is_refused(spark, tmp_path):
    from utterlake.operators import prep

    corpus = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "id long, t string")
    stamp = lambda df: prep.corpus_fingerprint(df, "id", "t").first()["fingerprint"]
    files.write_artifact(corpus.withColumn("label", F.col("id") % 2), str(tmp_path / "a"), stamp(corpus))
    assert files.read_artifact(spark, str(tmp_path / "a"), stamp(corpus)).count() == 500
    changed = corpus.withColumn("t", F.when(F.col("id") == 4, "changed").otherwise(F.col("t")))
    with pytest.raises(ValueError, match="fingerprint"):
        files.read_artifact(spark, str(tmp_path / "a"), stamp(changed))


def log(folder, session, lines, half=""):
    folder = folder / f"session={session}"
    folder.mkdir(parents=True, exist_ok=True)
    with (folder / "log.json").open("a") as file:
        file.write("".join(f'{{"seq": {n}, "us": {1_700_000_000_000_000 + n}, "p": 0.5}}\n' for n in lines) + half)


def test_session_logs_grow_and_are_read_once(spark, tmp_path):
    def run():
        query = session_logs.session_frames(spark, str(tmp_path / "in"), 100).writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(str(tmp_path / "out"))
        query.processAllAvailable()
        return query

    log(tmp_path / "in", 1, range(30))
    log(tmp_path / "in", 2, range(5), half='{"seq": 5, ')
    query = run()
    log(tmp_path / "in", 1, range(30, 40))
    with (tmp_path / "in" / "session=2" / "log.json").open("a") as file:
        file.write('"us": 1700000000000005, "p": 0.5}\n')
    query.processAllAvailable()
    query.stop()
    log(tmp_path / "in", 3, range(2))
    run().stop()  # goes on where the first run was
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.session, r.seq) for r in got.collect()) == [(1, n) for n in range(40)] + [(2, n) for n in range(6)] + [(3, 0), (3, 1)]
    assert got.where("unix_micros(ts) <> 1700000000000000 + seq").count() == 0


def test_stretches_of_a_log_hold_each_line_once(tmp_path):
    log(tmp_path, 7, range(50))
    for step in (1, 7, 45, 46, 1000):
        reader = session_logs.SessionReader(str(tmp_path), step)
        end = reader.latestOffset()
        assert [r[1] for part in reader.partitions({}, end) for r in reader.read(part)] == list(range(50))


@pytest.mark.parametrize("chunk,most", [(32, 32), (40, 7), (1000, 32), (5, 5)])
def test_batches_of_chunks_are_those_of_one_pass(spark, chunk, most):
    rng = random.Random(chunk)
    rows = [(i, rng.choice([0.01, 1.0, 3.0, 50.0, 119.0, 500.0]) * rng.random()) for i in range(700)]
    got = batching.length_batches(spark.createDataFrame(rows, "id long, duration double"), "id", 12_000, most, chunk)
    want, count, number = {}, 0, 0
    for i, frames in sorted(((i, int(d * 100)) for i, d in rows), key=lambda r: (r[1], r[0])):
        if count and (frames * (count + 1) > 12_000 or count >= most):
            count, number = 0, number + 1
        count += 1
        want[i] = number
    assert {r.id: r.batch for r in got.collect()} == want
    assert batching.length_batches(spark.createDataFrame([], "id long, duration double"), "id").count() == 0


def test_settings_are_bounded_and_lists_keep_their_order(spark):
    few = spark.range(3).withColumnRenamed("id", "a")
    assert prep.bench_matrix(spark.range(5), few, few.withColumnRenamed("a", "b")).count() == 45
    with pytest.raises(ValueError, match="settings"):
        prep.bench_matrix(spark.range(5), few, few.withColumnRenamed("a", "b"), most=8)
    both = prep.union_lists(spark.createDataFrame([(2, "b"), (1, "a")], "at long, t string"), spark.createDataFrame([(9, "a"), (8, "c")], "at long, t string"), ["at"])
    assert [r.t for r in both.orderBy("idx").collect()] == ["a", "b", "c", "a"]


def test_predicate_on_durations_reaches_the_files(spark):
    from utterlake.plans import registry

    plan = registry.QUERIES["duration_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_chars,450)" in plan
