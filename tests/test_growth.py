"""What must not grow faster than its input: joins that a planner may take for small ones, single tasks, repeated work."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake import tables
from utterlake.functions import text as tx
from utterlake.operators import coverage, prep, series, verify
from utterlake.plans import q_streams, registry
from utterlake.sources import files as wave_files
from utterlake.streaming import session_logs, sources


def _regridded(x, rate):
    out = int(np.rint(len(x) / rate))
    at = np.arange(out) * ((len(x) - 1) / (out - 1)) if out > 1 else np.zeros(out)
    return np.interp(at, np.arange(len(x)), x)


def _walks(sizes):
    rng = random.Random(5)
    return {k: [rng.gauss(0, 1) for _ in range(n)] for k, n in enumerate(sizes)}


def test_speed_series_joins_no_samples(spark):
    own = _walks([1, 2, 3, 64, 97])
    samples = spark.createDataFrame([(k, n, v) for k, x in own.items() for n, v in enumerate(x)], "key long, n long, x double")
    items = spark.createDataFrame([(k, k % 2) for k in own], "key long, speaker long")
    found = prep.speed_series(samples, items)
    got = {(r.key, r.speed_id, r.n): r.x for r in found.collect()}
    want = {(k, s, i): v for k, x in own.items() for s, rate in enumerate((0.9, 1.0, 1.1)) for i, v in enumerate(_regridded(x, rate).tolist())}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert found.selectExpr("max(class_id)").first()[0] == 5
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 4  # only those of the classes


@pytest.mark.parametrize("rate", [0.3, 0.9, 1.1, 2.7, 40.0])
def test_linear_regrid_without_a_join(spark, rate):
    own = _walks([1, 2, 5, 64, 200])
    samples = spark.createDataFrame([(k, n, v) for k, x in own.items() for n, v in enumerate(x)] + [(None, 0, 1.0)], "key long, n long, x double")
    found = series.linear_regrid(samples, rate)
    got = {(r.key, r.n): r.x for r in found.collect()}
    want = {(k, i): v for k, x in own.items() for i, v in enumerate(_regridded(x, rate).tolist())}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_regrids_sort_no_more_rows_a_task_than_they_should(spark, monkeypatch):
    own = _walks([20 + k % 7 for k in range(60)])
    samples = spark.createDataFrame([(k, n, v) for k, x in own.items() for n, v in enumerate(x)], "key long, n long, x double")
    monkeypatch.setattr(tables.dealt, "__defaults__", (64,))
    found = series.regrids(samples, (0.9, 1.1))
    assert found.rdd.getNumPartitions() >= samples.count() // 64 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.key, r.rate_id, r.n): r.x for r in found.collect()}
    want = {(k, s, i): v for k, x in own.items() for s, rate in enumerate((0.9, 1.1)) for i, v in enumerate(_regridded(x, rate).tolist())}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def _odd_items(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 3 else rng.randrange(3), [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(200, 1, None), (201, 1, [1.0, None] + [0.0] * 6), (202, 2, [0.0] * 8), (203, 0, [1.0] * 5), (204, 0, [2.0] * 5), (205, 1, [float("nan")] * 8), (206, 1, [1.0] + [0.0] * 7), (207, 1, [0.0000005, 1.0] + [0.0] * 6), (208, 1, [1e-200] * 8)]
    return spark.createDataFrame(rows, "id long, speaker long, v array<double>")


@pytest.mark.parametrize("digits", [1, 6])
def test_counts_of_all_pairs_equal_single_scores(spark, digits):
    items = _odd_items(spark)
    want = verify.score_trials(verify.all_pairs(items), items).withColumn("score", F.round("score", digits))
    got = verify.all_pair_counts(items, digits)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.groupBy("same", "score").agg(F.count("*").alias("n")).collect()))


@pytest.mark.parametrize("name", ["det_curve", "det_curve_ranged", "eer", "min_dcf", "trial_summary"])
def test_summaries_of_all_pairs_make_no_row_a_pair(spark, name, monkeypatch):
    def refuse(*_):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(verify, "score_trials", refuse)
    monkeypatch.setattr(verify, "all_pairs", refuse)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_length_of_a_vector_is_summed_once(spark):
    items = _odd_items(spark)
    found = items.select("v", verify.unit(F.col("v")).alias("u"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    for v, u in found.collect():
        if v is None or None in v:
            assert u == v
        else:
            size = sum(x * x for x in v) ** 0.5
            assert u == pytest.approx([x / (size if size > 0 or size != size else 1.0) for x in v], nan_ok=True)


@pytest.mark.parametrize("digits", [1, 6])
def test_scores_of_all_pairs_equal_single_scores(spark, digits):
    items = _odd_items(spark)
    want = verify.score_trials(verify.all_pairs(items), items).withColumn("score", F.round("score", digits))
    got = verify.all_pair_scores(items, digits)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("digits,block,tile", [(1, 16, 100), (6, 16, 1000), (6, 50, 1 << 24)])
def test_scores_come_in_tiles_of_blocks_of_ids(spark, digits, block, tile):
    items = _odd_items(spark).union(spark.createDataFrame([(None, 1, [1.0] * 8), (5, 2, [0.5] * 8), (-(2**60), 2, [0.25] * 8), (2**60 + 1, 1, [2.0] * 8)], "id long, speaker long, v array<double>"))
    u = items.withColumn("v", verify.unit(F.col("v")))
    want = u.alias("x").join(u.alias("y"), F.expr("x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr("cast(x.speaker = y.speaker as long)").alias("same"), F.round(verify.dot(F.col("x.v"), F.col("y.v")), digits).alias("score"))
    got = verify.all_pair_scores(items, digits, block, tile)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 5 and max(r["count"] for r in tasks) <= (1.25 * block + 2) ** 2


def test_scores_of_all_pairs_take_little_room(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(int(i) * 31, int(i) % 10, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 64)))], "id long, speaker long, v array<double>")
    verify.all_pair_scores(rows).write.parquet(f"{tmp_path}/scores")
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 3000 * 2999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "scores").glob("*.parquet")) < 6 * 3000 * 2999 // 2  # 8 bytes are a score alone


def test_logs_of_many_sessions_are_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_streams, "shared_folder", lambda _, name: f"{tmp_path}/{name}")
    found = registry.QUERIES["session_source"](spark, "/root/testdata/sf0.01")
    sessions = found.select("session").distinct().count()
    assert found.count() == 10_000 and len(list((tmp_path / "sessions" / "in").rglob("part-*"))) < 10 < sessions


def test_lines_outside_a_folder_name_their_session(tmp_path):
    line = '{{"session": {}, "seq": {}, "us": 1700000000000000, "p": 0.5}}\n'
    (tmp_path / "many.json").write_text("".join(line.format(n % 3, n) for n in range(30)) + '{"session": 9, ')
    (tmp_path / "session=7").mkdir()
    (tmp_path / "session=7" / "own.json").write_text('{"seq": 1, "us": 1700000000000000, "p": 0.5}\n')
    for step in (1, 50, 1000):
        reader = session_logs.SessionReader(str(tmp_path), step)
        rows = [r[:2] for part in reader.partitions({}, reader.latestOffset()) for r in reader.read(part)]
        assert sorted(rows) == sorted([(n % 3, n) for n in range(30)] + [(7, 1)])


def test_samples_of_wave_blocks_stay_in_their_task(spark):
    """A file is made of samples that are sent once, and its blocks come back as their measures, many to a batch."""
    rng = random.Random(8)
    rows = [(f"w{i}", [rng.uniform(-1.2, 1.2) for _ in range(rng.choice([1, 7, 64]))], rng.randrange(1, 40)) for i in range(90)] + [("none", [], 3)]
    waves = wave_files.with_wave(spark.createDataFrame(rows, "path string, samples array<double>, times int"))
    whole = wave_files.with_wave(spark.createDataFrame([(p, x * n) for p, x, n in rows], "path string, samples array<double>"))
    assert sorted(map(repr, waves.collect())) == sorted(map(repr, whole.collect()))
    got = {(r.path, r.block): (r.n, r.total) for r in wave_files.decode_blocks(waves, 100, {"n": len, "total": np.sum}).collect()}
    want = {(r.path, r.block): (len(r.samples), sum(r.samples)) for r in wave_files.decode_blocks(whole, 100).collect()}
    assert got == want and sum(n for n, _ in got.values()) == sum(len(x) * n for _, x, n in rows)
    plan = registry.QUERIES["decode_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan and "aggregate(" not in plan


@pytest.mark.parametrize("tile,together", [(1024, 4), (16, 2), (7, 1)])
def test_all_pairs_in_tiles_are_each_there_once(spark, tile, together, tmp_path):
    items = _odd_items(spark).union(spark.createDataFrame([(None, 1, None), (5, 2, None)], "id long, speaker long, v array<double>"))
    want = items.alias("x").join(items.alias("y"), F.expr("x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr("cast(x.speaker = y.speaker as long)").alias("same"))
    assert sorted(map(repr, verify.all_pairs(items, tile, together).collect())) == sorted(map(repr, want.collect()))
    assert verify.all_pairs(items.limit(0)).count() == 0


def test_all_pairs_take_little_room(spark, tmp_path):
    items = spark.range(0, 4000).selectExpr("id * 7919 as id", "id % 13 as speaker")
    verify.all_pairs(items, 256).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 4000 * 3999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4000 * 3999 // 2 // 2  # half a byte a pair


def test_all_pairs_in_small_tiles_are_made_by_many_tasks(spark, tmp_path):
    items = spark.range(6000).selectExpr("id * 7919 as id", "id % 13 as speaker")
    found = verify.all_pairs(items)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == plan.count("RepartitionByExpression [id#") == 2  # what repeats an item is no single task
    found.write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 6000 * 5999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6000 * 5999 // 2 // 4  # a quarter of a byte a pair
    few = verify.all_pairs(items.limit(300), 16, 2, most=5)
    assert few.rdd.getNumPartitions() == 5 and few.distinct().count() == few.count() == 300 * 299 // 2


def test_slices_of_several_files_are_a_batch_each(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").alias("x"), (F.col("id") % 7).alias("key")).repartition(3)
    files = sources.write_slices(rows, f"{tmp_path}/in", "x", 3, file_rows=500)
    assert files == len(list((tmp_path / "in").glob("*.parquet"))) // 3 > 1
    stream = sources.event_source(spark, f"{tmp_path}/in", rows.schema, files)
    sources.append_batches(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    found = spark.read.parquet(f"{tmp_path}/out").groupBy("batch").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy("batch").collect()
    assert len(found) == 3 and sum(r.n for r in found) == 6000
    assert [r.high + 1 for r in found[:2]] == [r.low for r in found[1:]] and found[0].low == 0 and found[2].high == 5999


@pytest.mark.parametrize("top", [1, 3, 200])
def test_greedy_coverage_makes_its_candidates_once(spark, top):
    rng = random.Random(8)
    texts = {i: "".join(rng.choice("abc ") for _ in range(rng.randrange(3, 30))) for i in range(60)}
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    pool = spark.createDataFrame(list(texts.items()), "idx long, norm string").mapInArrow(count, "idx long, norm string")
    grams = {r.idx: sorted(r.g) for r in spark.createDataFrame(list(texts.items()), "idx long, norm string").select("idx", tx.char_ngrams(F.col("norm"), 3).alias("g")).collect() if r.g}
    seen = {"aaa": 5, "bca": 2}
    want, now = [], dict(seen)
    while len(want) < 12:
        score = {i: sum(1.0 / (1 + now.get(g, 0)) for g in own) / len(texts[i]) ** 0.5 for i, own in grams.items() if i not in want}
        want.append(min(score, key=lambda i: (-score[i], i)))
        for g in grams[want[-1]]:
            now[g] = now.get(g, 0) + 1
    got = coverage.greedy_coverage(pool, 12, seen=spark.createDataFrame(list(seen.items()), "gram string, n long"), top=top)
    assert got == want and made.value == len(texts)
