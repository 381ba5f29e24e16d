"""Every registered query with a statement against DuckDB on the smallest tables; edge cases of single operators."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from utterlake.operators import endpoint, gates, prep, scoring, verify
from utterlake.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert columns == sorted(names) and got == want


def test_rows_only_queries_run(spark):
    for name in registry.QUERIES.keys() - registry.ORACLE_SQL.keys():
        assert registry.QUERIES[name](spark, DATA).count() > 0, name


def test_gate_equals_state_machine(spark):
    rng = __import__("random").Random(1)
    rows = [(k, i, rng.random()) for k in range(40) for i in range(60)]
    got = {(r.key, r.seq): r.active for r in gates.hysteresis_gate(spark.createDataFrame(rows, "key long, seq long, p double"), 0.6, 0.4, 2, 3).collect()}
    for k in range(40):
        active, up, down = False, 0, 0
        for _, i, p in rows[60 * k : 60 * k + 60]:
            if active:
                down = down + 1 if p < 0.4 else 0
                if down >= 3:
                    active, down = False, 0
            else:
                up = up + 1 if p > 0.6 else 0
                if up >= 2:
                    active, up = True, 0
            assert got[k, i] == active
    with pytest.raises(ValueError):
        gates.hysteresis_gate(spark.range(1), 0.4, 0.6)


@pytest.mark.parametrize("files", [1, 3, 17])
def test_endpoint_stream_equals_batch(spark, tmp_path, files):
    rng = __import__("random").Random(files)
    rules = endpoint.EndpointRules(start=2, end=2, pre_roll=2, cap=8, least=6)
    rows = pd.DataFrame([(k, i, rng.random()) for k in range(5) for i in range(51)], columns=["key", "seq", "p"])
    want = {tuple(r) for r in endpoint.endpoints(spark.createDataFrame(rows), rules).collect()}
    for n in range(files):
        part = rows[(rows["seq"] * files // 51) == n]
        spark.createDataFrame(part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, seq long, p double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = stream.groupBy("key").applyInPandasWithState(endpoint.stateful(rules), endpoint.EVENTS, endpoint.STATE, "append", "NoTimeout")
    query = found.writeStream.format("memory").queryName(f"endpoints{files}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table(f"endpoints{files}").collect()} == want


def test_endpoint_rules_of_the_defaults():
    rules = endpoint.EndpointRules.from_ms()
    assert (rules.start, rules.end, rules.pre_roll) == (3, 22, 10)
    rows = pd.DataFrame({"seq": range(60), "p": [0.0] * 10 + [0.9] * 20 + [0.0] * 30})
    events, _ = endpoint.run_steps(rows, endpoint.START, rules)
    assert [e[0] for e in events] == ["START", "END"]
    assert events[1][3] == 10 + 20 + 3


def test_trials_are_balanced_and_unique(spark):
    items = spark.createDataFrame([(10 * s + i, s) for s in range(10) for i in range(10)], "id long, speaker long")
    rows = verify.trial_pairs(items, 100).collect()
    assert sum(r.same for r in rows) == 50 == sum(1 - r.same for r in rows)
    assert len({(r.a, r.b) for r in rows}) == 100 and all(r.a < r.b for r in rows)
    every = verify.trial_pairs(items, 100_000).collect()  # more than there are: all pairs of one speaker
    assert sum(r.same for r in every) == 10 * 45 == sum(1 - r.same for r in every)
    assert len({(r.a, r.b) for r in every}) == 900
    with pytest.raises(ValueError):
        verify.trial_pairs(items.where("speaker = 1"), 10)


def test_failed_checks_stop_the_job(spark):
    report = spark.createDataFrame([("a", True, "0"), ("b", False, "3")], "check string, ok boolean, detail string")
    with pytest.raises(ValueError, match="b: 3"):
        prep.require_valid(report)
    assert prep.require_valid(report.where("ok")).count() == 1


def test_rates_of_separable_scores(spark):
    rows = [(i, i + 1000, int(i % 2), (0.8 if i % 2 else 0.1) + i / 10000) for i in range(200)]
    s = verify.trial_summary(spark.createDataFrame(rows, "a long, b long, same long, score double")).first()
    assert s.eer == 0 and s.min_dcf == 0 and s.separation > 0.5


def test_word_errors(spark):
    rows = spark.createDataFrame([("the cat", "the cat sat"), ("", "a b"), ("a b c", ""), ("", "")], "hyp string, ref string")
    assert [r.word_errors for r in scoring.with_errors(rows).collect()] == [1, 2, 3, 0]


def test_log_sum_exp_without_overflow(spark):
    rows = spark.createDataFrame([(1, 1000.0), (1, 1000.0), (2, float("-inf"))], "k long, x double")
    got = {r.k: r.lse for r in scoring.log_sum_exp(rows, "k", "x").collect()}
    assert got[1] == pytest.approx(1000 + math.log(2)) and got[2] == float("-inf")


def test_empty_frames(spark):
    none = spark.createDataFrame([], "key long, seq long, p double, label long")
    assert gates.segments(gates.hysteresis_gate(none)).count() == 0
    assert gates.collapse_runs(none).count() == 0
    assert none.select(F.lit(1)).count() == 0
