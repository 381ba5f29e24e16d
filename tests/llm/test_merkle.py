"""The Merkle manifest against plain trees and its statement."""

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from utterlake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(level):
    """The root of a list of digests and each one's siblings, level by level, as (before, after)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for path, k in zip(paths, at, strict=True):
            run = k // 3 * 3
            path.append(("".join(level[run:k]), "".join(level[k + 1 : run + 3])))
        level, at = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)], [k // 3 for k in at]
    return level[0], paths


def brute(rows):
    leaves = defaultdict(list)
    for i, text, lang, source, n in rows:
        digest = lambda t: sha(part(i), part(source), part(lang), part(n), part(t))  # noqa: B023, E731
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        leaves[source].append((i, digest(text), digest(text and text.replace("\n", "")) if even else None))
    subs, out = [], []
    for source in sorted(leaves, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(leaves[source], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs.append((mine, *climb([x[1] for x in mine])))
    root, tops = climb([s[1] for s in subs]) if subs else (None, [])
    for (mine, sub, paths), top in zip(subs, tops, strict=True):
        for (i, leaf, other), path in zip(mine, paths, strict=True):
            now = other or leaf
            for left, right in path + top:
                now = sha(left, now, right)
            out.append((i, leaf, sub, root, sha(*[x + y for x, y in path + top]), now, now == root))
    return sorted(out, key=str)


def manifest(docs):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.merkle_manifest(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("")), even)


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        rows += [(rng.randrange(10**6), rng.choice(["a\nb", "", None, "plain", "é\n"]), rng.choice([None, "en", ""]), source, rng.choice([None, 5])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


MANY = {None: 10, "": 3, "a:b": 40, "big": 100, "-": 4, "1:": 1, **{f"t{i}": 1 + i % 4 for i in range(11)}}


@pytest.mark.parametrize("levels,sizes", [(6, {"s": 1}), (6, {"s": 30}), (6, {"s": 1, None: 1, "": 1, "é": 1, "z": 9}), (1, MANY), (2, MANY)])
def test_trees_equal_plain_ones(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = rows_of(sizes)
    got = manifest(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == COLUMNS and sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_odd_rows(spark):
    """Repeated rows, a NULL doc_id, a very long text, further columns with clashing names, no rows."""
    rows = [(1, "a\n", "en", "s", 2)] * 4 + [(None, "x\n", None, "s", None), (None, None, None, None, None), (2, "y\n" * 300_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tampered": F.lit(1), "leaf": F.lit("x"), "pos": F.lit(2), "TREE": F.lit(None).cast("string"), "segment": F.lit(0)})
    assert sorted([tuple(r) for r in manifest(docs).collect()], key=str) == brute(rows)
    empty = manifest(spark.createDataFrame([], SCHEMA))
    assert empty.columns == COLUMNS and empty.count() == 0
    assert all(r.verified for r in merkle.merkle_manifest(docs).collect())


def test_query_equals_statement(spark):
    duck = duckdb.connect()
    for path in Path(DATA).glob("documents.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = merkle.op12_merkle_manifest(spark, DATA)
    want = duck.execute(merkle.ORACLE_SQL)
    assert [c[0] for c in want.description] == got.columns == COLUMNS
    want = sorted(want.fetchall())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(tuple(r) for r in got.collect()) == want == sorted(brute([tuple(r) for r in docs.collect()]))
    assert 0 < sum(r[-1] for r in want) < len(want)
