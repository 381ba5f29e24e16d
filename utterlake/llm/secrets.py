"""Secret scan by patterns and by character Markov models, in DataFrame functions only.

Three patterns give the base spans. Two first-order Markov models over the characters of tokens, one of random strings
and one of ordinary identifiers, add spans: long tokens whose log-likelihood ratio per step speaks for random strings.
Both are trained on labelled samples taken from the corpus itself: the values that the patterns found are random
strings, long all-letter words are ordinary. The models are two tables of at most 68 x 68 entries, so they reach the
tasks as literals.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import let, materialize

# The base patterns, in the order of their kinds.
KINDS = ["assign", "access", "hex"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the models score, and the characters that they know besides begin and end.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: How much of each model comes from its samples, by whether it is the model of random strings.
_TRUST = {True: 0.5, False: 0.98}
_SPANS = "array<struct<from:int,to:int,text:string>>"
_BLOCK = 256
_FAR = 2**31 - 1


def before_each(values: Column, zero: int, join) -> Column:
    """What ``join`` (associative, of two integers) makes of all values before each one, from ``zero``. The array is
    cut into blocks, so the work for n values grows as n times the square root of n and not as its square."""
    listed = lambda acc, x: F.struct(join(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
    scan = lambda array: F.aggregate(array, F.struct(F.lit(zero).alias("now"), F.array().cast("array<int>").alias("out")), listed)
    shifted = lambda b, first: F.transform(b["out"], lambda x: join(first, x))
    merged = lambda blocks: F.flatten(F.zip_with(blocks, scan(F.transform(blocks, lambda b: b["now"]))["out"], shifted))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda i: scan(F.slice(v, i * _BLOCK + 1, F.lit(_BLOCK))))
    return let(values, lambda v: F.when(F.size(v) <= _BLOCK, scan(v)["out"]).otherwise(let(cut(v), merged)))


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern as structs (from, to, text), in code points: the text is
    split at the matches, and the lengths of pieces and matches are added up."""
    sizes = lambda piece, m: F.struct(F.char_length(piece).alias("gap"), F.char_length(m).alias("size"), m.alias("m"))
    steps = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), sizes), lambda x: x["m"].isNotNull())
    starts = lambda s: before_each(F.transform(s, lambda x: x["gap"] + x["size"]), 0, lambda x, y: x + y)
    span = lambda x, at: F.struct((at + x["gap"]).alias("from"), (at + x["gap"] + x["size"]).alias("to"), x["m"].alias("text"))
    return F.when(text.rlike(pattern), let(steps, lambda s: F.zip_with(s, starts(s), span))).otherwise(F.array().cast(_SPANS))


def apart(spans: Column, taken: Column) -> Column:
    """The spans that overlap no taken one: all are put in order; a span must begin at or after the largest end of the
    taken ones before it, and end at or before the smallest begin of those after it."""
    mark = lambda is_taken: lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), F.lit(is_taken).alias("taken"), x["text"].alias("text"))
    ends = lambda v: before_each(F.transform(v, lambda x: F.when(x["taken"], x["to"]).otherwise(-1)), -1, F.greatest)
    begins = lambda v: F.reverse(before_each(F.reverse(F.transform(v, lambda x: F.when(x["taken"], x["from"]).otherwise(_FAR))), _FAR, F.least))
    near = lambda v: F.zip_with(ends(v), begins(v), lambda end, begin: F.struct(end.alias("end"), begin.alias("begin")))
    free = lambda x, n: F.when(~x["taken"] & (n["end"] <= x["from"]) & (n["begin"] >= x["to"]), F.struct(x["from"], x["to"], x["text"]))
    kept = let(F.array_sort(F.concat(F.transform(taken, mark(True)), F.transform(spans, mark(False)))), lambda v: F.filter(F.zip_with(v, near(v), free), lambda x: x.isNotNull()))
    return F.when(F.size(taken) > 0, kept).otherwise(spans)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind that satisfy its length rule."""
    value = lambda s: F.regexp_extract(s["text"], ASSIGN, 2)
    return {
        "assign": F.filter(located(text, ASSIGN), lambda s: F.char_length(value(s)) >= 6),
        "access": F.filter(located(text, ACCESS), lambda s: s["to"] - s["from"] >= 20),
        "hex": located(text, HEX),
    }


def _steps(token: Column) -> Column:
    """The transitions of a token as texts of two characters; ^ stands before the first and $ after the last."""
    marked = F.concat(F.lit("^"), token, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.char_length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2)))


def train_models(scanned: DataFrame) -> dict[str, float]:
    """The log-likelihood ratio of each transition: random strings over ordinary identifiers.

    Random strings come in many alphabets, so their model is half its samples and half an even spread over all
    characters; of the ordinary model a fiftieth is.
    ``scanned`` has random (array of labelled random strings) and plain (array of labelled ordinary tokens).
    Each class counts all its samples over the whole table; the counts are combined map-side.
    """
    sides = [scanned.select(F.explode(c).alias("token")).select(F.explode(_steps(F.col("token"))).alias("step")).groupBy("step").agg(F.count("*").alias("n")).withColumn("random", F.lit(c == "random")) for c in ("random", "plain")]
    counts: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for row in sides[0].unionByName(sides[1]).where(F.col("step").rlike(r"^[\^A-Za-z0-9+/_=-][A-Za-z0-9+/_=$-]$")).collect():  # at most 2 * 67 * 67 rows
        counts[row["random"]][row["step"]] = row["n"]
    ratio, even = {}, 1 / (len(_ALPHABET) + 1)
    single = {k: {b: sum(n for step, n in counts[k].items() if step[1] == b) for b in _ALPHABET + "$"} for k in counts}
    size = {k: sum(single[k].values()) for k in counts}
    for a in "^" + _ALPHABET:
        total = {k: sum(counts[k].get(a + b, 0) for b in _ALPHABET + "$") for k in counts}
        for b in _ALPHABET + "$":
            # After a character that no sample has, the single characters count; without samples, all alike.
            own = {k: counts[k].get(a + b, 0) / total[k] if total[k] else single[k][b] / size[k] if size[k] else even for k in counts}
            p = {k: share * own[k] + (1 - share) * even for k, share in _TRUST.items()}
            ratio[a + b] = math.log(p[True] / p[False])
    return ratio


def _table(values: list[float | int], kind: str) -> Column:
    """An array constant; as JSON it is one expression, which Spark folds, however many values it has."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def random_spans(candidates: Column, ratio: dict[str, float], least: float) -> Column:
    """Candidate tokens with a mean ratio of ``least`` or more per transition, and letters and digits both. The ratios
    are looked up by the places of the two characters in the alphabet."""
    marks = "^" + _ALPHABET + "$"
    place = _table([marks.find(chr(code)) for code in range(128)], "int")
    table = _table([ratio.get(a + b, 0.0) for a in marks for b in marks], "double")
    code = lambda marked, i: F.get(place, F.ascii(F.substring(marked, i, F.lit(1))))

    def mean(token: Column) -> Column:
        total = lambda marked: F.aggregate(F.sequence(F.lit(1), F.char_length(marked) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, code(marked, i) * len(marks) + code(marked, i + 1)))
        return let(F.concat(F.lit("^"), token, F.lit("$")), total) / (F.char_length(token) + 1)

    mixed = lambda token: token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return F.filter(candidates, lambda s: mixed(s["text"]) & (mean(s["text"]) >= least))


def _listed(spans: Column) -> Column:
    """Spans (at, rank, kind, to) in order as kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["to"].cast("string"))), ",")


def _as_kind(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["from"].alias("at"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["to"].alias("to")))


def find_secrets(docs: DataFrame, least: float = 1.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans of each row, spans as comma-joined kind:start:end.

    NULL and empty texts have no spans; repeated and NULL doc_ids are carried as they are; other columns are not read;
    an empty table gives an empty result. Of spans that begin together the kind listed first comes first. A text of any
    length and number of matches is one row, whose spans are found in nearly linear time.
    Added spans have the kind markov, which comes after the base kinds. Without any labelled sample the models are
    equal and add nothing.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    found = rows.select("doc_id", "text", *[v.alias(k) for k, v in base_spans(F.col("text")).items()])
    # No text goes on: only the spans, the candidates and the samples of ordinary text, its longest words.
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z_]{16,}"), F.lit(0))
    found = materialize(found.select("doc_id", *KINDS, words.alias("plain"), located(F.col("text"), CANDIDATE).alias("candidates")), "secret-spans")
    values = F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["text"], ASSIGN, 2)), F.transform("access", lambda s: s["text"]), F.transform("hex", lambda s: s["text"])
    )
    ratio = train_models(found.select(F.filter(values, lambda v: F.char_length(v) >= 16).alias("random"), "plain"))
    taken = F.concat("assign", "access", "hex")
    added = random_spans(apart(F.col("candidates"), taken), ratio, least)
    base = F.concat(*[_as_kind(F.col(k), k, i) for i, k in enumerate(KINDS)])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], _listed(base).alias("base_spans"), _listed(F.concat(base, _as_kind(added, "markov", len(KINDS)))).alias("spans")
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
