"""Text column functions: normalisation, splitting, n-grams, edit-distance ratios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET = " abcdefghijklmnopqrstuvwxyz"
BLANK = 0


def normalize(text: Column) -> Column:
    """Lower case, everything but a-z, apostrophe and space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z' ]+", " "), " +", " "))


def words(text: Column) -> Column:
    """The words of a normalised text; none of an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def char_encode(text: Column) -> Column:
    """Space and a-z as 1 to 27; other characters are dropped."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: (c != "") & (F.instr(F.lit(ALPHABET), c) > 0))
    return F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c).cast("long"))


def char_decode(ids: Column) -> Column:
    """The text of ids 1 to 27; other ids are dropped."""
    known = F.filter(ids, lambda i: (i >= 1) & (i <= len(ALPHABET)))
    return F.array_join(F.transform(known, lambda i: F.substring(F.lit(ALPHABET), i.cast("int"), F.lit(1))), "")


def sentences(text: Column) -> Column:
    """Pieces between white space that follows one of . ! ? ; : , trimmed, without empty ones."""
    pieces = F.transform(F.split(text, r"(?<=[.!?;:])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def char_ngrams(normalized: Column, n: int = 3) -> Column:
    """The set of length-n substrings of the text with a space before and after it."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
    return F.when(F.length(padded) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def strip_punct(text: Column, characters: str = " .,!?") -> Column:
    return F.btrim(F.lower(text), F.lit(characters))


def cer(hyp: Column, ref: Column) -> Column:
    """Edit distance in characters over the reference's length (at least 1)."""
    return F.levenshtein(hyp, ref) / F.greatest(F.lit(1), F.length(ref))


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and substitutions from one list to another. A column of the table is two bit vectors of its
    steps up and down, so that each element of ``b`` costs a few operations on whole numbers of len(a) bits."""
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for y in b:
        match = where.get(y, 0)
        level = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(level | up) & full, up & level
        distance += (1 if rise & top else 0) - (1 if fall & top else 0)
        rise = (rise << 1 | 1) & full
        up, down = (fall << 1 | ~(level | rise)) & full, rise & level
    return distance


@F.pandas_udf(T.LongType())
def word_errors(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Edit distance in words of two normalised texts, of any number of words; NULL if one is."""
    split = lambda text: [w for w in text.split(" ") if w]
    return pd.Series([None if h is None or r is None else edit_distance(split(h), split(r)) for h, r in zip(hyp, ref, strict=True)], dtype="Int64")


def wer(hyp: Column, ref: Column) -> Column:
    return word_errors(hyp, ref) / F.greatest(F.lit(1), F.size(words(ref)))
