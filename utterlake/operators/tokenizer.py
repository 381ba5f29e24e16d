"""Byte-pair tokenizer of a corpus: Spark counts words and pairs, a table of merges is the model."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import written

MARK = "▁"
#: Ids 0 to 2: padding, start and end, unknown.
SPECIAL, UNKNOWN = 3, 2


def word_symbols(texts: DataFrame) -> DataFrame:
    """word, symbols (characters), n of the different words of ``norm``, each with the mark before it."""
    counts = texts.select(F.explode(tx.words(F.col("norm"))).alias("w")).groupBy(F.concat(F.lit(MARK), "w").alias("word")).agg(F.count("*").alias("n"))
    return counts.select("word", F.filter(F.split("word", ""), lambda c: c != "").alias("symbols"), "n")


def _merge(symbols: Column, left: str, right: str) -> Column:
    """The symbols with every pair (left, right) joined, from left to right."""
    start = F.array().cast("array<string>")
    joins = lambda acc, x: (F.size(acc) > 0) & (x == right) & (F.try_element_at(acc, F.lit(-1)) == left)
    # A joined pair is left + right, which is never equal to left again, so it takes no part in a further join.
    step = lambda acc, x: F.when(joins(acc, x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(left + right)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(symbols, start, step)


def bpe_train(texts: DataFrame, merges: int, min_freq: int = 2, ahead: int = 64, every: int = 4) -> list[tuple[str, str]]:
    """The first ``merges`` merges: each time the most frequent adjacent pair, ties to the smaller left, then right.

    A pass takes the ``ahead`` most frequent pairs and merges the top ones at once while no two share a symbol and each
    is strictly more frequent than the next: later pairs cannot overtake them, so the result is that of one at a time.
    Only different words are kept, and the driver sees ``ahead`` pairs a pass; lineage is cut every few passes.
    """
    words, found, turn = written(word_symbols(texts).select("symbols", "n"), "bpe-words"), [], 0
    while len(found) < merges:
        pairs = F.arrays_zip(F.slice("symbols", 1, F.size("symbols") - 1).alias("left"), F.slice("symbols", 2, F.size("symbols") - 1).alias("right"))
        counts = words.where(F.size("symbols") > 1).select("n", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n")).where(F.col("n") >= min_freq)
        top = counts.orderBy(F.desc("n"), "left", "right").limit(ahead).collect()
        if not top:
            break
        used: set[str] = set()
        for i, row in enumerate(top):
            fits = not {row["left"], row["right"]} & used and (i + 1 == len(top) or row["n"] > top[i + 1]["n"])
            if i and (not fits or i + 1 == len(top)) or len(found) == merges:
                break
            found.append((row["left"], row["right"]))
            used |= {row["left"], row["right"], row["left"] + row["right"]}
            words = words.withColumn("symbols", _merge(F.col("symbols"), row["left"], row["right"]))
            if not fits:
                break
        turn += 1
        words = written(words, "bpe-words") if turn % every == 0 or len(used) > 9 else words
    return found


def vocabulary(texts: DataFrame, merges: list[tuple[str, str]]) -> dict[str, int]:
    """Ids of the alphabet, in order, then of the merges; bounded by the alphabet and the number of merges."""
    letters = [r["c"] for r in word_symbols(texts).select(F.explode("symbols").alias("c")).distinct().orderBy("c").collect()]
    tokens = dict.fromkeys([*letters, *(a + b for a, b in merges)])
    return {token: SPECIAL + i for i, token in enumerate(tokens)}


def apply_merges(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """The pieces of a word: the pair of the lowest rank first, the leftmost of these first. Pairs wait in a heap by rank
    and place; pieces know their neighbours, and a pair whose pieces have changed since is passed over."""
    piece = dict(enumerate(word))
    after, before = {i: i + 1 for i in piece}, {i: i - 1 for i in piece}
    waiting: list[tuple[int, int, str, str]] = []

    def offer(i: int) -> None:
        left, right = piece.get(i), piece.get(after.get(i))
        if left is not None and right is not None and (left, right) in rank:
            heappush(waiting, (rank[left, right], i, left, right))

    for i in range(len(word) - 1):
        offer(i)
    while waiting:
        _, i, left, right = heappop(waiting)
        j = after.get(i)
        if piece.get(i) != left or piece.get(j) != right:
            continue
        piece[i] = left + right
        del piece[j]
        after[i] = after.pop(j)
        before[after[i]] = i
        offer(i)
        offer(before[i])
    return [piece[i] for i in sorted(piece)]


def word_pieces(texts: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """word, pieces of the different words: each is cut once, wherever it occurs."""
    rank = {pair: i for i, pair in enumerate(merges)}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "pieces": [apply_merges(w, rank) for w in batch["word"]]})

    return word_symbols(texts).select("word").mapInPandas(cut, "word string, pieces array<string>")


def bpe_encode(texts: DataFrame, key: list[str], merges: list[tuple[str, str]], vocab: dict[str, int]) -> DataFrame:
    """``key``, ids of each text: words are looked up in the table of different words, pieces in the vocabulary; what it
    lacks is unknown. Texts without words have no ids."""
    known = F.from_json(F.lit(json.dumps(vocab)), "map<string,int>")
    pieces = word_pieces(texts, merges).select("word", F.transform("pieces", lambda p: F.coalesce(known[p], F.lit(UNKNOWN))).alias("ids"))
    placed = texts.select(*key, F.posexplode(tx.words(F.col("norm"))).alias("at", "w")).select(*key, "at", F.concat(F.lit(MARK), "w").alias("word"))
    joined = placed.join(pieces, "word").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("l"))
    encoded = joined.select(*key, F.flatten(F.transform("l", lambda x: x["ids"])).alias("ids"))
    return texts.select(*key).join(encoded, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def bpe_decode(ids: Column, vocab: dict[str, int]) -> Column:
    """The text of ids: pieces joined, marks as spaces, special ids skipped."""
    token = F.from_json(F.lit(json.dumps({str(i): t for t, i in vocab.items()})), "map<string,string>")
    pieces = F.transform(F.filter(ids, lambda i: i >= SPECIAL), lambda i: token[i.cast("string")])
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit(MARK), F.lit(" ")))


def token_rates(encoded: DataFrame) -> DataFrame:
    """tokens, unknown, unk_rate, empty_targets over rows with ids, in one row."""
    unknown = F.size(F.filter("ids", lambda i: i == UNKNOWN))
    found = encoded.agg(F.sum(F.size("ids")).alias("tokens"), F.sum(unknown).alias("unknown"), F.count_if(F.size("ids") == 0).alias("empty_targets"))
    return found.select("tokens", "unknown", (F.col("unknown") / F.greatest(F.lit(1), "tokens")).alias("unk_rate"), "empty_targets")


def token_lookup(words: DataFrame, table: DataFrame) -> DataFrame:
    """``words`` with the id of ``table`` (word, id), unknown where it has none."""
    return words.join(table.select("word", "id"), "word", "left").withColumn("id", F.coalesce("id", F.lit(UNKNOWN)))


def first_ids(words: DataFrame, size: int) -> DataFrame:
    """word, id of the ``size`` most frequent words, ties in order of the word: a closed vocabulary."""
    top = words.orderBy(F.desc("n"), "word").limit(size)
    return top.select("word", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) + UNKNOWN).cast("int").alias("id"))
