"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Every window of ``window`` consecutive item words is asked for by its two rarest terms in the training data. The index
holds the positions of these terms in all documents, sorted by term, and with a rarest term the words around it. The
lists of the two terms are shifted by the terms' distance in the item and intersected; what is left is compared word by
word around the rarest term, and runs of ``window`` equal words or more are exact phrase matches: a run of that length
within reach of the term always holds it. Only rare terms are looked up, so a frequent word costs nothing unless a
window consists of frequent words. Proximity matches (a window's two rarest terms near each other without the phrase)
come from the same lists. Items and texts are cut into pieces, and places of items with equal words around them are one
place for the search, so no row or group grows with the length of either, and a repeated passage is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import discard, let, materialize

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUNS = "array<struct<from:int,to:int>>"
PLACE = ["p1", "p2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; of NULL none. Plain lower() serves texts of one-byte characters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0))


def word_pieces(rows: DataFrame, keys: list[str], found: Column, window: int, piece: int = 64) -> DataFrame:
    """keys, base, words: the arrays ``found`` cut into pieces of ``piece`` words from ``base`` on, each with the
    ``window - 1`` words on both sides of it, so a row is small however long its array. Empty arrays give no rows."""
    reach = window - 1
    low = lambda base: F.greatest(base - reach, F.lit(0))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(piece)), lambda base: F.struct(base.alias("base"), F.slice(w, low(base) + 1, piece + 2 * reach).alias("words")))
    return rows.select(*keys, F.explode(let(found, cut)).alias("p")).select(*keys, "p.base", "p.words")


def placed_words(pieces: DataFrame, keys: list[str], window: int, piece: int = 64) -> tuple[DataFrame, Column, Column]:
    """keys, base, words, term, pos of each word of the pieces, and two columns over these rows: the words around the
    word (at most ``window - 1`` on each side), and how many of them stand before it."""
    low = F.greatest(F.col("base") - (window - 1), F.lit(0))
    own = F.slice("words", F.col("base") - low + 1, piece)
    placed = pieces.select(*keys, "base", "words", F.posexplode(own).alias("i", "term")).withColumn("pos", F.col("base") + F.col("i"))
    left = F.least(F.col("pos"), F.lit(window - 1))
    return placed, F.slice("words", F.col("pos") - left - low + 1, left + window), left


def item_anchors(places: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """item_key, pos, second: the rarest and the second rarest position (NULL in windows of one word) of all windows of
    the items; ``places`` has item_key, n_words, pos, term. A group is a stretch of windows, however long the item."""
    stretch = max(64, window)
    width, first = F.least(F.lit(window), F.col("n_words")), F.col("k") * stretch
    rated = places.join(frequency, "term", "left").select("item_key", "n_words", "pos", F.coalesce("n", F.lit(0)).alias("n"))
    k = F.floor(F.col("pos") / stretch).cast("int")
    rated = rated.select("*", F.explode(F.when((F.col("pos") % stretch < window - 1) & (k > 0), F.array(k, k - 1)).otherwise(F.array(k))).alias("k"))
    lists = rated.groupBy("item_key", "n_words", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("rated"))

    def rarest(start: Column) -> Column:
        inside = F.sort_array(F.transform(F.slice("rated", start - first + 1, width), lambda x: F.struct(x["n"].alias("n"), x["pos"].alias("pos"))))
        return let(inside, lambda x: F.struct(F.get(x, F.lit(0))["pos"].alias("pos"), F.get(x, F.lit(1))["pos"].alias("second")))

    starts = F.sequence(first, F.least(first + stretch, F.col("n_words") - width + 1) - 1)
    found = lists.where(first <= F.col("n_words") - width).select("item_key", F.explode(F.array_distinct(F.transform(starts, rarest))).alias("a"))
    return found.select("item_key", "a.pos", "a.second").distinct()


def runs_of(equal, first: int, last: int, width: Column) -> Column:
    """The runs of at least ``width`` consecutive numbers from ``first`` to ``last`` for which ``equal`` holds, as structs
    (from, to), to exclusive; each number is looked at once."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast(RUNS).alias("runs"))
    ended = lambda acc, at: F.when(acc["n"] >= width, F.concat(acc["runs"], F.array(F.struct((at - acc["n"]).alias("from"), at.alias("to"))))).otherwise(acc["runs"])
    step = lambda acc, d: F.when(equal(d), F.struct((acc["n"] + 1).alias("n"), acc["runs"].alias("runs"))).otherwise(F.struct(F.lit(0).alias("n"), ended(acc, d).alias("runs")))
    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), start, step, lambda acc: ended(acc, F.lit(last + 1)))


def with_words(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, n_words and the words of each row, joined by single spaces, as a table in the shared folder: texts
    are cut by the pattern once, and later reads split at spaces only. ``row_id`` tells rows apart that repeat a doc_id."""
    found = docs.select("doc_id", words(F.col("text")).alias("w"))
    rows = found.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("body"))
    return materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "tokens")


def body_words(body: Column) -> Column:
    """The words of a joined text; of an empty one none."""
    return F.when(body != "", F.split(body, " ")).otherwise(F.array().cast("array<string>"))


def positional_index(tokens: DataFrame, wanted: DataFrame, window: int, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The postings term, row_id, pos of the wanted terms, in the order of terms; those of terms that may begin a lookup
    carry the words around them (at most ``2 * window - 1``). Terms of up to ``broadcast_bytes`` in all, as measured,
    go to the texts; beyond that, places go to the terms without words, and what is found fetches its piece's words."""
    terms = materialize(wanted.groupBy("term").agg(F.max("first").alias("first")), "wanted-terms")
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    pieces = word_pieces(tokens.where("body <> ''"), ["row_id"], body_words(F.col("body")), window)
    placed, around, _ = placed_words(pieces, ["row_id"], window)
    if size <= broadcast_bytes:
        placed = placed.join(F.broadcast(terms), "term")
    else:
        placed = placed.select("row_id", "base", "pos", "term").join(terms, "term").join(pieces, ["row_id", "base"])
    index = placed.select("term", "row_id", "pos", F.when(F.col("first"), around).alias("around"))
    index = materialize(index.repartition("term", "row_id").sortWithinPartitions("term", "row_id", "pos"), "positional-index")
    discard(terms)
    return index


def found_places(tokens: DataFrame, items: DataFrame, window: int, near: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: row_id, p1, p2, from, to (runs of equal words of a row of ``tokens`` around a place); row_id, p1, p2
    (rows with a window's two rarest terms near each other at this place); p1, p2, item_id (the items of a place)."""
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item_words")).where("size(item_words) > 0").distinct()
    asked = materialize(asked.select(F.monotonically_increasing_id().alias("item_key"), "item_id", F.size("item_words").alias("n_words"), "item_words"), "items")

    vocabulary = asked.select(F.explode("item_words").alias("term")).distinct()
    frequency = tokens.select(F.explode(body_words(F.col("body"))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    frequency = materialize(frequency, "term-frequency")
    pieces = word_pieces(asked, ["item_key", "n_words"], F.col("item_words"), window)
    placed, around, left = placed_words(pieces, ["item_key", "n_words"], window)
    anchors = item_anchors(placed.select("item_key", "n_words", "pos", "term"), frequency, window)
    around = placed.select("item_key", F.least(F.lit(window), F.col("n_words")).alias("width"), "pos", "term", around.alias("mine"), left.alias("left"))
    content = [F.col("width"), F.col("left"), F.col("mine")]
    places = anchors.join(around, ["item_key", "pos"]).select(
        F.xxhash64(*content).alias("p1"), F.xxhash64(F.lit(7), *content).alias("p2"), "item_key", "term", *content,
        (F.col("second") - F.col("pos")).alias("delta"), F.get("mine", F.col("left") + F.col("second") - F.col("pos")).alias("other"),
    )
    places = materialize(places, "places")
    lookups = materialize(places.select(*PLACE, "term", *content).dropDuplicates(PLACE), "lookups")
    deltas = materialize(places.where("delta is not null").select(*PLACE, "delta", "other").distinct(), "deltas")
    wanted = lookups.select("term", F.lit(True).alias("first")).unionByName(deltas.select(F.col("other").alias("term"), F.lit(False).alias("first")))
    index = positional_index(tokens, wanted, window)

    # The lists of a place, shifted to its rarest term, and intersected.
    firsts = index.where("around is not null").join(lookups.select(*PLACE, "term", "width"), "term").select(*PLACE, "row_id", F.col("pos").alias("at"), "around", "width")
    seconds = index.select("row_id", "pos", F.col("term").alias("other")).join(deltas, "other").select(*PLACE, "row_id", (F.col("pos") - F.col("delta")).alias("at"), "delta")
    both = firsts.where("width > 1").join(seconds, [*PLACE, "row_id", "at"], "left_semi").unionByName(firsts.where("width = 1"))
    both = both.drop("width").join(lookups.select(*PLACE, *content), PLACE)
    reach, before = window - 1, F.least(F.col("at"), F.lit(window - 1))

    def equal(d: Column) -> Column:
        mine, theirs = F.col("left") + d, before + d
        return F.coalesce(F.get("mine", F.when(mine >= 0, mine)) == F.get("around", F.when(theirs >= 0, theirs)), F.lit(False))

    runs = both.select(*PLACE, "row_id", "at", F.explode(runs_of(equal, -reach, reach, F.col("width"))).alias("r"))
    runs = runs.select(*PLACE, "row_id", (F.col("at") + F.col("r.from")).alias("from"), (F.col("at") + F.col("r.to")).alias("to"))
    runs = materialize(runs, "runs")

    # Proximity: of the places of a window's two rarest terms, in the order of their shifts, each sees the last one of
    # the other term before it; so the nearest pair is found in one pass.
    rarest = firsts.select(*PLACE, "row_id", "at").join(deltas.select(*PLACE, "delta"), PLACE).withColumn("rarest", F.lit(True))
    seen = rarest.unionByName(seconds.withColumn("rarest", F.lit(False)))
    line = Window.partitionBy(*PLACE, "delta", "row_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    other = lambda rarest: F.last(F.when(F.col("rarest") == rarest, F.col("at")), ignorenulls=True).over(line)
    gap = F.col("at") - F.when(F.col("rarest"), other(False)).otherwise(other(True))
    close = materialize(seen.withColumn("gap", gap).where(F.col("gap") <= near).select(*PLACE, "row_id").distinct(), "close")
    of = materialize(places.select(*PLACE, "item_key").distinct().join(asked.select("item_key", "item_id"), "item_key").select(*PLACE, "item_id").distinct(), "items-of-places")
    discard(asked, frequency, places, lookups, deltas, index)
    return runs, close, of


def phrase_matches(tokens: DataFrame, items: DataFrame, window: int = 13, near: int = 13) -> DataFrame:
    """row_id, item_id, from, to: the exact and proximity matches of each row of ``tokens`` (from ``with_words``) and
    each item. An exact match is a longest stretch of the row's words (to exclusive) that windows of the item cover
    without a gap. A proximity match has no from and to: the two rarest terms of a window come within ``near`` words of
    their distance in the item, and the row has no exact match of the item. Items without words, and repeats of an item
    row, add nothing."""
    runs, close, of = found_places(tokens, items, window, near)
    spans = runs.join(of, PLACE).select("row_id", "item_id", "from", "to").distinct()
    line = Window.partitionBy("row_id", "item_id").orderBy("from", "to")
    fresh = F.col("from") > F.coalesce(F.max("to").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = spans.withColumn("n", F.sum(fresh.cast("int")).over(line)).groupBy("row_id", "item_id", "n").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("n")
    only = close.join(of, PLACE).select("row_id", "item_id").distinct().join(spans, ["row_id", "item_id"], "left_anti")
    return spans.unionByName(only, allowMissingColumns=True)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, row_id.

    Contaminated: some word is hit and 1 in ``share`` words or more are. n_near counts items with a proximity match
    only. NULL and empty texts have no words and are clean; rows that repeat a doc_id, or have none, are judged each for
    itself; of equally rare terms the earlier is looked up; texts and items of any length are cut into places, so very
    long ones make longer lists but no larger rows; other columns are not read; empty tables give empty results or clean
    documents.
    """
    tokens = with_words(docs)
    runs, close, of = found_places(tokens, items, window, near=window)
    # A row and a place once, before the items of the place are named.
    places = runs.select("row_id", *PLACE, F.lit(True).alias("exact")).unionByName(close.select("row_id", *PLACE, F.lit(False).alias("exact")))
    places = places.groupBy("row_id", *PLACE).agg(F.max("exact").alias("exact"))
    per_item = places.join(of, PLACE).groupBy("row_id", "item_id").agg(F.max("exact").alias("exact"))
    named = per_item.groupBy("row_id").agg(F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("ids"), F.count_if(~F.col("exact")).alias("n_near"))
    # Word positions that are hit, each counted once: spans in order, each adds what lies beyond all before it.
    spans = runs.select("row_id", "from", "to").distinct()
    before = F.coalesce(F.max("to").over(Window.partitionBy("row_id").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("to") - F.greatest("from", before))).groupBy("row_id").agg(F.sum("fresh").alias("n_hit"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    judged = tokens.select("row_id", "doc_id", "n_words").join(named, "row_id", "left").join(hit, "row_id", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "row_id",
    )
    judged = materialize(judged, "judged")
    discard(tokens, runs, close, of)
    return judged


def _text_key(text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without contaminated rows; all columns unchanged, whatever their names.

    A row is judged by its text alone, so rows that repeat a doc_id or have none are kept or go each for itself, and
    equal texts share a verdict (they are told apart by 128 bits of hash). NULL and empty texts stay.
    """
    keyed = docs.select(F.struct(*_text_key(F.col("text"))).alias("doc_id"), F.col("text"))
    gone = contamination(keyed, items, window, share).where("contaminated").select("doc_id.*").distinct().toDF("h1", "h2")
    gone = materialize(gone, "contaminated")
    h1, h2 = _text_key(docs["text"])
    return docs.join(gone, (h1 == gone["h1"]) & (h2 == gone["h2"]), "left_anti")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM grams),
placed AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, sizes WHERE len(w) >= k)
), found AS (
  SELECT p.doc_id, p.s, p.k, g.item_id FROM placed p JOIN grams g ON p.k = g.k AND p.g = g.g
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS pos FROM (SELECT DISTINCT doc_id, s, k FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
