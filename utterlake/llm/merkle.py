"""A Merkle manifest of a table of documents, with a proof of membership for every row.

Every source has a tree over its rows, and a tree over the roots of the sources ends in one root. Trees are climbed several
levels a shuffle: a task gets at most ``RUN ** LEVELS`` neighbouring nodes and hashes all levels between them and their
ancestor, so no group grows with a source. Proofs come by pointer jumping: every node holds the digests beside it as a
segment, and its parent; a join of the nodes with themselves appends an ancestor's segment to a node's and takes that
ancestor's ancestor, which doubles the distance, until every leaf has reached the root.

A segment is text: for each level the digests before the node, ``|`` in its own place, the digests after it, and ``;``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, free_name, materialize, placed

RUN = 3
#: Levels that are climbed in one shuffle; a task's group has at most RUN ** LEVELS nodes.
LEVELS = 6
#: The name of the tree over the sources; trees of sources are named by the encoded source, which is never empty.
TOP = ""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = ["tree", "depth", "level", "pos", "digest", "below", "below_depth", "doc_id", "tampered"]


def encoded(value):
    """``-`` for NULL, else the length in UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text, fields: tuple[str, ...] = FIELDS):
    """The digest of a row, with ``text`` in the place of its text."""
    return F.sha2(F.concat(*[encoded(text if name == "text" else F.col(name)) for name in fields]), 256)


def _depth(size):
    """How often RUN nodes at a time are replaced by one until one is left."""
    return sum(((size > RUN**k).cast("int") for k in range(40)), F.lit(0))


def _div(a, n: int):
    return ((a - a % n) / n).cast("long")


def _entry(digests, i):
    """The segment of the i-th of ``digests`` (from 0) within its run."""
    place = (i % RUN).cast("int")
    left = F.slice(digests, (i - place + 1).cast("int"), place)
    right = F.slice(digests, (i + 2).cast("int"), F.lit(RUN - 1) - place)
    return F.concat(F.array_join(left, ""), F.lit("|"), F.array_join(right, ""), F.lit(";"))


def _climb(nodes: DataFrame, level: int) -> DataFrame:
    """From the nodes of ``level`` of trees that are deeper: these nodes and those of the levels above, up to LEVELS, each
    with its entry; the topmost ones have none yet."""
    top = F.least(F.col("depth"), F.lit(level + LEVELS))
    rows = nodes.withColumn("block", _div(F.col("pos"), RUN**LEVELS)).groupBy("tree", "depth", "block")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "below", "below_depth", "doc_id", "tampered"))).alias("row"))
    rows = rows.withColumn("d0", F.transform("row", lambda x: x.digest))

    def above(digests):
        runs = F.sequence(F.lit(0), _div(F.size(digests) - 1, RUN).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(digests, i * RUN + 1, RUN), ""), 256))

    for j in range(LEVELS):
        rows = rows.withColumn(f"d{j + 1}", above(F.col(f"d{j}")))
    none = {"below": "string", "below_depth": "int", "doc_id": "long", "tampered": "string"}

    def made(at, pos, digest, entry, **held):
        own = [held.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in none.items()]
        return F.struct(at.cast("int").alias("level"), pos.cast("long").alias("pos"), digest.alias("digest"), entry.cast("string").alias("entry"), *own)

    def of_level(j: int):
        base = F.col("block") * RUN ** (LEVELS - j)
        if j == 0:
            return F.transform("row", lambda x, i: made(F.lit(level), base + i, x.digest, _entry(F.col("d0"), i), below=x.below, below_depth=x.below_depth, doc_id=x.doc_id, tampered=x.tampered))
        return F.transform(f"d{j}", lambda x, i: made(F.lit(level + j), base + i, x, _entry(F.col(f"d{j}"), i)))

    def topmost(j: int):
        return F.transform(f"d{j}", lambda x, i: made(F.lit(level + j), F.col("block") * RUN ** (LEVELS - j) + i, x, F.lit(None)))

    empty = F.array().cast("array<struct<level:int,pos:bigint,digest:string,entry:string,below:string,below_depth:int,doc_id:bigint,tampered:string>>")
    parts = [F.when(F.lit(level + j) < top, of_level(j)).otherwise(empty) for j in range(LEVELS)]
    parts += [F.when(F.lit(level + j) == top, topmost(j)).otherwise(empty) for j in range(1, LEVELS + 1)]
    return rows.select("tree", "depth", F.explode(F.concat(*parts)).alias("x")).select("tree", "depth", "x.*")


def _trees(leaves: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """All nodes but the roots with their entries, the roots (columns _NODE), and the tables that hold both."""
    roots, inner, tables, level = leaves.where("depth = 0").select(_NODE), None, [], 0
    now = leaves.where("depth > 0")
    while level < deepest:
        climbed = materialize(_climb(now, level), "levels")
        tables.append(climbed)
        entered = climbed.where("entry IS NOT NULL")
        inner = entered if inner is None else inner.unionByName(entered)
        tops = climbed.where("entry IS NULL")
        roots = roots.unionByName(tops.where("level = depth").select(_NODE))
        now, level = tops.where("level < depth"), level + LEVELS
    return inner, roots, tables


def _linked(inner: DataFrame, name: str, up: int = 0) -> DataFrame:
    """Nodes of one kind of tree as pointers: their key, that of their parent, and their entry. ``up``: what to add to a
    level for its height above the deepest leaf."""
    parent = [F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), _div(F.col("pos"), RUN).alias("up_pos")]
    own = [F.col("tree"), F.col("level"), F.col("pos")]
    if name == "top":  # a node at the bottom is the root of a tree below
        bottom = F.col("level") == 0
        own = [F.when(bottom, F.col("below")).otherwise(F.col("tree")).alias("tree"), F.when(bottom, F.col("below_depth")).otherwise(F.col("level")).alias("level"), F.when(bottom, F.lit(0)).otherwise(F.col("pos")).cast("long").alias("pos")]
        high = F.when(bottom, F.col("below_depth")).otherwise(F.col("level") + up)
        leaf, below = F.col("level") + F.coalesce("below_depth", F.lit(1)) == 0, F.coalesce("below_depth", F.lit(0))
    else:
        high, leaf, below = F.col("level"), F.col("level") == 0, F.col("depth")
    return inner.select(*own, *parent, F.col("entry").alias("segment"), high.alias("height"), leaf.alias("is_leaf"), below.alias("below_depth"), "doc_id", "digest", "tampered")


def folded(start, segment):
    """The digest that ``start`` and the digests beside its path give."""
    steps = F.filter(F.split(segment, ";"), lambda x: x != "")
    return F.aggregate(steps, start, lambda acc, x: F.sha2(F.replace(x, F.lit("|"), acc), 256))


def _jump(nodes: DataFrame, distance: int, root: tuple[str, int, int]) -> DataFrame:
    """Every node's segment and pointer, from ``distance`` levels to twice as many; nodes at the root stay. Only nodes that
    are so high above all leaves can be met."""
    done = (F.col("up_tree") == root[0]) & (F.col("up_level") == root[1]) & (F.col("up_pos") == root[2])
    ahead = nodes.where(F.col("height") >= distance).select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("pos").alias("p"), F.col("segment").alias("more"), F.col("up_tree").alias("ut"), F.col("up_level").alias("ul"), F.col("up_pos").alias("upp"))
    met = nodes.where(~done).join(ahead, (F.col("up_tree") == F.col("t")) & (F.col("up_level") == F.col("l")) & (F.col("up_pos") == F.col("p")))
    moved = met.withColumns({"segment": F.concat("segment", "more"), "up_tree": F.col("ut"), "up_level": F.col("ul"), "up_pos": F.col("upp")})
    return nodes.where(done).unionByName(moved.select(nodes.columns))


def proofs(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root, segment of (doc_id, source, leaf, tampered): the proof of every row.

    Rows of a source are in order of doc_id (NULL first), of equal ones in order of their digests. A NULL source is a source
    of its own. An empty table has no root and gives no rows."""
    spark = leaves.sparkSession
    schema = "doc_id long, leaf string, tampered string, subroot string, root string, segment string"
    hashed = materialize(leaves, "leaves")  # ranges are found by a sample: texts are not hashed twice for it
    leaves = placed(hashed, ["source"], ["doc_id", "leaf"])
    discard(hashed)
    named = leaves.select(encoded(F.col("source")).alias("tree"), "source", _depth(F.col("size")).alias("depth"), F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest"),
                          F.lit(None).cast("string").alias("below"), F.lit(None).cast("int").alias("below_depth"), "doc_id", "tampered")
    deepest = named.agg(F.max("depth")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], schema)
    inner, roots, tables = _trees(named, deepest)
    order = F.when(F.col("tree") == "-", None).otherwise(F.expr("substring(tree, instr(tree, ':') + 1)"))
    tops = placed(roots.drop("pos").withColumn("source", order).withColumn("group", F.lit(0)), ["group"], ["source"])
    placed_tops = tops
    tops = materialize(tops.select(F.lit(TOP).alias("tree"), _depth(F.col("size")).alias("depth"), F.lit(0).alias("level"), "pos", "digest", F.col("tree").alias("below"), F.col("depth").alias("below_depth"), "doc_id", "tampered"), "subroots")
    height = tops.select("depth").first()[0]
    upper, top, more = _trees(tops, height)
    root = top.first()
    if height == 0:  # the root of the only source, whose parent is itself
        at = (root["below"], root["below_depth"], 0)
        upper = tops.withColumn("entry", F.lit(""))
    else:
        at = (TOP, height, 0)
    nodes = _linked(upper, "top", deepest)
    if height == 0:
        nodes = nodes.withColumns({"up_tree": F.lit(at[0]), "up_level": F.lit(at[1]), "up_pos": F.lit(0).cast("long")})
    if inner is not None:
        nodes = nodes.unionByName(_linked(inner, "source"))
    old, distance = [leaves, placed_tops, tops, *tables, *more], 1
    nodes = materialize(nodes, "pointers")
    discard(*old)
    while distance < deepest + height:
        further = materialize(_jump(nodes, distance, at), "pointers")
        discard(nodes)
        nodes, distance = further, 2 * distance
    found = nodes.where("is_leaf")
    path = F.split(F.col("segment"), ";")
    own = F.array_join(F.slice(path, 1, F.col("below_depth")), ";")
    return found.select("doc_id", F.col("digest").alias("leaf"), "tampered", folded(F.col("digest"), own).alias("subroot"), F.lit(root["digest"]).alias("root"), "segment")


def merkle_manifest(docs: DataFrame, tampered_text=None, tampered_if=None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row for each row of ``docs`` (doc_id, source, lang,
    n_chars, text; further columns are not read).

    ``tampered_text`` is what the text of the rows with ``tampered_if`` is when the proof is checked; without them all rows
    verify. NULL in any column is hashed as such; repeated rows are leaves of their own, with equal digests."""
    name = free_name(docs.columns, "tampered")
    leaf = leaf_digest(F.col("text"))
    other = leaf_digest(tampered_text) if tampered_text is not None else F.lit(None).cast("string")
    rows = docs.withColumn(name, F.when(F.coalesce(tampered_if, F.lit(False)), other) if tampered_if is not None else other)
    leaves = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("leaf"), F.col(name).alias("tampered"))
    found = proofs(leaves)
    proof = F.sha2(F.translate("segment", "|;", ""), 256)
    checked = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("segment")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_manifest(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("")), even)


def _sql() -> str:
    """The trees by recursion over levels: nodes of a source with more than one node give those of the next level."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
    leaf = lambda text: "sha256(" + " || ".join(field(text if x == "text" else x) for x in FIELDS) + ")"
    text = "replace(text, chr(10), '')"

    def levels(name: str, leaves: str) -> str:
        return f"""{name} AS (SELECT tree, 0 AS level, pos, n, digest FROM {leaves}
UNION ALL SELECT tree, level + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3)"""

    crc = "list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(CAST(string_split(CAST(doc_id AS VARCHAR), '') AS VARCHAR[]), lambda c: list_prepend(CAST(1000 + ascii(c) AS UBIGINT), list_transform(range(8), lambda i: CAST(0 AS UBIGINT)))))), lambda acc, x: CASE WHEN x >= 1000 THEN xor(acc, CAST(x - 1000 AS UBIGINT)) WHEN acc % 2 = 1 THEN xor(acc // 2, CAST(3988292384 AS UBIGINT)) ELSE acc // 2 END)"
    return f"""WITH RECURSIVE d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN ({crc}) % 2 = 1 THEN {leaf(text)} END AS tampered FROM documents),
e AS (SELECT *, {field('source')} AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS digest FROM d),
{levels('a', 'e')},
r AS (SELECT tree, digest FROM a WHERE n = 1),
o AS (SELECT tree AS source_tree, '' AS tree, row_number() OVER (ORDER BY encode(CASE WHEN tree <> '-' THEN substr(tree, instr(tree, ':') + 1) END) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest FROM r),
{levels('b', 'o')},
x AS (SELECT e.doc_id, e.pos, e.leaf, e.tampered, o.digest AS subroot, o.pos AS top_pos, e.tree, (SELECT digest FROM b WHERE n = 1) AS root FROM e JOIN o ON o.source_tree = e.tree),
m AS (SELECT x.tree, x.pos AS leaf_pos, a.level, a.pos - CAST(x.pos // CAST(pow(3, a.level) AS BIGINT) AS BIGINT) AS off, a.digest FROM x JOIN a ON a.tree = x.tree AND a.n > 1 AND a.pos // 3 = x.pos // CAST(pow(3, a.level + 1) AS BIGINT)
UNION ALL SELECT x.tree, x.pos, 1000 + b.level, b.pos - CAST(x.top_pos // CAST(pow(3, b.level) AS BIGINT) AS BIGINT), b.digest FROM x JOIN b ON b.n > 1 AND b.pos // 3 = x.top_pos // CAST(pow(3, b.level + 1) AS BIGINT)),
s AS (SELECT tree, leaf_pos, level, coalesce(string_agg(digest, '' ORDER BY off) FILTER (off < 0), '') AS l, coalesce(string_agg(digest, '' ORDER BY off) FILTER (off > 0), '') AS r FROM m GROUP BY tree, leaf_pos, level),
p AS (SELECT tree, leaf_pos, string_agg(l || r, '' ORDER BY level) AS proof, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs, len(list(level)) AS steps FROM s GROUP BY tree, leaf_pos),
q AS (SELECT x.*, coalesce(p.proof, '') AS proof, p.ls, p.rs, coalesce(p.steps, 0) AS steps FROM x LEFT JOIN p ON p.tree = x.tree AND p.leaf_pos = x.pos),
f AS (SELECT tree, pos, 0 AS step, coalesce(tampered, leaf) AS digest, steps, ls, rs FROM q
UNION ALL SELECT tree, pos, step + 1, sha256(ls[step + 1] || digest || rs[step + 1]), steps, ls, rs FROM f WHERE step < steps)
SELECT q.doc_id, q.leaf, q.subroot, q.root, sha256(q.proof) AS proof_sha256, f.digest AS folded_root, f.digest = q.root AS verified FROM q JOIN f ON f.tree = q.tree AND f.pos = q.pos AND f.step = f.steps"""


ORACLE_SQL = _sql()
