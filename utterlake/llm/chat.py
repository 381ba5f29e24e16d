"""Conversations as training text: every turn rendered by a compiled template, with the spans that a loss may see.

A turn needs its own row alone (and its place, if the template asks for it), so turns are rendered where they lie, however
long their conversation is; what a template writes before and after the turns is the same for all conversations. A
conversation's text is the parts of its rows, one after another in the order of ``ORDER``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import placed
from .template import Template, unescape

#: What the texts of a conversation may not hold as they are.
CONTROLS = ("###", "</turn>")
TEMPLATE = """{%- for m in messages -%}
### {{ m.role | escape(':') }}:{{ '\\n' }}
{%- if m.role == 'assistant' -%}
{%- generation -%}{{ m.text | escape }}{%- endgeneration -%}
{%- else -%}{{ m.text | escape }}{%- endif -%}
</turn>{{ '\\n' }}
{%- endfor -%}"""
#: Rows of a conversation in this order are its text: before, turns, after; of equal turns by their text.
ORDER = ["conv_id", "part", "turn", "formatted"]
_FORMATTED = "conv_id long, part int, turn long, formatted string, spans array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@lru_cache(maxsize=8)
def compiled(source: str, controls: tuple[str, ...]) -> Template:
    return Template(source, controls=controls)


def format_conversations(turns: DataFrame, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """conv_id, part (0 before the turns, 1 a turn, 2 after them), turn, formatted, spans (code points of ``formatted`` under
    generation marks) of (conv_id, turn, role, text); further columns are not read.

    A NULL text or role is empty, a NULL conv_id is a conversation of its own, a NULL turn comes first; repeated rows are
    turns of their own. An empty table gives no rows. Only a template that uses ``loop`` needs a shuffle: places come from
    ranges of turns, so that a long conversation is shared by many tasks."""
    template = compiled(source, controls)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    needs = bool(template.loop_fields)
    if needs:
        rows = placed(rows, ["conv_id"], ["turn", "role", "text"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = compiled(source, controls).turn
        for batch in batches:
            texts, spans = [], []
            for row in batch.to_pylist():
                loop = {"index0": row["pos"], "index": row["pos"] + 1, "first": row["pos"] == 0, "last": row["pos"] + 1 == row["size"], "length": row["size"]} if needs else None
                text, marks = turn(row, loop)
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in marks])
            part = pa.array([1] * len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["conv_id"], part, batch["turn"], pa.array(texts, pa.string()), pa.array(spans, _SPANS)], ["conv_id", "part", "turn", "formatted", "spans"])

    formatted = rows.mapInArrow(render, _FORMATTED)
    for part, (text, marks) in ((0, template.before()), (2, template.after())):
        if text:
            spans = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in marks]).cast("array<struct<start: bigint, end: bigint>>")
            formatted = formatted.unionByName(rows.select("conv_id").distinct().select("conv_id", F.lit(part).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(text).alias("formatted"), spans.alias("spans")))
    return formatted


_MARKS = re.compile(r"\\.|###|</turn>", re.S)
_ROLE = re.compile(r"### ((?:[^\\:]|\\.)*):\n", re.S)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a text by TEMPLATE."""
    found, at = [], 0
    while at < len(formatted):
        role = _ROLE.match(formatted, at)
        if not role:
            raise ValueError(f"no turn at {at}")
        end = next((m for m in _MARKS.finditer(formatted, role.end()) if m[0][0] != "\\"), None)
        if end is None or end[0] != "</turn>" or formatted[end.end() : end.end() + 1] != "\n":
            raise ValueError(f"the turn at {at} has no end")
        found.append((unescape(role[1]), unescape(formatted[role.end() : end.start()])))
        at = end.end() + 1
    return found


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.n, self.loss_chars, self.chars = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, spans: list[dict]) -> None:
        for role, text in parse_turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for span in spans or ():
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the texts of TEMPLATE alone.

    A digest runs over the turns one after another, so a conversation's rows pass through one task, sorted by Spark (which
    spills to disk) and a batch at a time: the task holds the state of two digests, not the conversation."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv_id, text, spans in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(text, spans)
            yield _batch(done)
        if now is not None:
            yield _batch([now.row()])

    names = [x.split()[0] for x in _READ.split(", ")]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        kinds = [pa.string() if name.endswith("sha256") else pa.int64() for name in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return formatted.repartition("conv_id").sortWithinPartitions(*ORDER).select("conv_id", "formatted", "spans").mapInArrow(digest, _READ)


#: The text that both turns of conversation -7 say.
PLANTED = r"\### Assistant: </turn> ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, k, role, PLANTED) for k, role in enumerate(("user", "assistant"))], turns.schema)
    return read_back(format_conversations(turns.unionByName(planted)))


_RUNS = "list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2))"
_ADDED = "coalesce(" + _RUNS + ", 0) + length({0}) - length(replace({0}, chr(92), '')) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7"
ORACLE_SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}')),
d AS (SELECT *, {_ADDED.format('text')} + {_ADDED.format('role')} + length(role) - length(replace(role, ':', '')) AS added FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(role) + length(text) + added + 4 + 2 + 8) AS BIGINT) AS formatted_chars FROM d GROUP BY conv_id"""
