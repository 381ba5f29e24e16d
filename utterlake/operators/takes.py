"""Takes with timers: a recording that ends by itself, in event time.

A take begins with a key's first frame outside one. It is over when the gate has been off for ``quiet`` after activity,
when nothing has been heard for ``lead`` from its start, or after ``most`` in any case; whichever comes first is its
deadline, which depends on the frames alone and not on when they are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAKES = "key long, start long, end long, reason string, n_frames long"


def seconds(column: str):
    """Microseconds of a timestamp."""
    return F.unix_micros(F.col(column).cast("timestamp"))


@dataclass(frozen=True)
class TakeRules:
    """Durations are microseconds; the gate is that of ``hysteresis_gate``."""

    quiet: int = 800_000
    lead: int = 6_000_000
    most: int = 20_000_000
    on: float = 0.6
    off: float = 0.4
    min_on: int = 5
    min_off: int = 8


class Take(NamedTuple):
    """An open take: when it began, when it was last active (-1: not yet), frames, the gate's runs and state, last seq."""

    start: int
    seen: int = -1
    n: int = 0
    up: int = 0
    down: int = 0
    active: bool = False
    last: int = -1

    def heard(self, seq: int, at: int, p: float, rules: TakeRules) -> Take:
        up, down = self.up + 1 if p > rules.on else 0, self.down + 1 if p < rules.off else 0
        active = True if up == rules.min_on else False if down == rules.min_off else self.active
        return Take(self.start, at if active else self.seen, self.n + 1, up, down, active, seq)

    def deadline(self, rules: TakeRules) -> int:
        return min(self.start + rules.most, self.start + rules.lead if self.seen < 0 else self.seen + rules.quiet)

    def row(self, key: int, rules: TakeRules) -> tuple:
        end = self.deadline(rules)
        reason = "nothing heard" if self.seen < 0 and rules.lead <= rules.most else "cap" if end == self.start + rules.most else "quiet"
        return key, self.start, end, reason, self.n


def timed_takes(frames: DataFrame, rules: TakeRules) -> DataFrame:
    """key, start, end (microseconds), reason (quiet, nothing heard, cap), n_frames of (key, seq, ts, p). Frames of a key are
    taken in order of ts, then seq, sorted by Spark and a batch at a time; its last take ends at its deadline too."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, take = None, None
        for batch in batches:
            out = []
            for key, seq, at, p in zip(*(batch[c].tolist() for c in ("key", "seq", "at", "p")), strict=True):
                if take is not None and (key != now or at >= take.deadline(rules)):
                    out.append(take.row(now, rules))
                    take = None
                now, take = key, (take or Take(start=at)).heard(seq, at, p, rules)
            yield pd.DataFrame(out, columns=["key", "start", "end", "reason", "n_frames"])
        if take is not None:
            yield pd.DataFrame([take.row(now, rules)], columns=["key", "start", "end", "reason", "n_frames"])

    rows = frames.select("key", "seq", seconds("ts").alias("at"), "p")
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInPandas(find, TAKES)
