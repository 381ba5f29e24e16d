"""Utterance endpoints from frame probabilities: one step function for batch and stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

EVENTS = "key long, event string, start_seq long, end_seq long, n_windows long"


@dataclass(frozen=True)
class EndpointRules:
    """Counts are windows: a run of ``start`` with p >= ``on`` opens an utterance, which takes up to ``pre_roll`` +
    ``start`` windows before it along; a run of ``end`` with p < ``off`` closes it and keeps three of them; at ``cap``
    windows it is closed as it is; a closed one of fewer than ``least`` windows is discarded."""

    on: float = 0.5
    off: float = 0.35
    start: int = 3
    end: int = 22
    pre_roll: int = 10
    cap: int = 938
    least: float = 7.8125

    @classmethod
    def from_ms(cls, window_ms: float = 32, trigger_ms: float = 96, silence_ms: float = 700, pre_roll_ms: float = 320, max_s: float = 30, min_ms: float = 250, **levels):
        n = lambda ms: max(1, round(ms / window_ms))
        return cls(start=n(trigger_ms), end=n(silence_ms), pre_roll=n(pre_roll_ms), cap=round(1000 * max_s / window_ms), least=min_ms / window_ms, **levels)


#: A key's state: open, run of speech, run of silence, windows held before an utterance, length, first window.
START = (False, 0, 0, 0, 0, 0)


def step(state: tuple, seq: int, p: float, rules: EndpointRules) -> tuple[tuple, tuple | None]:
    """The next state, and (event, start_seq, end_seq, n_windows) if there is one; END and DISCARD give the windows that
    are kept, end_seq exclusive."""
    is_open, speech, silence, held, length, first = state
    if not is_open:
        held = min(held + 1, rules.pre_roll + rules.start)
        speech = speech + 1 if p >= rules.on else 0
        if speech >= rules.start:
            return (True, 0, 0, held, held, seq - held + 1), ("START", seq - held + 1, seq + 1, held)
        return (False, speech, silence, held, 0, 0), None
    length += 1
    silence = silence + 1 if p < rules.off else 0
    if silence >= rules.end:
        kept = min(length, max(0, length - rules.end + 3))
    elif length >= rules.cap:
        kept = length
    else:
        return (True, 0, silence, held, length, first), None
    return START, ("DISCARD" if kept < rules.least else "END", first, first + kept, kept)


def run_steps(rows: pd.DataFrame, state: tuple, rules: EndpointRules) -> tuple[list[tuple], tuple]:
    """Events of (seq, p) rows in order, and the state after them."""
    out = []
    for seq, p in zip(rows["seq"].tolist(), rows["p"].tolist(), strict=True):
        state, event = step(state, seq, p, rules)
        if event:
            out.append(event)
    return out, state


def endpoints(frames: DataFrame, rules: EndpointRules) -> DataFrame:
    """key, event, start_seq, end_seq, n_windows for all keys. Frames are sorted by key and seq within their task and pass in
    batches, so a long stream needs no more memory than a batch."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, START
        for batch in batches:
            out = []
            for key, rows in batch.groupby("key", sort=False):
                if key != now:
                    now, state = key, START
                events, state = run_steps(rows, state, rules)
                out += [(key, *e) for e in events]
            yield pd.DataFrame(out, columns=["key", "event", "start_seq", "end_seq", "n_windows"])

    return frames.select("key", "seq", "p").repartition("key").sortWithinPartitions("key", "seq").mapInPandas(find, EVENTS)


def stateful(rules: EndpointRules):
    """The same as a function for ``applyInPandasWithState``: state carries over micro-batches, rows at or before the
    last sequence number seen are dropped as repeats."""
    from pyspark.sql.streaming.state import GroupState

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *state, last = held.get if held.exists else (*START, -1)
        rows = pd.concat(list(batches)).drop_duplicates("seq").sort_values("seq")
        rows = rows[rows["seq"] > last]
        events, state = run_steps(rows, tuple(state), rules)
        held.update((*state, int(rows["seq"].max()) if len(rows) else last))
        if events:
            yield pd.DataFrame([(key[0], *e) for e in events], columns=["key", "event", "start_seq", "end_seq", "n_windows"])

    return find


STATE = "open boolean, speech long, silence long, held long, length long, first long, last long"
