"""Streaming forms that carry state for each key: gates, endpoints, framing, metrics, sessions, replies, late rows.

Rows of a key are taken in order of their sequence within a micro-batch; a row at or before the last sequence number
that a key has seen is late or a repeat: it changes nothing and goes to the side output of ``tag_late``. Input streams
have an event-time column ``ts``; ``watermarked`` drops repeats within the watermark before any state is touched.

A key's state has an event-time timer: it leaves the store once the watermark is ``idle`` past the key's last row, and a
key that comes back later starts anew. Rows behind the watermark are dropped before they reach a state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.adaptive import CLEAN, FLOOR, LEVELS, Cleaner, follow_rows
from ..operators.endpoint import EVENTS, START, STATE, EndpointRules, stateful
from ..operators.sessions import STATE_OF
from ..operators.takes import TAKES, Take, TakeRules, seconds


#: How long a key may be silent before its state goes.
IDLE = "60 days"


def watermarked(stream: DataFrame, delay: str = "10 minutes", key: str = "key", seq: str = "seq") -> DataFrame:
    """The stream with a watermark on ``ts`` and without repeats of (key, seq) within it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key, seq])


def _timed(stream: DataFrame, at: str, delay: str) -> DataFrame:
    """The stream with a watermark on its event time, unless it has one."""
    return stream if "spark.watermarkDelayMs" in stream.schema[at].metadata else stream.withWatermark(at, delay)


def _with_state(stream: DataFrame, key: str, find: Callable, output: str, state: str, idle: str | None = IDLE, delay: str = "10 minutes", at: str = "ts") -> DataFrame:
    """``find`` for each key, with a timer that removes its state; without ``idle`` it stays."""
    if idle is None:
        return stream.groupBy(key).applyInPandasWithState(find, output, state, "append", GroupStateTimeout.NoTimeout)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = list(batches)
        latest = max(int(np.fmax.reduce(x[at].to_numpy()).astype("datetime64[ms]").astype(int)) for x in rows)
        yield from find(key, iter(rows), held)
        held.setTimeoutTimestamp(max(latest + wait, held.getCurrentWatermarkMs() + 1))

    return _timed(stream, at, delay).groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def _fresh(batches: Iterator[pd.DataFrame], seq: str, last: int) -> pd.DataFrame:
    found = list(batches)
    rows = found[0] if len(found) == 1 else pd.concat(found)
    at = rows[seq].to_numpy()
    if len(at) and at[0] > last and (at[1:] > at[:-1]).all():
        return rows
    at, first = np.unique(at, return_index=True)  # of repeats the first
    return rows.iloc[first[at > last]]


def endpoint_stream(frames: DataFrame, rules: EndpointRules, idle: str | None = IDLE) -> DataFrame:
    """The utterance events of ``endpoints``, as soon as they are known."""
    return _with_state(frames.select("key", "seq", "p", "ts"), "key", stateful(rules), EVENTS, STATE, idle)


def gate_stream(frames: DataFrame, on: float = 0.6, off: float = 0.4, min_on: int = 5, min_off: int = 8, idle: str | None = IDLE) -> DataFrame:
    """key, seq, active: the hysteresis gate's state after each frame."""

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        up, down, active, last = held.get if held.exists else (0, 0, False, -1)
        rows = _fresh(batches, "seq", last)
        out = []
        for seq, p in zip(rows["seq"].tolist(), rows["p"].tolist(), strict=True):
            up, down, last = up + 1 if p > on else 0, down + 1 if p < off else 0, seq
            active = True if up == min_on else False if down == min_off else active
            out.append((key[0], seq, active))
        held.update((up, down, active, last))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "active"])

    return _with_state(frames.select("key", "seq", "p", "ts"), "key", find, "key long, seq long, active boolean", "up long, down long, active boolean, last long", idle)


def frame_stream(samples: DataFrame, length: int = 400, hop: int = 160, idle: str | None = IDLE) -> DataFrame:
    """key, frame, x (array): overlapping frames across block edges; the samples that later frames need are carried."""

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        tail, first, frame, last = held.get if held.exists else ([], 0, 0, -1)
        rows = _fresh(batches, "n", last)
        data, out = np.concatenate([np.array(tail, float), rows["x"].to_numpy(float)]), []
        while frame * hop + length <= first + len(data):
            at = frame * hop - first
            out.append((key[0], frame, data[at : at + length].tolist()))
            frame += 1
        keep = max(0, frame * hop - first)
        held.update((data[keep:].tolist(), first + keep, frame, int(rows["n"].max()) if len(rows) else last))
        if out:
            yield pd.DataFrame(out, columns=["key", "frame", "x"])

    return _with_state(samples.select("key", "n", "x", "ts"), "key", find, "key long, frame long, x array<double>", "tail array<double>, first long, frame long, last long", idle)


def metrics_stream(samples: DataFrame, window: int = 500) -> DataFrame:
    """stage, total, count, p50, p95, last after each micro-batch, over the last ``window`` samples of a stage (the only
    ones that the state holds); ``total`` counts all. Samples have stage, ms, event_id and come in order of event_id."""

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        recent, total, last = held.get if held.exists else ([], 0, -1)
        rows = _fresh(batches, "event_id", last)
        recent = [*recent, *rows["ms"].tolist()][-window:]
        total += len(rows)
        held.update((recent, total, int(rows["event_id"].max()) if len(rows) else last))
        ranked, n = sorted(recent), len(recent)
        at = lambda q: ranked[min(n - 1, round(q * (n - 1)))]
        if n:
            yield pd.DataFrame([(key[0], total, n, at(0.5), at(0.95), recent[-1])], columns=["stage", "total", "count", "p50", "p95", "last"])

    return _with_state(samples.select("stage", "ms", "event_id"), "stage", find, "stage string, total long, count long, p50 double, p95 double, last double", "recent array<double>, total long, last long", None)


def session_state_stream(events: DataFrame, idle: str | None = IDLE) -> DataFrame:
    """session, event_id, state, dwell_s of ``session_states``, when a state has ended; the open one is not out yet.
    Events of a session come in order of event_id."""

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, since, event, last = held.get if held.exists else ("", 0.0, -1, -1)
        rows, out = _fresh(batches, "event_id", last), []
        for event_id, at, kind in zip(rows["event_id"].tolist(), rows["at"].tolist(), rows["type"].tolist(), strict=True):
            last, new = event_id, STATE_OF.get(kind)
            if new is None or new == state:
                continue
            if state:
                out.append((key[0], event, state, at - since))
            state, since, event = new, at, event_id
        held.update((state, since, event, last))
        if out:
            yield pd.DataFrame(out, columns=["session", "event_id", "state", "dwell_s"])

    rows = events.select("session", "event_id", F.col("ts").cast("double").alias("at"), "type", "ts")
    return _with_state(rows, "session", find, "session long, event_id long, state string, dwell_s double", "state string, since double, event long, last long", idle)


def barge_in_stream(events: DataFrame, idle: str | None = IDLE) -> DataFrame:
    """session, event_id: user speech that starts inside a reply, when the reply is done. The state holds the starts
    since the last speech_end, which a reply without an end drops."""

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        is_open, waiting, last = held.get if held.exists else (False, [], -1)
        rows, out, waiting = _fresh(batches, "event_id", last), [], list(waiting)
        for event_id, kind in zip(rows["event_id"].tolist(), rows["type"].tolist(), strict=True):
            last = event_id
            if kind == "speech_end":
                is_open, waiting = True, []
            elif kind == "reply_done":
                out += [(key[0], x) for x in waiting]
                is_open, waiting = False, []
            elif kind == "speech_start" and is_open:
                waiting.append(event_id)
        held.update((is_open, waiting, last))
        if out:
            yield pd.DataFrame(out, columns=["session", "event_id"])

    return _with_state(events.select("session", "event_id", "type", "ts"), "session", find, "session long, event_id long", "open boolean, waiting array<long>, last long", idle)


def floor_stream(series: DataFrame, keep: float = 0.8, ratio: float = 2.0, warm_up: int = 6, idle: str | None = IDLE) -> DataFrame:
    """key, seq, smoothed, floor, noise, present of ``ema_floor``: the recursion carried over micro-batches."""

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, levels, last = held.get if held.exists else (0, [0.0] * len(LEVELS), -1)
        rows = _fresh(batches, "seq", last)
        if len(rows):
            state = {key[0]: (n, np.array(levels, float))}
            found = follow_rows(rows, state, keep=keep, ratio=ratio, warm_up=warm_up)
            n, levels = state[key[0]]
            held.update((n, levels.tolist(), int(rows["seq"].max())))
            yield found

    return _with_state(series.select("key", "seq", "x", "ts"), "key", find, f"key long, seq long, {FLOOR}", "n long, levels array<double>, last long", idle)


def clean_stream(samples: DataFrame, size: int = 512, atten_db: float = 18.0, alpha: float = 0.98, idle: str | None = IDLE, **rules) -> DataFrame:
    """key, n, x, gain of ``clean_series``, as soon as samples are complete: the last hop of a series waits for the next. The
    state is a value for each frequency, a hop of input and a hop of output."""
    cleaner = Cleaner(size, atten_db, alpha, **rules)
    arrays = ("gain", "post", "before", "tail", "pending")

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, first, last = cleaner.start(), None, -1
        if held.exists:
            n, levels, *values, first, last = held.get
            state.update(n=n, levels=np.array(levels, float).reshape(len(LEVELS), -1), **{k: np.array(v, float) for k, v in zip(arrays, values, strict=True)})
        rows = _fresh(batches, "n", last)
        if not len(rows):
            return
        first = int(rows["n"].iloc[0]) if first is None else first
        at = first + (state["n"] - 1) * cleaner.hop
        x, gain = (found[max(0, first - at) :] for found in cleaner.feed(state, rows["x"].to_numpy(float)))
        held.update((int(state["n"]), state["levels"].ravel().tolist(), *(state[k].tolist() for k in arrays), first, int(rows["n"].max())))
        if len(x):
            yield pd.DataFrame({"key": key[0], "n": np.arange(len(x)) + max(first, at), "x": x, "gain": gain})

    state = "count long, levels array<double>, " + ", ".join(f"{k} array<double>" for k in arrays) + ", first long, last long"
    return _with_state(samples.select("key", "n", "x", "ts"), "key", find, CLEAN, state, idle)


def take_stream(frames: DataFrame, rules: TakeRules, delay: str = "10 minutes") -> DataFrame:
    """The takes of ``timed_takes`` as soon as they are over: by a later frame of the key, or by the watermark, which fires
    the timer of a key that has fallen silent. With its take a key's state leaves the store."""

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        take, out = Take(*held.get) if held.exists else None, []
        if held.hasTimedOut:
            out.append(take.row(key[0], rules))
            take = None
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "seq"])
            for seq, at, p in zip(rows["seq"].tolist(), rows["at"].tolist(), rows["p"].tolist(), strict=True):
                if take is not None and at >= take.deadline(rules):
                    out.append(take.row(key[0], rules))
                    take = None
                if take is None or seq > take.last:
                    take = (take or Take(start=at)).heard(seq, at, p, rules)
        if take is None:
            held.remove()
        else:
            held.update(tuple(take))
            held.setTimeoutTimestamp(max(-(-take.deadline(rules) // 1000), held.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "end", "reason", "n_frames"])

    rows = _timed(frames.select("key", "seq", seconds("ts").alias("at"), "p", "ts"), "ts", delay)
    return rows.groupBy("key").applyInPandasWithState(find, TAKES, "start long, seen long, n long, up long, down long, active boolean, last long", "append", GroupStateTimeout.EventTimeTimeout)


def tag_late(frames: DataFrame, arrival: str, idle: str | None = IDLE) -> DataFrame:
    """key, seq, late of every row: whether a row of its key with this or a later sequence number has come before. The
    timer runs on the column ``arrival``, the time at which rows come, so that no late row is dropped unseen."""

    def find(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = held.get if held.exists else (-1,)
        rows = pd.concat(list(batches))
        late = (rows["seq"] <= last) | rows["seq"].duplicated()
        held.update((max(last, int(rows["seq"].max())),))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "late": late.to_numpy()})

    return _with_state(frames.select("key", "seq", arrival), "key", find, "key long, seq long, late boolean", "last long", idle, at=arrival)
