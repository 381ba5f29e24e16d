"""Streaming forms give the rows of their batch twins, however the input is cut."""

import random

import numpy as np
import pandas as pd
import pytest

from utterlake.operators import adaptive, endpoint, gates, sessions, takes
from utterlake.streaming import keyed, sources, windows

START = 1_700_000_000


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.random(), START + 60 * n + k) for k in range(4) for n in range(120)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["key", "seq", "p", "t"])).selectExpr("key", "seq", "p", "timestamp_seconds(t) as ts")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("slices", [1, 3, 17])
def test_gate_and_endpoints_do_not_depend_on_the_cut(spark, frames, slices):
    gate = {"on": 0.5, "off": 0.4, "min_on": 2, "min_off": 2}
    found = sources.replay(frames, "ts", lambda s: keyed.gate_stream(s, **gate), slices)
    assert rows_of(found, "key", "seq", "active") == rows_of(gates.hysteresis_gate(frames, **gate), "key", "seq", "active")
    rules = endpoint.EndpointRules(start=2, end=2, pre_roll=2, cap=8, least=4)
    found = sources.replay(frames, "ts", lambda s: keyed.endpoint_stream(s, rules), slices)
    assert rows_of(found, "key", "event", "start_seq", "end_seq") == rows_of(endpoint.endpoints(frames, rules), "key", "event", "start_seq", "end_seq")


def test_frames_cross_block_edges(spark):
    samples = spark.createDataFrame([(1, n, float(n)) for n in range(50)] + [(2, n, 0.0) for n in range(3)], "key long, n long, x double").selectExpr("*", "timestamp_seconds(1700000000 + n) as ts")
    found = sources.replay(samples, "n", lambda s: keyed.frame_stream(s, 10, 4), 7)
    got = {(r.key, r.frame): r.x for r in found.collect()}
    assert got == {(1, f): [float(x) for x in range(4 * f, 4 * f + 10)] for f in range(11)}


def plain_floor(xs):
    """The recursion for one series, a value at a time."""
    out, mean, smooth, low, presence, noise = [], 0.0, 0.0, 0.0, 0.0, 0.0
    for i, x in enumerate(xs):
        if i < 6:
            mean += (x - mean) / (i + 1)
            smooth = low = noise = mean
            out.append((mean, mean, mean, False))
            continue
        last, smooth = smooth, 0.8 * smooth + 0.2 * x
        low = smooth if smooth <= low else 0.998 * low + 0.002 / 0.04 * (smooth - 0.96 * last)
        on = smooth > 2 * max(low, 1e-12)
        presence = 0.2 * presence + 0.8 * on
        keep = 0.95 + 0.05 * presence
        noise = min(keep * noise + (1 - keep) * x, 1.5 * low)
        out.append((smooth, low, noise, on))
    return out


def test_floor_of_a_stream_and_of_a_step_by_step_series(spark, frames):
    series = frames.withColumnRenamed("p", "x")
    rows = sorted((r.key, r.seq, r.x) for r in series.collect())
    want = [(k, n, *f) for k in range(4) for n, f in enumerate(plain_floor([x for key, _, x in rows if key == k]))]
    columns = ["key", "seq", "smoothed", "floor", "noise", "present"]
    close = lambda got: [pytest.approx(g, abs=1e-12) for g in got] == want
    assert close(rows_of(adaptive.ema_floor(series), *columns))
    assert close(rows_of(sources.replay(series, "ts", keyed.floor_stream, 5), *columns))
    assert adaptive.ema_floor(series.limit(0)).count() == 0


def plain_clean(x, size, least_db, alpha=0.98):
    """Cleaning of one series with the floor of each frequency by ``plain_floor``'s recursion, frame by frame."""
    hop, least = size // 2, 10 ** (-least_db / 20)
    window = np.sqrt(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size))
    padded = np.concatenate([np.zeros(hop), x, np.zeros(2 * size)])
    starts = range(0, (len(x) + hop - 1) // hop * hop + 1, hop)
    spectra = np.array([np.fft.rfft(padded[s : s + size] * window) for s in starts])
    power, out, gains = np.abs(spectra) ** 2, np.zeros(len(padded) + size), []
    floors = [plain_floor(power[:, b].tolist()) for b in range(hop + 1)]
    presence = np.zeros(hop + 1)
    gain, post = np.ones(hop + 1), np.ones(hop + 1)
    t = np.linspace(0, 1, 4001)
    for k, s in enumerate(starts):
        noise = np.maximum([f[k][2] for f in floors], 1e-12)
        if k >= 6:
            presence = 0.2 * presence + 0.8 * np.array([f[k][3] for f in floors])
        new = np.minimum(power[k] / noise, 1e4)
        xi = np.maximum(alpha * gain**2 * post + (1 - alpha) * np.maximum(new - 1, 0), 1e-4)
        v = np.clip(xi / (1 + xi) * new, 1e-8, 500)
        e1 = np.array([np.trapezoid(np.exp(-a - a * t / (1.0000001 - t)) / (a + a * t / (1.0000001 - t)) * a / (1.0000001 - t) ** 2, t) if a > 1 else adaptive.exponential_integral(np.array([a]))[0] for a in v])
        full = np.minimum(xi / (1 + xi) * np.exp(e1 / 2), 1)
        q = np.clip(1 - presence, 0.02, 0.98)
        p = 1 / (1 + q / (1 - q) * (1 + xi) * np.exp(-v))
        gain, post = np.clip(full**p * least ** (1 - p), least, 1), new
        out[s : s + size] += np.fft.irfft(spectra[k] * gain, size) * window
        gains.append(gain.mean())
    return out[hop : hop + len(x)], [gains[n // hop + 1] for n in range(len(x))]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, n in ((1, 500), (2, 33), (3, 1), (4, 512), (5, 16)):
        x = 0.1 * rng.standard_normal(n) + np.where(np.arange(n) % 200 > 120, np.sin(np.arange(n) * 0.7), 0)
        rows += [(key, i + 7 * key, float(v), START + i) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key long, n long, x double, t long").selectExpr("key", "n", "x", "timestamp_seconds(t) as ts")


def by_key(df):
    got = df.toPandas().sort_values(["key", "n"])
    return {k: g for k, g in got.groupby("key")}


def test_cleaning_equals_the_plain_form(spark, noisy):
    source, got = by_key(noisy), by_key(adaptive.clean_series(noisy, 32))
    for key, g in source.items():
        x, gains = plain_clean(g["x"].to_numpy(), 32, 18.0)
        assert got[key]["n"].tolist() == g["n"].tolist()
        np.testing.assert_allclose(got[key]["x"], x, atol=2e-4)
        np.testing.assert_allclose(got[key]["gain"], gains, atol=2e-4)
    assert adaptive.clean_series(noisy.limit(0), 32).count() == 0


def test_cleaning_that_takes_nothing_away(spark, noisy):
    got = by_key(adaptive.clean_series(noisy, 32, 0.0))
    for key, g in by_key(noisy).items():
        np.testing.assert_allclose(got[key]["x"], g["x"], atol=1e-12)


@pytest.mark.parametrize("slices", [1, 3, 17])
def test_a_cleaned_stream_does_not_depend_on_the_cut(spark, noisy, slices):
    stream, table = by_key(sources.replay(noisy, "ts", lambda s: keyed.clean_stream(s, 32), slices)), by_key(adaptive.clean_series(noisy, 32))
    for key, g in table.items():
        done = len(g) // 16 * 16 - 16
        assert (key in stream) == (done > 0)
        if done > 0:
            assert stream[key]["n"].tolist() == g["n"].tolist()[:done]
            np.testing.assert_allclose(stream[key][["x", "gain"]], g[["x", "gain"]][:done], atol=1e-12)


def test_exponential_integral():
    for x, want in ((0.1, 1.8229239584), (0.5, 0.5597735948), (1.0, 0.2193839344), (2.0, 0.0489005107), (10.0, 4.15697e-6)):
        assert adaptive.exponential_integral(np.array([x]))[0] == pytest.approx(want, rel=1e-4)


def test_late_rows_go_to_the_side_and_change_nothing(spark, frames, tmp_path):
    again = frames.where("seq = 7").selectExpr("key", "seq", "1.0 as p", "ts + interval 1 day as ts")
    both = frames.unionByName(again)
    sources.write_slices(both, f"{tmp_path}/in", "ts", 3)
    tagged = keyed.tag_late(sources.event_source(spark, f"{tmp_path}/in", both.schema), "ts")
    sources.append_split(tagged, "late", f"{tmp_path}/main", f"{tmp_path}/side", f"{tmp_path}/checkpoint")
    assert rows_of(spark.read.parquet(f"{tmp_path}/side"), "key", "seq") == [(k, 7) for k in range(4)]
    assert rows_of(spark.read.parquet(f"{tmp_path}/main"), "key", "seq") == rows_of(frames, "key", "seq")
    found = sources.replay(both, "ts", lambda s: keyed.gate_stream(s, 0.5, 0.4, 2, 2))
    assert rows_of(found, "key", "seq", "active") == rows_of(gates.hysteresis_gate(frames, 0.5, 0.4, 2, 2), "key", "seq", "active")


FORMS = {
    "endpoint": lambda s: keyed.endpoint_stream(s, endpoint.EndpointRules(start=2, end=2), idle="20 minutes"),
    "gate": lambda s: keyed.gate_stream(s, idle="20 minutes"),
    "frame": lambda s: keyed.frame_stream(s.selectExpr("key", "seq as n", "p as x", "ts"), 10, 4, idle="20 minutes"),
    "session": lambda s: keyed.session_state_stream(s.selectExpr("key as session", "seq as event_id", "'speech_start' as type", "ts"), idle="20 minutes"),
    "barge-in": lambda s: keyed.barge_in_stream(s.selectExpr("key as session", "seq as event_id", "'speech_end' as type", "ts"), idle="20 minutes"),
    "floor": lambda s: keyed.floor_stream(s.withColumnRenamed("p", "x"), idle="20 minutes"),
    "clean": lambda s: keyed.clean_stream(s.selectExpr("key", "seq as n", "p as x", "ts"), 8, idle="20 minutes"),
}


@pytest.mark.parametrize("name", FORMS)
def test_an_idle_key_leaves_the_store(spark, frames, tmp_path, name):
    """Keys 0 and 1 fall silent after 30 minutes; at the end only the other two are held."""
    rows = frames.where("key > 1 or seq < 30")
    sources.write_slices(rows, f"{tmp_path}/in", "ts", 4)
    stream = FORMS[name](sources.event_source(spark, f"{tmp_path}/in", rows.schema))
    query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda batch, number: batch.count() and None).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) == 4 and held[-1] == 2


def plain_takes(frames, rules):
    """Takes by a list of frames for each key and a clock."""
    out = []
    for key, rows in frames.items():
        start = seen = None
        n = up = down = 0
        on = False
        for at, p in [*rows, (None, 0.0)]:
            if start is not None:
                end = start + rules.most
                why = "cap"
                if seen is None and start + rules.lead <= end:
                    end, why = start + rules.lead, "nothing heard"
                if seen is not None and seen + rules.quiet < end:
                    end, why = seen + rules.quiet, "quiet"
                if at is None or at >= end:
                    out.append((key, start, end, why, n))
                    start = seen = None
                    n = up = down = 0
                    on = False
            if at is None:
                break
            start = at if start is None else start
            n += 1
            up, down = (up + 1) * (p > rules.on), (down + 1) * (p < rules.off)
            on = up == rules.min_on or (on and down != rules.min_off)
            seen = at if on else seen
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 3, 17])
def test_timed_takes(spark, slices):
    rng, second = random.Random(8), 1_000_000
    talk = {1: [rng.random() for _ in range(300)], 2: [0.9] * 300, 3: [0.1] * 300, 4: [0.9] * 20 + [0.1] * 10}
    rows = [(k, i, p, START * second + (i * 100_000 + k)) for k, ps in talk.items() for i, p in enumerate(ps)]
    rows += [(5, i, 0.9, START * second + 60 * second + i) for i in range(3)]  # moves the watermark on
    frames = spark.createDataFrame(rows, "key long, seq long, p double, us long").selectExpr("key", "seq", "p", "timestamp_micros(us) as ts")
    rules = takes.TakeRules(min_on=2, min_off=2)
    want = plain_takes({k: [(us, p) for key, _, p, us in rows if key == k] for k in (1, 2, 3, 4, 5)}, rules)
    assert {r[3] for r in want} == {"quiet", "nothing heard", "cap"}
    columns = ["key", "start", "end", "reason", "n_frames"]
    assert rows_of(takes.timed_takes(frames, rules), *columns) == want
    found = sources.replay(frames, "ts", lambda s: keyed.take_stream(s, rules, "1 second"), slices)
    assert rows_of(found, *columns) == [r for r in want if r[0] != 5]
    assert takes.timed_takes(frames.limit(0), rules).count() == 0


def test_watermark_drops_repeats(spark, frames):
    found = sources.replay(frames.unionByName(frames.where("seq < 5")), "ts", lambda s: keyed.watermarked(s).select("key", "seq"))
    assert rows_of(found, "key", "seq") == rows_of(frames, "key", "seq")


def test_a_run_that_is_killed_goes_on_where_it_was(spark, frames, tmp_path):
    base = str(tmp_path)
    sources.write_slices(frames, f"{base}/in", "ts", 4)

    def form():
        return keyed.gate_stream(sources.event_source(spark, f"{base}/in", frames.schema), 0.5, 0.4, 2, 2)

    def die(batch, number):
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        sources.append_batches(form(), f"{base}/out", f"{base}/checkpoint", also=die)
    sources.append_batches(form(), f"{base}/out", f"{base}/checkpoint")
    assert rows_of(spark.read.parquet(f"{base}/out"), "key", "seq", "active") == rows_of(gates.hysteresis_gate(frames, 0.5, 0.4, 2, 2), "key", "seq", "active")


def test_sessions_and_replies(spark):
    rng = random.Random(2)
    kinds = ["speech_start", "speech_end", "tts_start", "reply_done", "interrupted"]
    rows = [(s, START + 10 * i + s, 10 * i + s, rng.choice(kinds)) for s in range(3) for i in range(80)]
    events = spark.createDataFrame(rows, "session long, t long, event_id long, type string").selectExpr("session", "timestamp_seconds(t) as ts", "event_id", "type")
    found = sources.replay(events, "ts", keyed.barge_in_stream, 5)
    assert rows_of(found, "session", "event_id") == rows_of(sessions.barge_ins(events), "session", "event_id")
    found = sources.replay(events, "ts", keyed.session_state_stream, 5)
    assert rows_of(found, "session", "event_id", "state", "dwell_s") == rows_of(sessions.session_states(events).where("dwell_s is not null"), "session", "event_id", "state", "dwell_s")


def test_takes_of_a_stream_close_behind_the_watermark(spark, frames):
    active = frames.where("p > 0.9")
    table = rows_of(windows.takes(active, "3 minutes"), "key", "start", "end", "n")
    stream = rows_of(sources.replay(active, "ts", lambda s: windows.takes(s, "3 minutes")), "key", "start", "end", "n")
    assert set(stream) <= set(table) and len(table) - len(stream) <= 12
