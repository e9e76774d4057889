"""Windows closed by the watermark: each once, late rows where windows are open, and no state left behind."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.streaming import closing, streams

S = 1_000_000
ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def store(spark):
    with closing.row_store(spark):
        yield


def run(spark, tmp_path, batches, delay, size, slide):
    for i, rows in enumerate(batches):
        d = spark.createDataFrame([(k, ZERO + dt.timedelta(seconds=t) if t is not None else None, v) for k, t, v in rows], "k string, ts timestamp, v double")
        d.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    s = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*")).withWatermark("ts", delay)
    s = s.withColumn("t", F.unix_micros("ts"))
    return streams.drain(closing.closing_windows(s, "k", "t", "v", "ts", size, slide), "closing")


def batchwise(rows, upto, size, slide):
    out = defaultdict(list)
    zero = int(ZERO.timestamp()) * S
    for k, t, v in rows:
        if t is None or v is None:
            continue
        t = zero + int(t * S)
        for e in range((t // slide + 1) * slide, t + size + 1, slide):
            if e <= zero + int(upto * S):
                out[k, e].append(v)
    return sorted((k, e, float(len(v)), round(float(np.mean(v)), 9), min(v), max(v), float(np.median(v))) for (k, e), v in out.items() if k is not None)


def result(d):
    return sorted((r.k, r.window_end, r.n, round(r.mean, 9), r.low, r.high, r.median) for r in d.collect())


def test_each_window_once_and_out_of_order(spark, tmp_path, store):
    rng = np.random.default_rng(3)
    rows = [("ab"[int(rng.integers(0, 2))], float(t) + round(float(rng.uniform(-4, 4)), 3), float(rng.integers(0, 50))) for t in range(20, 200)]
    rows += [("a", 90.0, None), (None, 50.0, 4.0)]
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[("end", 1000.0, 0.0)]]
    got = result(run(spark, tmp_path, batches, "10 seconds", 10 * S, 5 * S).where("k <> 'end'"))
    assert got == batchwise(rows, 990, 10 * S, 5 * S) and len({x[:2] for x in got}) == len(got)


def test_late_rows_count_only_where_windows_are_open(spark, tmp_path, store):
    batches = [[("a", 1.0, 1.0), ("a", 22.0, 2.0)], [("a", 30.5, 9.0)], [("a", 3.0, 100.0), ("a", 28.0, 7.0)], [("a", 100.0, 0.0)], [("b", 200.0, 0.0)]]
    got = [(x[1] // S - int(ZERO.timestamp()), x[2], x[5]) for x in result(run(spark, tmp_path, batches, "5 seconds", 10 * S, 10 * S)) if x[0] == "a"]
    assert got == [(10, 1.0, 1.0), (30, 2.0, 7.0), (40, 1.0, 9.0), (110, 1.0, 0.0)]


class Kept(list):
    """List state and timers in memory, to look at what a processor leaves."""

    def exists(self):
        return bool(self)

    def get(self):
        return iter(list(self))

    def appendList(self, rows):  # noqa: N802
        self.extend(rows)

    def put(self, rows):
        self[:] = rows


def test_state_is_pruned_and_empty_at_the_end():
    import pandas as pd

    class Handle:
        rows, timers = Kept(), set()
        getListState = lambda self, *a: self.rows
        listTimers = lambda self: iter(sorted(self.timers))
        registerTimer = lambda self, t: self.timers.add(t)

    class Now:
        at = 0
        getCurrentWatermarkInMs = lambda self: self.at
        getExpiryTimeInMs = lambda self: self.at

    h, now = Handle(), Now()
    p = closing.ClosingWindows("k", 20 * S, 5 * S, closing.spread)
    p.init(h)
    most, seen = 0, []
    for step in range(200):
        list(p.handleInputRows(("a",), iter([pd.DataFrame({"t": [step * S], "v": [float(step)]})]), now))
        for at in sorted(x for x in h.timers if x <= (step - 3) * 1000):
            now.at = at
            seen += [f.window_end.iloc[0] for f in p.handleExpiredTimer(("a",), now, now)]
            h.timers.discard(at)
        most = max(most, len(h.rows))
    for at in sorted(h.timers):
        now.at = at
        seen += [f.window_end.iloc[0] for f in p.handleExpiredTimer(("a",), now, now)]
        h.timers.discard(at)
    assert most <= 30 and not h.rows and seen == [e * S for e in range(5, 220, 5)]


class Counted:
    """A handle that keeps rows and timers in memory and counts what is asked of it."""

    def __init__(self):
        self.rows, self.timers, self.calls = Kept(), set(), 0

    def getListState(self, *a):  # noqa: N802
        return self.rows

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, t):  # noqa: N802
        self.calls += 1
        self.timers.add(t)


class At:
    def __init__(self, watermark, expiry=0):
        self.watermark, self.expiry = watermark, expiry

    getCurrentWatermarkInMs = lambda self: self.watermark
    getExpiryTimeInMs = lambda self: self.expiry


def fire(p, h, watermark):
    """All timers that the watermark has passed, as Spark calls them: those of the batch's start, in order, each deleted after its call."""
    out = []
    for at in sorted(x for x in h.timers if x <= watermark):
        out += [r for f in p.handleExpiredTimer(("a",), At(watermark), At(watermark, at)) for r in f.to_dict("records")]
        h.timers.discard(at)
    return out


def test_a_key_takes_few_calls_however_many_windows_close():
    import pandas as pd

    h = Counted()
    p = closing.ClosingWindows("k", 20 * S, 5 * S, closing.spread)
    p.init(h)
    t = np.arange(0, 5000, 5)
    list(p.handleInputRows(("a",), iter([pd.DataFrame({"t": t * S, "v": t.astype(float)})]), At(0)))
    got = fire(p, h, 4000 * 1000)
    assert [r["window_end"] // S for r in got] == list(range(5, 4001, 5)) and {r["n"] for r in got[3:]} == {4.0}
    got = fire(p, h, 6000 * 1000)
    assert [r["window_end"] // S for r in got] == list(range(4005, 5016, 5)) and not h.rows and not h.timers
    assert h.calls <= 20


def test_windows_that_are_out_stay_out():
    import pandas as pd

    h = Counted()
    p = closing.ClosingWindows("k", 20 * S, 5 * S, closing.spread)
    p.init(h)
    feed = lambda t, v, mark: list(p.handleInputRows(("a",), iter([pd.DataFrame({"t": [t * S], "v": [v]})]), At(mark * 1000)))
    feed(1, 1.0, 0)
    feed(30, 2.0, 0)
    assert [(r["window_end"] // S, r["n"]) for r in fire(p, h, 12_000)] == [(5, 1.0), (10, 1.0)]
    # late: the windows to 5 and 10 are out, that to 15 goes out now, in the batch of the row's arrival
    feed(4, 9.0, 15)
    assert [(r["window_end"] // S, r["n"], r["high"]) for r in fire(p, h, 15_000)] == [(15, 1.0, 1.0)]
    assert [(r["window_end"] // S, r["n"], r["high"]) for r in fire(p, h, 100_000)] == [(20, 2.0, 9.0), (35, 1.0, 2.0), (40, 1.0, 2.0), (45, 1.0, 2.0), (50, 1.0, 2.0)]
    assert not h.rows and not h.timers
