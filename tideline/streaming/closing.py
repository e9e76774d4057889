"""Hopping windows that are emitted once, when the watermark has passed their end, by keyed list state and event-time timers.

For features that need a window's rows themselves (and not only sums, which streams.hop_windows has). A key's state holds the rows of its open
windows and nothing older; a key without open windows holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keyed list state and timers need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def row_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in STORE."""
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE[0], before)


Feature = Callable[[np.ndarray, np.ndarray], dict[str, float]]


def spread(t: np.ndarray, v: np.ndarray) -> dict[str, float]:
    """Number, mean, ends and median of a window's values."""
    # one sort instead of numpy's median, which costs more than all the rest on the few values of a window
    s = np.sort(v)
    return {"n": float(len(v)), "mean": float(v.mean()), "low": float(s[0]), "high": float(s[-1]), "median": float((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2)}


#: A held row: its time and value, and the first window end that it still counts for.
ROW = np.dtype([("t", "<i8"), ("v", "<f8"), ("since", "<i8")])
#: Rows of one entry of the list state.
PACKED = 100_000


class ClosingWindows(StatefulProcessor):
    """Rows (t in microseconds, v) wait in list state, packed; a timer stands at the key's next window end, and one at its last.

    Every call of the state or of timers goes to the JVM and back. So a key is read once when the watermark has moved, and all of its windows
    that were passed go out together, instead of a reading and a timer for every window.
    """

    def __init__(self, key: str, size: int, slide: int, feature: Feature):
        self.key, self.size, self.slide, self.feature = key, size, slide, feature

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")

    def _timers(self, *ends: int) -> None:
        for e in {e // 1000 for e in ends} - set(self.handle.listTimers()):
            self.handle.registerTimer(e)

    def _last(self, t: np.ndarray) -> np.ndarray:
        return t // self.slide * self.slide + self.size

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        ends = []
        for f in rows:
            f = f.dropna(subset=["t", "v"])
            x = np.empty(len(f), ROW)
            x["t"], x["v"] = f["t"].to_numpy(), f["v"].to_numpy()
            # windows that the watermark has passed are out already: a late row enters only those that are open
            x["since"] = np.maximum(x["t"] // self.slide * self.slide, closed // self.slide * self.slide) + self.slide
            x = x[x["since"] <= self._last(x["t"])]
            if len(x):
                self.rows.appendList([(x.tobytes(),)])
                ends += [int(x["since"].min()), int(self._last(x["t"]).max())]
        if ends:
            self._timers(min(ends), max(ends))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.slide * self.slide
        held = [np.frombuffer(p, ROW) for (p,) in self.rows.get()] if self.rows.exists() else []
        if not held:
            return
        x = np.concatenate(held)
        x = x[np.lexsort((x["v"], x["t"]))]
        t, v, since = (np.ascontiguousarray(x[n]) for n in ROW.names)
        last = self._last(t)
        spans = np.unique(np.stack([since, np.minimum(last, passed)], axis=1), axis=0)
        ends = np.unique(np.concatenate([np.arange(a, b + 1, self.slide) for a, b in spans.tolist()]))
        if not len(ends):
            # an earlier timer of this batch has emitted them
            return
        out = []
        for end, i, j in zip(ends.tolist(), np.searchsorted(t, ends - self.size).tolist(), np.searchsorted(t, ends).tolist()):
            counts = since[i:j] <= end
            out.append({self.key: key[0], "window_end": end, **self.feature(t[i:j][counts], v[i:j][counts])})
        # what no open window reaches goes
        left = x[last > passed]
        if len(left):
            left["since"] = np.maximum(left["since"], passed + self.slide)
            self.rows.put([(left[i : i + PACKED].tobytes(),) for i in range(0, len(left), PACKED)])
            self._timers(int(left["since"].min()))
        else:
            self.rows.clear()
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def closing_windows(stream: DataFrame, key: str, t: str, value: str, time: str, size: int, slide: int, feature: Feature = spread, names: tuple[str, ...] = ("n", "mean", "low", "high", "median")) -> DataFrame:
    """key, window_end and the feature's columns of every non-empty window [end - size, end), once, after the watermark of column `time`.

    t is the row's time in microseconds, size and slide are whole milliseconds in microseconds. Rows without a time or value are left out; a row later than the watermark's
    delay counts in the windows that are still open. Runs in append mode, and needs STORE.
    """
    if size % 1000 or slide % 1000 or size % slide:
        raise ValueError("size and slide must be whole milliseconds, and size a multiple of slide")
    kind = dict(stream.dtypes)[key]
    d = stream.selectExpr(key, f"{t} AS t", f"cast({value} AS double) AS v", time)
    schema = f"{key} {kind}, window_end long, " + ", ".join(f"{n} double" for n in names)
    return d.groupBy(key).transformWithStateInPandas(ClosingWindows(key, size, slide, feature), schema, "append", "EventTime")
