"""Table functions for SQL: featurizers and scorers over TABLE(...) PARTITION BY key ORDER BY time.

They see a key's rows one after the other and hold a window of them. Whole columns are faster by the DataFrame operators; these
are for queries that are written in SQL alone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _key(table: AnalyzeArgument, key: AnalyzeArgument, *others: AnalyzeArgument):
    """The key column's field; all named columns must be there."""
    for x in (key, *others):
        if not isinstance(x.value, str) or x.value not in table.dataType.fieldNames():
            raise ValueError(f"no column {x.value!r} in the table")
    return table.dataType[key.value]


class HopFeatures:
    """hop_features(TABLE(t) PARTITION BY k ORDER BY t, key => 'k', time => 't', value => 'v', size => .., slide => ..): k, window_end, n, mean, low, high of
    every non-empty window [end - size, end), times in microseconds. Rows without a time or value are left out."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, value: AnalyzeArgument, size: AnalyzeArgument, slide: AnalyzeArgument) -> AnalyzeResult:
        field = _key(table, key, time, value)
        if not size.value or not slide.value or size.value % slide.value:
            raise ValueError("the size must be a multiple of the slide")
        s = StructType().add(field.name, field.dataType).add("window_end", LongType()).add("n", LongType())
        return AnalyzeResult(s.add("mean", DoubleType()).add("low", DoubleType()).add("high", DoubleType()))

    def __init__(self):
        self.held, self.end, self.name = deque(), None, None

    def _close(self) -> Iterator[tuple]:
        v = [x for t, x in self.held if t < self.end]
        if v:
            yield self.name, self.end, len(v), sum(v) / len(v), min(v), max(v)

    def _advance(self) -> None:
        self.end += self.slide
        while self.held and self.held[0][0] < self.end - self.size:
            self.held.popleft()

    def eval(self, row, key, time, value, size, slide) -> Iterator[tuple]:
        t, v = row[time], row[value]
        if t is None or v is None:
            return
        self.name, self.size, self.slide = row[key], size, slide
        while self.end is not None and self.end <= t and self.held:
            yield from self._close()
            self._advance()
        if not self.held:
            self.end = (t // slide + 1) * slide
        self.held.append((t, float(v)))

    def terminate(self) -> Iterator[tuple]:
        while self.held:
            yield from self._close()
            self._advance()


class DecayedScores:
    """decayed_scores(TABLE(t) PARTITION BY k ORDER BY t, key => 'k', id => 'i', value => 'v', decay => 0.9): k, i, score: each value's distance from the decayed mean of those before it,
    in decayed deviations; null for the first, 0 where nothing has deviated yet. Rows without a value are left out."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, id: AnalyzeArgument, value: AnalyzeArgument, decay: AnalyzeArgument) -> AnalyzeResult:  # noqa: A002
        field = _key(table, key, id, value)
        if not 0 < float(decay.value) < 1:
            raise ValueError("the decay lies between 0 and 1")
        other = table.dataType[id.value]
        return AnalyzeResult(StructType().add(field.name, field.dataType).add(other.name, other.dataType).add("score", DoubleType()))

    def __init__(self):
        self.mean, self.var = None, 0.0

    def eval(self, row, key, id, value, decay) -> Iterator[tuple]:  # noqa: A002
        if row[value] is None:
            return
        v, keep = float(row[value]), float(decay)
        if self.mean is None:
            self.mean, score = v, None
        else:
            far = v - self.mean
            score = abs(far) / self.var**0.5 if self.var > 0 else 0.0
            self.mean += (1 - keep) * far
            self.var = keep * (self.var + (1 - keep) * far * far)
        yield row[key], row[id], score


#: Name in SQL -> table function.
TABLE_FUNCTIONS = {"hop_features": HopFeatures, "decayed_scores": DecayedScores}


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to a session's SQL; gives their names."""
    for name, cls in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
    return list(TABLE_FUNCTIONS)
