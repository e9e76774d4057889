"""Steps that must see a key's rows one after the other: rows are dealt by key, sorted, and streamed in Arrow batches.

A key's history never becomes one row or one frame; what is carried from batch to batch is the step's state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _same_key(a: tuple | None, b: tuple) -> bool:
    return a is not None and all(x == y or (x is None and y is None) or (x != x and y != y) for x, y in zip(a, b))


def fold(df: DataFrame, keys: list[str], order: list[str], use: list[str], step: Callable[[Any, list[np.ndarray]], tuple[Any, list[int]]], schema: str, last: str | None = None) -> DataFrame:
    """Runs step(state, the used columns) -> (state, places of the rows kept) over each key's rows in order; the state of a new key is None.

    The kept rows come back with the columns of the schema; or, with last, one row for each key that holds its last state
    under that name. Null keys are a key of their own.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for f in frames:
            if not len(f):
                continue
            k = f[keys]
            new = (k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).any(axis=1).to_numpy()
            new[0] = True
            bounds = [*np.flatnonzero(new).tolist(), len(f)]
            names, used = [f[c].to_numpy() for c in keys], [f[c].to_numpy() for c in use]
            kept, ended = [], []
            for a, b in zip(bounds, bounds[1:]):
                now = tuple(x[a] for x in names)
                if not _same_key(key, now):
                    if key is not None:
                        ended.append((*key, state))
                    key, state = now, None
                state, at = step(state, [x[a:b] for x in used])
                kept += [a + i for i in at]
            if last is not None:
                yield pd.DataFrame(ended, columns=[*keys, last])
            else:
                yield f[columns].iloc[kept]
        if last is not None and key is not None:
            yield pd.DataFrame([(*key, state)], columns=[*keys, last])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def spacing(gap: int) -> Callable:
    """A step over times that keeps, from the first row on, each that lies more than `gap` after the last one kept."""

    def step(last: int | None, used: list[np.ndarray]) -> tuple[int, list[int]]:
        times, kept, at = used[0], [], 0
        while True:
            if last is not None:
                at = int(np.searchsorted(times, last + gap, "right"))
            if at >= len(times):
                return last, kept
            kept.append(at)
            last = int(times[at])

    return step


def scan(df: DataFrame, keys: list[str], order: list[str], use: list[str], step: Callable[[Any, list[np.ndarray]], tuple[Any, np.ndarray]], name: str) -> DataFrame:
    """All rows with the column `name` (double): step(state, the used columns) -> (state, values) over each key's rows in order, batch by batch; the state of a new key is None."""
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", `{name}` double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for f in frames:
            if not len(f):
                continue
            k = f[keys]
            new = (k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).any(axis=1).to_numpy()
            new[0] = True
            bounds = [*np.flatnonzero(new).tolist(), len(f)]
            names, used = [f[c].to_numpy() for c in keys], [f[c].to_numpy() for c in use]
            out = np.empty(len(f))
            for a, b in zip(bounds, bounds[1:]):
                now = tuple(x[a] for x in names)
                if not _same_key(key, now):
                    key, state = now, None
                state, out[a:b] = step(state, [x[a:b] for x in used])
            yield f.assign(**{name: out})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
