"""Filters of series: recursive band-pass in second-order sections with a carried state, and least-squares smoothing as window frames."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.sequential import scan

#: Samples filtered at a time: a block is two matrix products instead of a loop over samples.
BLOCK = 64


@lru_cache(maxsize=32)
def band_sections(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of the Butterworth band-pass whose low-pass prototype has the order given."""
    # edges warped for the bilinear transform
    w1, w2 = (2 * rate * math.tan(math.pi * f / rate) for f in (low, high))
    centre, width = math.sqrt(w1 * w2), w2 - w1
    prototype = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = prototype * width / 2
    root = np.sqrt(half * half - centre * centre + 0j)
    analog = np.concatenate([half + root, half - root])
    poles = (2 * rate + analog) / (2 * rate - analog)
    # each section has a conjugate pair of poles, and zeros at 1 and -1
    upper = sorted((p for p in poles if p.imag > 0), key=abs)
    if len(upper) != order:
        raise ValueError("a band so wide that its poles are real is not supported")
    middle = np.exp(2j * np.pi * math.atan(centre / (2 * rate)) / math.pi)
    out = []
    for p in upper:
        a1, a2 = -2 * p.real, abs(p) ** 2
        gain = abs((1 + a1 / middle + a2 / middle**2) / (1 - 1 / middle**2))
        out.append((gain, 0.0, -gain, a1, a2))
    sos = np.array(out)
    sos.setflags(write=False)
    return sos


class Cascade:
    """Sections one after the other, as one linear system x' = A x + B u, y = C x + D u, run block by block."""

    def __init__(self, sos: np.ndarray):
        n = 2 * len(sos)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for i, (b0, b1, b2, a1, a2) in enumerate(sos):
            # this section's input is c x + d u of those before it; transposed direct form II
            k = 2 * i
            a[k], a[k + 1] = (b1 - a1 * b0) * c, (b2 - a2 * b0) * c
            b[k], b[k + 1] = (b1 - a1 * b0) * d, (b2 - a2 * b0) * d
            a[k, k] -= a1
            a[k, k + 1] += 1
            a[k + 1, k] -= a2
            c, d = b0 * c, b0 * d
            c[k] += 1
        self.states = n
        seen, reach = [c], [b]
        power = [np.eye(n)]
        for _ in range(BLOCK):
            seen.append(seen[-1] @ a)
            reach.append(a @ reach[-1])
            power.append(power[-1] @ a)
        self.seen, self.reach, self.power = np.array(seen[:BLOCK]), np.array(reach[:BLOCK]), power
        answer = np.r_[d, self.reach[: BLOCK - 1] @ c]
        self.answer = np.array([[answer[i - j] if i >= j else 0.0 for j in range(BLOCK)] for i in range(BLOCK)])

    def run(self, state: np.ndarray | None, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state or None for rest, samples) -> (state after them, filtered samples)."""
        x, y = np.zeros(self.states) if state is None else state, np.empty(len(u))
        for i in range(0, len(u), BLOCK):
            part = u[i : i + BLOCK]
            r = len(part)
            y[i : i + r] = self.answer[:r, :r] @ part + self.seen[:r] @ x
            x = self.power[r] @ x + self.reach[:r][::-1].T @ part
        return x, y


@lru_cache(maxsize=32)
def cascade(low: float, high: float, rate: float, order: int = 4) -> Cascade:
    return Cascade(band_sections(low, high, rate, order))


def band_filtered(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, low: float = 0.5, high: float = 3.0, rate: float = 50.0, sections: int = 4) -> DataFrame:
    """Adds the band-passed value: each key's rows in order, from rest; only the filter's state is carried from batch to batch. Nulls and NaN count as 0."""

    def step(state, used):
        return cascade(low, high, rate, sections).run(state, np.nan_to_num(used[0].astype(float)))

    return scan(df, keys, order, [value], step, name)


def smoothing_weights(window: int, degree: int) -> np.ndarray:
    """Row o: the weights of a window's values in the least-squares polynomial's value at the window's o-th place."""
    x = np.arange(window) - window // 2
    v = np.vander(x, degree + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, window: int = 5, degree: int = 2) -> DataFrame:
    """Adds the Savitzky-Golay value: a polynomial fitted to the `window` values around a row; the first and last rows take theirs from the first and last whole window.

    One sort by key serves all frames. Keys of at most `window` rows keep their values.
    """
    if window % 2 == 0 or degree >= window:
        raise ValueError("the window must be odd and longer than the degree")
    weights, half = smoothing_weights(window, degree), window // 2
    w = Window.partitionBy(*keys).orderBy(*order)
    near = {k: F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) for k in range(-2 * half, 2 * half + 1)}
    d = df.withColumns({"_rn": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys)), **{f"_x{k + 2 * half}": c for k, c in near.items()}})
    # the row's place in its window, counted from the middle
    off = F.when(F.col("_rn") <= half, F.col("_rn") - half - 1).when(F.col("_rn") > F.col("_n") - half, F.col("_rn") - F.col("_n") + half).otherwise(0)
    out = F.when(F.col("_n") <= window, F.col(value))
    for o in range(-half, half + 1):
        fit = sum((F.lit(float(weights[o + half, k + half])) * F.col(f"_x{k - o + 2 * half}") for k in range(-half, half + 1)), F.lit(0.0))
        out = out.when(off == o, fit)
    return d.withColumn(name, out).drop("_rn", "_n", *[f"_x{i}" for i in range(4 * half + 1)])


def turns(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, turns: how often the smoothed value changes between rising (or level) and falling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = smoothed(df, keys, order, value, "_s")
    d = d.withColumn("_down", (F.col("_s") - F.lag("_s").over(w)) < 0)
    d = d.withColumn("_turn", F.col("_down") != F.lag("_down").over(w))
    return d.groupBy(*keys).agg(F.count_if("_turn").alias("turns"))
