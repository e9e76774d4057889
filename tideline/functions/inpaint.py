"""Missing cells of frames filled from the rim inward (fast marching; Telea 2004). One frame is one row, so frames of a table fill in parallel."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 3
NEXT = ((-1, 0), (1, 0), (0, -1), (0, 1))


def arrival(t: np.ndarray, done: np.ndarray, y: int, x: int) -> float:
    """When a front of speed one from the done cells reaches (y, x): upwind differences of its neighbours."""
    h, w = t.shape
    side = lambda cells: min((t[a, b] for a, b in cells if 0 <= a < h and 0 <= b < w and done[a, b]), default=math.inf)
    v, u = side([(y - 1, x), (y + 1, x)]), side([(y, x - 1), (y, x + 1)])
    low, high = min(u, v), max(u, v)
    return low + 1 if high - low >= 1 else (low + high + math.sqrt(2 - (high - low) ** 2)) / 2


def slope(f: np.ndarray, done: np.ndarray, y: int, x: int) -> tuple[float, float]:
    """Differences of f between done cells beside (y, x); one-sided at the rim, 0 where there are none."""
    out = []
    for dy, dx in ((1, 0), (0, 1)):
        a, b = (y - dy, x - dx), (y + dy, x + dx)
        ok = [0 <= p < f.shape[0] and 0 <= q < f.shape[1] and bool(done[p, q]) for p, q in (a, b)]
        out.append((f[b] - f[a]) / 2 if all(ok) else f[b] - f[y, x] if ok[1] else f[y, x] - f[a] if ok[0] else 0.0)
    return out[0], out[1]


def filled_cell(f: np.ndarray, t: np.ndarray, done: np.ndarray, y: int, x: int, radius: int) -> float:
    """The weighted mean of what the done cells within the radius foretell: near ones, those along the front's way and those reached about then count most."""
    ny, nx = slope(t, done, y, x)
    total = weight = 0.0
    for a in range(max(0, y - radius), min(f.shape[0], y + radius + 1)):
        for b in range(max(0, x - radius), min(f.shape[1], x + radius + 1)):
            dy, dx = y - a, x - b
            far = dy * dy + dx * dx
            if not done[a, b] or not 0 < far <= radius * radius:
                continue
            along = max(abs(dy * ny + dx * nx) / math.sqrt(far), 1e-6)
            w = along / far / (1 + abs(t[y, x] - t[a, b]))
            gy, gx = slope(f, done, a, b)
            total, weight = total + w * (f[a, b] + gy * dy + gx * dx), weight + w
    return total / weight


def fill(frame: np.ndarray, missing: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The frame with its missing cells filled, nearest to the known ones first (then by row and column); a frame without a known cell stays as it is."""
    f, done = np.where(missing, 0.0, frame), ~missing
    if not missing.any() or not done.any():
        return frame.copy()
    t = np.where(missing, math.inf, 0.0)
    heap: list[tuple[float, int, int]] = []

    def reach(y: int, x: int) -> None:
        for dy, dx in NEXT:
            a, b = y + dy, x + dx
            if 0 <= a < f.shape[0] and 0 <= b < f.shape[1] and not done[a, b] and (new := arrival(t, done, a, b)) < t[a, b]:
                t[a, b] = new
                heapq.heappush(heap, (new, a, b))

    for y, x in np.argwhere(done).tolist():
        reach(y, x)
    while heap:
        at, y, x = heapq.heappop(heap)
        if done[y, x] or at > t[y, x]:
            continue
        f[y, x] = filled_cell(f, t, done, y, x, radius)
        done[y, x] = True
        reach(y, x)
    return f


def inpainted(frame: Column | str, radius: int = RADIUS) -> Column:
    """A frame (array of rows) with its null, NaN and negative cells filled; null and empty frames, and rows of unequal lengths, stay as they are."""

    def run(frames: pd.Series) -> pd.Series:
        out = []
        for x in frames:
            if x is None or not len(x) or len({len(r) for r in x}) > 1 or not len(x[0]):
                out.append(None if x is None else [list(r) for r in x])
                continue
            a = np.array([np.asarray(r, float) for r in x])
            missing = np.isnan(a) | (a < 0)
            out.append(fill(a, missing, radius).tolist())
        return pd.Series(out)

    return F.pandas_udf(run, "array<array<double>>")(F.transform(frame, lambda r: F.transform(r, lambda v: v.cast("double"))))
