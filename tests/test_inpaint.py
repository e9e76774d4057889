"""Filling from the rim inward against a version that relaxes arrival times over the whole frame and sorts the cells."""

import math

import numpy as np
import pytest

from tideline.functions import inpaint


def relaxed(missing):
    """Arrival times by repeated sweeps until none changes."""
    h, w = missing.shape
    t = np.where(missing, math.inf, 0.0)
    while True:
        old = t.copy()
        for y in range(h):
            for x in range(w):
                if missing[y, x]:
                    u = min(t[y, x - 1] if x else math.inf, t[y, x + 1] if x + 1 < w else math.inf)
                    v = min(t[y - 1, x] if y else math.inf, t[y + 1, x] if y + 1 < h else math.inf)
                    if min(u, v) < math.inf:
                        new = min(u, v) + 1 if abs(u - v) >= 1 or max(u, v) == math.inf else (u + v + math.sqrt(2 - (u - v) ** 2)) / 2
                        t[y, x] = min(t[y, x], new)
        if np.array_equal(old, t):
            return t


def gradient(f, known, y, x):
    g = []
    for axis in (0, 1):
        step = np.eye(2, dtype=int)[axis]
        lo, hi = np.array([y, x]) - step, np.array([y, x]) + step
        has = lambda p: (p >= 0).all() and (p < f.shape).all() and known[tuple(p)]
        if has(lo) and has(hi):
            g.append((f[tuple(hi)] - f[tuple(lo)]) / 2)
        elif has(hi):
            g.append(f[tuple(hi)] - f[y, x])
        elif has(lo):
            g.append(f[y, x] - f[tuple(lo)])
        else:
            g.append(0.0)
    return np.array(g)


def brute(frame, missing, radius):
    t, f, known = relaxed(missing), np.where(missing, 0.0, frame), ~missing
    for at, y, x in sorted((round(t[y, x], 12), y, x) for y, x in np.argwhere(missing).tolist()):
        n, num, den = gradient(t, known, y, x), 0.0, 0.0
        for a, b in np.argwhere(known).tolist():
            r = np.array([y - a, x - b])
            if 0 < r @ r <= radius**2:
                weight = max(abs(r @ n) / math.sqrt(r @ r), 1e-6) / (r @ r) / (1 + abs(t[y, x] - t[a, b]))
                num += weight * (f[a, b] + gradient(f, known, a, b) @ r)
                den += weight
        f[y, x] = num / den
        known[y, x] = True
    return f


@pytest.mark.parametrize("seed, share, radius", [(1, 0.2, 3), (2, 0.5, 3), (3, 0.8, 2), (4, 0.97, 5)])
def test_fill_equals_relaxation(seed, share, radius):
    rng = np.random.default_rng(seed)
    frame = rng.uniform(0, 40, (9, 11))
    missing = rng.uniform(size=frame.shape) < share
    missing[4, 5] = False
    # cells reached at the same time are filled in the same order in both
    assert np.allclose(inpaint.fill(frame, missing, radius), brute(frame, missing, radius), atol=1e-6)


def test_planes_and_edge_cases(spark):
    plane = np.add.outer(np.arange(8.0), 2 * np.arange(8.0))
    hole = np.zeros((8, 8), bool)
    hole[3:5, 3:5] = True
    assert np.abs(inpaint.fill(plane, hole) - plane).max() < 1.0 and np.array_equal(inpaint.fill(plane, ~(hole | ~hole)), plane)
    nan = float("nan")
    rows = [(1, [[1.0, -1.0], [3.0, None]]), (2, None), (3, []), (4, [[1.0], [2.0, 3.0]]), (5, [[-1.0, nan]]), (6, [[7.0, -2.0, -2.0]])]
    got = {r.id: r.v for r in spark.createDataFrame(rows, "id int, f array<array<double>>").select("id", inpaint.inpainted("f").alias("v")).collect()}
    assert got[2] is None and got[3] == [] and got[4] == [[1.0], [2.0, 3.0]] and np.allclose(got[6], 7.0)
    assert got[1][0][0] == 1.0 and got[1][1][0] == 3.0 and min(map(min, got[1])) >= 0
    assert got[5][0][0] == -1.0 and got[5][0][1] is None  # nothing is known: as it was, NaN a null
