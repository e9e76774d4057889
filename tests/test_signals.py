"""Expanding models, recursive filters and smoothing on edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import filters, motion
from tideline.operators import expanding


def sections_one_by_one(u, sos):
    for b0, b1, b2, a1, a2 in sos:
        z1, z2, out = 0.0, 0.0, []
        for x in u:
            y = b0 * x + z1
            z1, z2 = b1 * x - a1 * y + z2, b2 * x - a2 * y
            out.append(y)
        u = out
    return np.array(u)


def test_band_response_and_carried_state():
    sos = filters.band_sections(0.5, 3.0, 50.0)
    z = np.exp(2j * np.pi * np.array([0.5, 3.0, 0.05, 20.0, 1.2]) / 50)
    gain = np.abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in sos], axis=0))
    assert np.allclose(gain[:2], 0.5**0.5) and gain[2] < 1e-3 and gain[3] < 1e-3 and abs(gain[4] - 1) < 1e-3
    u = np.random.default_rng(0).normal(5, 1, 500)
    c = filters.cascade(0.5, 3.0, 50.0)
    state, parts = None, []
    for part in np.split(u, [1, 64, 130, 131, 400]):
        state, y = c.run(state, part)
        parts.append(y)
    assert np.allclose(np.concatenate(parts), sections_one_by_one(u, sos), atol=1e-10)


def test_filter_runs_over_batches_and_keys(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rng = np.random.default_rng(1)
        rows = [(k, t, float(rng.normal())) for k in ("a", "b", None) for t in range(150)] + [("c", 0, None)]
        d = spark.createDataFrame(rows, "k string, t long, v double").repartition(3)
        got = filters.band_filtered(d, ["k"], ["t"], "v", "y").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in ("a", "b", None):
        want = sections_one_by_one([v for q, _, v in rows if q == k], filters.band_sections(0.5, 3.0, 50.0))
        assert np.allclose([r.y for r in sorted((r for r in got if r.k == k), key=lambda r: r.t)], want, atol=1e-10)
    assert [r.y for r in got if r.k == "c"] == [0.0]


def test_steps_and_peaks():
    t = np.arange(500) / 50
    for x in (np.sin(2 * np.pi * 2 * t), 9.8 + np.sin(2 * np.pi * 2 * t), np.random.default_rng(4).normal(9.8, 3, 300)):
        y = sections_one_by_one(x, filters.band_sections(0.5, 3.0, 50.0))
        high = [i for i in range(1, len(y) - 1) if y[i - 1] < y[i] >= y[i + 1] and y[i] >= y.std()]
        kept = []
        for i in sorted(high, key=lambda i: -y[i]):
            if all(abs(i - j) >= 15 for j in kept):
                kept.append(i)
        assert motion.steps(x) == len(kept)
    assert motion.steps(np.ones(8)) == 0
    x = np.array([0, 5, 0, 4, 0, 0, 3, 0, 9, 0.0])
    assert list(motion.peaks(x, 1, 1)) == [1, 3, 6, 8] and list(motion.peaks(x, 1, 3)) == [1, 8] and list(motion.peaks(x, 4.5, 1)) == [1, 8]


def fitted(x, window, degree):
    if len(x) <= window:
        return x
    half, out = window // 2, []
    for i in range(len(x)):
        c = min(max(i, half), len(x) - 1 - half)
        p = np.polyfit(np.arange(-half, half + 1), x[c - half : c + half + 1], degree)
        out.append(np.polyval(p, i - c))
    return out


@pytest.mark.parametrize("window, degree", [(5, 2), (7, 3), (3, 1)])
def test_smoothing_equals_polynomial_fits(spark, window, degree):
    rng = np.random.default_rng(window)
    x = {k: rng.normal(size=n) for k, n in (("a", 40), ("b", window), ("c", window + 1), ("d", 1))}
    d = spark.createDataFrame([(k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)], "k string, i int, v double")
    got = filters.smoothed(d, ["k"], ["i"], "v", "s", window, degree).orderBy("i").collect()
    for k, xs in x.items():
        assert np.allclose([r.s for r in got if r.k == k], fitted(xs, window, degree))
    with pytest.raises(ValueError):
        filters.smoothed(d, ["k"], ["i"], "v", "s", 4, 2)


def test_expanding_classes_far_from_zero(spark):
    rng = np.random.default_rng(2)
    rows = [(1, int(s), "xyz"[int(c)], [1e9 + float(a), float(b)]) for s, c, a, b in zip(rng.integers(0, 6, 90) * 3, rng.integers(0, 3, 90), rng.normal(size=90), rng.normal(size=90))]
    rows = [r for r in rows if not (r[2] == "z" and r[1] < 9)] + [(2, 0, None, [0.0, 0.0]), (2, 1, "x", [None, 2.0])]
    d = spark.createDataFrame(rows, "k int, s int, c string, v array<double>")
    m = expanding.expanding_classes(d, ["k"], "s", "c", "v")
    got = {(r.k, r.s, r.c): (r.n, r.mean, r.sd) for r in m.collect()}
    for (k, s, c), (n, mean, sd) in got.items():
        if k == 1:
            x = np.array([v for a, b, q, v in rows if a == 1 and b <= s and q == c])
            assert n == len(x) and np.allclose(np.array(mean) - [1e9, 0], (x - [1e9, 0]).mean(0), atol=1e-6) and np.allclose(sd, (x - [1e9, 0]).std(0), atol=1e-6)
    assert got[2, 1, "x"] == (1, [None, 2.0], [None, 0.0]) and (1, 6, "z") not in got and (1, 15, "z") in got
    assert not expanding.expanding_classes(d.limit(0), ["k"], "s", "c", "v").collect()
    told = expanding.predict_next(d.where("k = 1").withColumn("id", F.monotonically_increasing_id()), m, ["k"], "s", "id", "c", "v")
    assert told.where("s = 0").count() == 0 and told.count() == sum(1 for r in rows if r[0] == 1 and r[1] > 0)
