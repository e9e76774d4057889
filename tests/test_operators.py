"""Operators on literal edge cases, and on the properties that they promise."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import frames, motion, scalar
from tideline.operators import clustering, density, evaluate, joins, labels, models, providers, segments, select, timeops
from tideline.sources import chunk_log, imu, media, store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hop_windows_edges(spark):
    d = spark.createDataFrame([(1, 0, 1.0), (1, 5, 3.0), (1, 10, 5.0)], "k int, t bigint, v double")
    got = {r.window_end: (r.n, r.total) for r in timeops.hop_stats(d, ["k"], "t", "v", 10, 5).collect()}
    # the start belongs to a window, the end does not
    assert got == {5: (1, 1.0), 10: (2, 4.0), 15: (2, 8.0), 20: (1, 5.0)}
    two = d.unionByName(spark.createDataFrame([(2, 5, 7.0)], "k int, t bigint, v double"))
    assert {(r.k, r.window_end, r.n) for r in timeops.hop_stats(two, ["k"], "t", "v", 10, 5).collect()} == {(1, 5, 1), (1, 10, 2), (1, 15, 2), (1, 20, 1), (2, 10, 1), (2, 15, 1)}
    ends = d.select("t", F.explode(timeops.hop_ends(F.col("t"), 10, 5)).alias("e"))
    assert rows(ends) == sorted([(0, 5), (0, 10), (5, 10), (5, 15), (10, 15), (10, 20)], key=str)
    anchored = d.select("t", F.explode(timeops.hop_ends(F.col("t"), 10, 5, F.lit(0).cast("bigint"))).alias("e"))
    assert (0, 5) not in rows(anchored) and (0, 10) in rows(anchored)
    assert timeops.hop_stats(d.limit(0), ["k"], "t", "v", 10, 5).count() == 0
    with pytest.raises(ValueError):
        timeops.hop_stats(d, ["k"], "t", "v", 10, 3)


def test_hop_windows_of_values_far_from_zero(spark):
    rng = np.random.default_rng(3)
    for offset, spread in ((1e9, 1.0), (1.7e15, 4.0), (-1e12, 0.5), (0.0, 1e-9)):
        v = offset + spread * rng.integers(0, 3, 400).astype(float)
        v[100:110] = offset + 7 * spread
        d = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(v)] + [(2, 3, None)], "k int, t bigint, v double")
        got = {r.window_end: r for r in timeops.hop_stats(d.where("k = 1"), ["k"], "t", "v", 20, 5).collect()}
        for end, r in got.items():
            part = v[max(0, end - 20) : end]
            assert r.n == len(part) and abs(r.sd - (part - offset).std()) <= 1e-6 * spread + 4e-16 * abs(offset)
        assert {(r.n, r.mean, r.sd) for r in timeops.hop_stats(d.where("k = 2"), ["k"], "t", "v", 20, 5).collect()} == {(0, None, None)}


def test_intervals_touch_and_nest(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 10, 12), (1, 3, 5), (1, 20, 21), (1, 20, 25)], "k int, s bigint, e bigint")
    assert rows(timeops.merge_intervals(d, ["k"], "s", "e").select("s", "e", "n")) == [(0, 12, 3), (20, 25, 2)]
    plan = timeops.gap_plan(d.withColumns({"lo": F.lit(-5).cast("bigint"), "hi": F.lit(30).cast("bigint")}), ["k"], "s", "e", 1, "lo", "hi")
    gaps = sorted((r.start, r.end) for r in plan.where("kind = 'gap'").collect())
    assert gaps == [(-5, 0), (12, 20), (25, 30)]
    clips = sorted((r.start, r.end) for r in plan.where("kind = 'clip'").collect())
    assert clips == [(0, 10), (10, 12), (20, 21), (21, 25)]


def test_interpolation_edges(spark):
    d = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (1, 4, None)], "k int, t bigint, v double")
    hold = [r.x for r in timeops.interpolate(d, ["k"], "t", "v", "x").orderBy("t").collect()]
    assert hold == [None, 2.0, 3.0, 4.0, 4.0]
    assert [r.x for r in timeops.interpolate(d, ["k"], "t", "v", "x", "clamp").orderBy("t").collect()] == [2.0, 2.0, 3.0, 4.0, 4.0]
    assert all(r.x is None for r in timeops.interpolate(d.withColumn("v", F.lit(None).cast("double")), ["k"], "t", "v", "x", "clamp").collect())


def test_runs_segments_blocks(spark):
    d = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "b", "a"])], "k int, t int, s string")
    assert sorted((r.s or "", r.length) for r in timeops.runs(d, ["k"], ["t"], "s").collect()) == [("", 2), ("a", 1), ("a", 2), ("b", 1)]
    seven = spark.createDataFrame([(1, i) for i in range(7)], "k int, t int")
    assert [r.segment for r in timeops.segments(seven, ["k"], ["t"], 4).orderBy("t").collect()] == list(range(7))
    nine = spark.createDataFrame([(1, i) for i in range(9)], "k int, t int")
    assert [r.segment for r in timeops.segments(nine, ["k"], ["t"], 4).orderBy("t").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_greedy_choices(spark):
    d = spark.createDataFrame([(1, t, float(s), t) for t, s in [(0, 3), (4, 1), (5, 2), (9, 0), (14, 5)]], "k int, t bigint, s double, i bigint")
    assert sorted(r.t for r in select.greedy_spacing(d, ["k"], "t", 4).collect()) == [0, 5, 14]
    assert sorted(r.t for r in select.greedy_topk(d, ["k"], "t", "s", "i", 3, 4).collect()) == [4, 9, 14]
    assert select.greedy_topk(d.limit(0), ["k"], "t", "s", "i", 3, 4).count() == 0


def test_range_and_overlap_joins(spark):
    rng = np.random.default_rng(0)
    p = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 100, 80)))]
    v = [(int(k), int(s), int(s + w), i) for i, (k, s, w) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(0, 100, 40), rng.integers(0, 25, 40)))]
    pd, vd = spark.createDataFrame(p, "k int, t bigint, p int"), spark.createDataFrame(v, "k int, s bigint, e bigint, v int")
    for bucket in (1, 7, 1000):
        got = rows(joins.range_join(pd, vd, ["k"], "t", "s", "e", bucket).select("p", "v"))
        assert got == sorted([(i, j) for k, t, i in p for q, s, e, j in v if k == q and s <= t < e], key=str)
        w = vd.toDF("k", "s2", "e2", "w")
        for closed in (False, True):
            got = rows(joins.overlap_join(vd, w, ["k"], "s", "e", "s2", "e2", bucket, closed).select("v", "w"))
            hit = (lambda a, b, c, d: a <= d and c <= b) if closed else (lambda a, b, c, d: a < d and c < b)
            assert got == sorted([(i, j) for k, s, e, i in v for q, a, b, j in v if k == q and hit(s, e, a, b)], key=str)


def test_labels(spark):
    d = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.9), (1, "b", 0.1), (2, "a", 0.0)], "w int, l string, c double")
    assert [(r.w, r.l, round(r.p, 6)) for r in labels.soft_labels(d, ["w"], "l", "c").orderBy("w", "l").collect()] == [(1, "a", 0.9), (1, "b", 0.1), (2, "a", 0.0)]
    v = spark.createDataFrame([(1, m, x, p) for m, x, p in [(1, "b", 0.6), (1, "a", 0.4), (2, "a", 0.5), (2, "b", 0.5)]], "k int, m int, l string, p double")
    assert [tuple(r) for r in labels.majority_vote(v, ["k"], ["m"], "l", "p").collect()] == [(1, "a", 0.5, 1)]
    assert [(r.prediction, round(r.confidence, 6)) for r in labels.mean_vote(v, ["k"], "l", "p").collect()] == [("b", 0.55)]
    c = spark.createDataFrame([("eat AND drink; rest",)], "l string").select(labels.atoms(F.col("l"))).first()[0]
    assert c == ["eat", "drink", "rest"]


def test_metrics(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    m = {r.label: (r.tp, r.fp, r.fn) for r in evaluate.per_label(d, "t", "p").collect()}
    assert m == {"a": (1, 0, 1), "b": (1, 2, 0), "c": (0, 0, 1)}
    s = evaluate.summary(d, "t", "p").first()
    assert s.accuracy == 0.5 and s.n == 4 and sum(r.n for r in evaluate.confusion(d, "t", "p").collect()) == 4


def test_scalars(spark):
    d = spark.createDataFrame([("x_20240102_030405.csv", float("nan")), ("bad", float("inf")), ("non_dominant/y", 2.0)], "p string, v double")
    r = d.select(scalar.stamp_in_name(F.col("p")).alias("t"), scalar.clean_number(F.col("v")).alias("v"), scalar.hand_of(F.col("p")).alias("h")).collect()
    assert str(r[0].t) == "2024-01-02 03:04:05" and r[1].t is None and [x.v for x in r] == [0.0, 0.0, 2.0] and r[2].h == "non_dominant" and r[0].h == "dominant"


def test_spectral():
    t = np.arange(250) / 50
    x = np.sin(2 * np.pi * 2 * t)
    assert abs(motion.spectrum(x)["dominant"] - 2) < 0.2
    b = motion.bands(x)
    assert b["mid"] > 0.9 and b["periodicity"] > 0.9
    assert motion.steps(x) == 9  # the filter starts from rest, so the first of ten peaks stays below the deviation
    assert motion.spectrum(np.zeros(3)) == {"dominant": 0.0, "centroid": 0.0, "entropy": 0.0} and motion.steps(np.ones(4)) == 0


def test_frames(spark):
    hot = [[20.0, 20.0, 50.0], [35.0, 20.0, 20.0], [50.0, 20.0, 50.0]]
    d = spark.createDataFrame([(1, 0, hot), (1, 1, [[35.0, 20.0, 20.0]] * 3)], "w int, t int, f array<array<double>>")
    assert [r[0] for r in d.orderBy("t").select(frames.hot_regions(F.col("f"))).collect()] == [3, 0]
    r = frames.thermal_features(d, ["w"], "t", "f").first()
    assert math.isclose(r.human_area, 2 / 9) and math.isclose(r.hot_area, 1.5 / 9) and r.hot_max == 50 and r.near_cold == 1.0
    dop = frames.doppler_features(d, ["w"], "t", "f").first()
    r0, r1 = np.max(np.array(hot), axis=1), np.array([35.0] * 3)
    assert np.allclose(dop.range_profile, np.maximum(0, r0 - (r0 + r1) / 2) + np.maximum(0, r1 - (r0 + r1) / 2))
    assert np.allclose(dop.velocity_profile[:3], np.mean(hot, axis=0) + [35, 20, 20])
    dep = frames.depth_features(d, ["w"], "t", "f").first()
    assert dep.area == 9 and math.isclose(dep.entropy, math.log2(9)) and dep.aspect == 1
    masked = d.select(frames.person_depth(F.col("f"), F.transform("f", lambda row: F.transform(row, lambda v: (v > 30).cast("int")))).alias("m")).first().m
    assert masked[0] == [0.0, 0.0, 50.0]
    pose = [[(float(i + s), float(2 * i), 0.9 if i else 0.1) for i in range(17)] for s in range(3)]
    p = spark.createDataFrame([(1, t, j) for t, j in enumerate(pose)], "w int, t int, joints array<struct<x double, y double, conf double>>")
    r = frames.pose_features(p, ["w"], "t").first()
    assert math.isclose(r.speed, 1.0) and r.static_share == 1.0
    v = frames.pose_vector(p, ["w"], "t").first().v
    assert len(v) == 34 and math.isclose(v[0], 0 + 1 + 2)


def test_label_sanitize_reads_whole_texts(spark, sf):
    from tideline.plans.catalog import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}
    got = {r.doc_id: r.label for r in QUERIES["label_sanitize"](spark, sf).collect()}
    assert got == {i: t.translate(str.maketrans(" -/", "___")) for i, t in texts.items()} and max(map(len, got.values())) > 40


def test_density_and_clusters(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 2))
    x[55:60] += 8
    s = density.score_series(x)
    assert list(s.block) == list(range(1, 10)) and s.loc[s.score.idxmin(), "block"] == 5
    assert len(density.score_series(x[:15])) == 0
    sim = np.array([[1, 0.9, 0.1, 0.1], [0.9, 1, 0.1, 0.1], [0.1, 0.1, 1, 0.8], [0.1, 0.1, 0.8, 1]])
    for method in ("average", "ward", "single"):
        assert list(clustering.linkage(sim, method, k=2)) == [0, 0, 1, 1]
    assert list(clustering.linkage(sim, least=0.85)) == [0, 0, 1, 2]


def test_segments(spark):
    d = spark.createDataFrame([(1, "a", t, 1, 0.95, t) for t in (0, 3, 10)] + [(1, "b", 11, 2, 0.95, 100), (1, "b", 30, 2, 0.95, 101), (1, "b", 50, -1, 0.99, 102), (1, "b", 70, 3, 0.99, 103)], "k int, sensor string, window_end bigint, label int, confidence double, id bigint")
    from tideline.config import Segments

    got = segments.compile_segments(d, ["k"], Segments(window_us=5))
    assert sorted(r.window_end for r in got.collect()) == [0, 10, 30]
    a = spark.createDataFrame([(1, 27, "x"), (1, 90, "x")], "k int, t bigint, name string")
    both = {r.window_end: r.labels for r in segments.attach_anomalies(got, a, ["k"], 5).collect()}
    assert both == {0: ["1"], 10: ["1"], 30: ["2", "x"], 90: ["x"]}


def test_models(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(i, [float(i % 2) + rng.normal() * 0.1, rng.normal()], "odd" if i % 2 else "even") for i in range(60)], "i int, v array<double>, y string")
    for name in ("svm", "balanced_rf"):
        p = models.train(d, "v", "y", name).predict(d, ["i"], "v")
        best = labels.majority_vote(p.withColumn("m", F.lit(1)), ["i"], ["m"], "label", "prob").collect()
        assert sum(r.prediction == ("odd" if r.i % 2 else "even") for r in best) > 55
    one = models.train(d.withColumn("y", F.lit("only")), "v", "y", "svm").predict(d, ["i"], "v")
    assert {(r.label, r.prob) for r in one.collect()} == {("only", 1.0)}


def test_sources(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.txt").write_text("1 | aGk= ||2 | aG8= ||broken ||4 | aGk= ||")
    (tmp_path / "log/b.txt").write_text("7 | aGk= ||\n8 | aG8= ||")
    got = chunk_log.read_chunk_log(spark, str(tmp_path / "log"))
    assert sorted((r.ts_ns, bytes(r.payload)) for r in got.collect()) == [(1, b"hi"), (2, b"ho"), (7, b"hi"), (8, b"ho")]
    (tmp_path / "acc.csv").write_text("1,1000,0.1,0.2,0.3\n2,3000,0.1,0.2,0.3\n")
    r = imu.session_bounds(imu.read_android(spark, str(tmp_path / "acc.csv")), ["file"]).first()
    assert (r.s, r.e, r.n) == (1_000_000, 3_000_000, 2)
    (tmp_path / "watch.txt").write_text(" ".join(["1.5", *map(str, range(21))]) + "\n")
    w = imu.read_iwatch(spark, str(tmp_path / "watch.txt"), "mag").first()
    assert (w.t, w.x, w.y, w.z) == (1_500_000, 9.0, 10.0, 11.0)
    replies = [("a", '```json\n{"location_analysis": [{"location": "sink", "confidence": 0.5}, {"primary_location": ""}]}\n```'), ("b", 'Sure: {"location_analysis": []} done'), ("c", "no json")]
    lines = [json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": c}}]}}}) for i, c in replies]
    (tmp_path / "replies.jsonl").write_text("\n".join(lines) + "\n")
    got = store.locations(store.read_responses(spark, str(tmp_path / "replies.jsonl")))
    assert [(r.custom_id, r.location, r.confidence) for r in got.collect()] == [("a", "sink", 0.5)]
    req = spark.createDataFrame([(i, "x" * 50) for i in range(300)], "id int, body string")
    files = store.batch_files(req, "id", "body", most_bytes=400, most_rows=3).groupBy("file").agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("b")).collect()
    assert all(f.n <= 3 for f in files) and sum(f.n for f in files) == 300
    feats = spark.createDataFrame([("p1", "s1", 1, [1.0]), ("p1", "s2", 1, [2.0])], "participant string, sensor string, window_end bigint, v array<double>")
    store.write_features(feats, str(tmp_path / "features"))
    assert [r.v for r in store.read_features(spark, str(tmp_path / "features"), ["s2"]).collect()] == [[2.0]]
    assert media.list_files(spark, str(tmp_path / "log"), "*.txt").count() == 2


def test_providers(spark):
    p = providers.Rules()
    assert p.merge({"red cup": 30, "cup red": 5, "door": 2}, 20) == {"red cup": ["red cup", "cup red"]}
    assert providers.match_until_settled(["cup red", "sky"], ["red cup"], p) == {"cup red": "red cup"}
    assert providers.humanize(["a b", "a c"], lambda x, i: x.split()[min(i, 1)]) == {"a b": "a", "a c": "c"}
    assert not p.embed("").any() and math.isclose(float(np.linalg.norm(p.embed("some words"))), 1)
    d = spark.createDataFrame([(1, ["pot stove", "sink"]), (2, [])], "id int, frames array<string>")
    assert {r.id for r in providers.describe(d, "id", "frames", p).collect()} == {1}


def test_neighbours_match_brute_force(spark):
    import numpy as np

    from tideline.operators import neighbours

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[7] = 0
    d = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)] + [(60, None, "a"), (61, x[3].tolist(), None)], "id long, v array<double>, l string").repartition(3)
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    full = np.vstack([unit, np.zeros(5), unit[3]])
    s = np.round(full @ full.T, 9)
    want = {i: sorted((j for j in range(62) if j != i), key=lambda j: (-s[i, j], j))[:4] for i in (0, 7, 60)}
    rows = neighbours.nearest_in_table(d, d.where("id in (0, 7, 60)"), "id", "v", 4).collect()
    assert {q: [r.n for r in sorted((r for r in rows if r.q == q), key=lambda r: (-r.s, r.n))] for q in want} == want
    assert neighbours.nearest_in_table(d, d.limit(0), "id", "v", 4).count() == 0
    votes = neighbours.vote(d.where("id < 5"), ["id"], "v", d.where("id >= 5"), "l", 3).collect()
    assert all(abs(sum(r.prob for r in votes if r.id == i) - 1) < 1e-9 for i in range(5))


def test_models_are_saved_and_loaded(spark, tmp_path):
    from tideline.operators import models

    d = spark.createDataFrame([(i, [float(i % 3), float(i % 2)], f"c{i % 3}") for i in range(60)], "id long, v array<double>, l string")
    for name in ("random_forest", "logistic", "svm"):
        m = models.train(d, "v", "l", name)
        m.save(str(tmp_path / name))
        again = models.Trained.load(spark, str(tmp_path / name))
        key = lambda r: (r.id, r.label)
        assert sorted(m.predict(d, ["id"], "v").collect(), key=key) == sorted(again.predict(d, ["id"], "v").collect(), key=key)
    one = models.train(d.where("l = 'c0'"), "v", "l", "svm")
    one.save(str(tmp_path / "one"))
    assert models.Trained.load(spark, str(tmp_path / "one")).labels == ["c0"]


def test_densities_are_kept_as_text(spark):
    from tideline.operators import density

    d = spark.createDataFrame([("a" if i % 2 else "b", i, [float(i % 7), float(i % 5)]) for i in range(120)], "k string, t long, v array<double>")
    m = density.fit_densities(d.where("t < 80"), ["k"], ["t"], "v")
    out = density.score_only(d.where("t >= 80"), m, ["k"], "v").collect()
    held = {r.k: density.DecayedMixture.from_json(r.model) for r in m.collect()}
    assert len(out) == 40 and all(abs(r.score - held[r.k].log_density(__import__("numpy").array([r.v]))[0]) < 1e-9 for r in out)


def test_fold_carries_state_over_batches_and_null_keys(spark):
    from tideline.operators import select, sequential, timeops

    rows = [("a" if i % 3 else None, i * 7 % 100, float(i)) for i in range(100)]
    d = spark.createDataFrame(rows, "k string, t long, v double").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.k or "", r.t) for r in select.greedy_spacing(d, ["k"], "t", 10).collect())
        mean = {r.k: r.m for r in timeops.decayed_mean(d, ["k"], ["t"], "v", 0.5, "m").collect()}
        n = sequential.fold(d, ["k"], ["t"], ["t"], lambda s, used: ((s or 0) + len(used[0]), []), "k string, n long", "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, means = [], {}
    for k in (None, "a"):
        last = None
        for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            means[k] = v if k not in means else 0.5 * means[k] + 0.5 * v
            if last is None or t - last > 10:
                want.append((k or "", t))
                last = t
    assert got == sorted(want) and mean == means and {r.k: r.n for r in n} == {None: 34, "a": 66}


def test_quantiles_are_exact(spark):
    import numpy as np

    from tideline.operators.quantiles import quantiles

    rng = np.random.default_rng(0)
    data = {"x": rng.normal(size=999), "ties": np.repeat([1.0, 2.0, 2.0, 9.0], 50), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "wide": np.array([-1.7e308, 0.0, 1.0, 1.7e308])}
    d = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("x", None), ("x", float("nan"))], "k string, v double")
    got = {r.k: (r.a, r.b, r.c) for r in quantiles(d, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        if k != "wide":
            assert np.allclose(got[k], np.quantile(vs, [0.25, 0.5, 1.0]), atol=1e-12)
    assert quantiles(d.limit(0), ["k"], "v", {"a": 0.5}).count() == 0


def test_quantiles_divide_spans_until_they_are_small(spark):
    import numpy as np

    from tideline.operators.quantiles import quantiles

    rng = np.random.default_rng(1)
    data = {
        "outlier": np.append(rng.normal(1e9, 1, 900), [-1e300, 1e300]),
        "tail": 10.0 ** rng.uniform(-200, 200, 900),
        "ties": np.append(np.repeat([3.0, 3.0 + 2**-40], 450), 1e15),
        "tiny": np.append(rng.integers(0, 9, 300) * 5e-324, 1.0),
        "one": np.repeat([7.0], 500),
    }
    d = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("inf", x) for x in [float("-inf"), 1.0, 2.0, 3.0, float("inf")]], "k string, v double").repartition(5)
    at = {"a": 0.1, "b": 0.5, "c": 0.75, "d": 0.75}
    for most in (2, 50):
        got = {r.k: (r.a, r.b, r.c, r.d) for r in quantiles(d, ["k"], "v", at, most).collect()}
        assert got.pop("inf")[1:] == (2.0, 3.0, 3.0)
        want = {r.k: tuple(r[1:]) for r in d.where("k <> 'inf'").groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in at.items()]).collect()}
        assert set(got) == set(want) == set(data)
        for k in want:
            assert np.allclose(got[k], want[k], rtol=1e-15, atol=0), k


def test_best_places_and_ties():
    from tideline.operators import neighbours

    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (5, 5), (5, 9), (50, 7)):
        s = rng.integers(0, 6, (30, n)).astype(float)
        s[0, 0] = -np.inf
        got = neighbours._best(s, k)
        want = np.sort(np.lexsort((np.broadcast_to(np.arange(n), s.shape), -s), axis=1)[:, :k], axis=1)
        assert np.array_equal(got, want)
