"""Density clusters across partitions against plain Python."""

import numpy as np
import pandas as pd
import pytest
from brute_density import clusters, prepare, yeo_johnson, yeo_johnson_lambda

from tideline.operators import density_tree, graphs, preparing


def shaped(seed, n, dims=3, around=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (around, dims))
    x = centres[rng.integers(0, around, n)] + rng.normal(0, 1, (n, dims)) * rng.choice([0.2, 0.6, 1.5], n)[:, None]
    x[: n // 10] = rng.uniform(-10, 10, (n // 10, dims))
    return np.round(x, 2)


def found(spark, groups, **how):
    rows = [(g, i, v.tolist(), k, m) for g, (x, k, m) in groups.items() for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "g string, id long, v array<double>, k int, m int").repartition(3)
    return {(r.g, r.id): (r.label, round(r.confidence, 9)) for r in density_tree.density_clusters(d, **how).collect()}


def wanted(groups):
    return {(g, i): (label, round(s, 9)) for g, (x, k, m) in groups.items() for i, (label, s) in enumerate(zip(*clusters(x, m, k)))}


def test_two_thousand_points_equal_plain_python(spark):
    groups = {"a": (shaped(1, 2000), 5, 10)}
    got = found(spark, groups, block=300)
    assert got == wanted(groups) and len({x for x, _ in got.values()}) > 4


def test_groups_of_all_kinds_and_split_trees(spark):
    grid = np.array([(i, j) for i in range(8) for j in range(8)], float)
    groups = {
        "a": (shaped(2, 150), 5, 5), "b": (shaped(3, 90, 2), 3, 4), "small": (shaped(4, 9), 5, 5), "one": (np.zeros((1, 2)), 5, 5), "ties": (grid, 3, 5),
        "same": (np.zeros((20, 2)), 3, 5), "line": (np.cumsum(1.05 ** np.arange(60))[:, None], 2, 2), "two": (np.array([[0.0], [1.0]]), 5, 2),
    }
    want = wanted(groups)
    assert found(spark, groups) == want
    # few neighbours listed, small blocks, and trees split down to ten edges
    assert found(spark, groups, bound=10, block=20, listed=3) == want


def test_forest_by_contraction(spark):
    rng = np.random.default_rng(7)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (150, 2)).tolist() if a != b}
    edges = [(a, b, float(rng.integers(0, 9)), a, b) for a, b in pairs]
    up = {i: i for i in range(60)}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    want = set()
    for a, b, w, *_ in sorted(edges, key=lambda e: e[2:]):
        if find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
            want.add((a, b, w))
    forest, labels = graphs.spanning_forest(spark.range(60).toDF("node"), spark.createDataFrame(edges, "u long, v long, w double, a long, b long"))
    assert {tuple(r) for r in forest.select("u", "v", "w").collect()} == want
    name = {r.node: r.root for r in labels.collect()}
    assert all((name[i] == name[j]) == (find(i) == find(j)) for i in range(60) for j in range(60))


def test_empty_table(spark):
    d = spark.createDataFrame([], "g string, id long, v array<double>, k int, m int")
    assert density_tree.density_clusters(d).collect() == []


def test_deep_chain_of_clusters(spark):
    """Totals of a chain of 40 clusters, each with one leaf beside it, come out as by recursion."""
    rows, mass = [], {}
    rng = np.random.default_rng(1)
    for i in range(40):
        rows += [(2 * i, None if i == 0 else 2 * i - 2), (2 * i + 1, 2 * i)]
    mass = {c: float(rng.integers(1, 50)) for c, _ in rows}
    kids = {c: [q for q, p in rows if p == c] for c, _ in rows}
    total = lambda c: max(mass[c], sum(total(q) for q in kids[c]))
    d = spark.createDataFrame([(c, p, mass[c]) for c, p in rows], "c long, parent long, mass double")
    assert {r.c: r.total for r in density_tree._totals(d).collect()} == pytest.approx({c: total(c) for c, _ in rows})


def test_preparation_and_components_equal_plain_python(spark):
    rng = np.random.default_rng(0)
    assert np.allclose(yeo_johnson(np.array([-2.0, 0.0, 3.0]), 1.0), [-2, 0, 3]) and yeo_johnson_lambda(np.ones(5)) == 1.0
    x = {"a": np.hstack([np.expm1(rng.normal(1, 0.5, (80, 2))), rng.normal(5, 2, (80, 2)), np.ones((80, 1)), rng.normal(size=(80, 1)) * 1e-9]), "b": -np.expm1(rng.normal(0, 0.7, (50, 6)))}
    x["a"][3, 0], x["a"][4, 1] = np.nan, np.inf
    d = spark.createDataFrame([(g, i, v.tolist()) for g, m in x.items() for i, v in enumerate(m)], "g string, id long, v array<double>")
    p = preparing.prepared(d, "g", "id", "v")
    for g, m in x.items():
        got = np.array([r.v for r in p.where(p.g == g).orderBy("id").collect()])
        want = prepare(m)
        assert got.shape == want.shape and np.abs(got - want).max() < 5e-3
    for r in (2, 9):
        far = lambda a: np.linalg.norm(a[:, None] - a[None], axis=2)
        got = np.array([row.v for row in preparing.principal(p, "g", "id", [2, 9]).where(f"g = 'b' and dims = {r}").orderBy("id").collect()])
        want = np.array([row.v for row in p.where("g = 'b'").orderBy("id").collect()])
        if r == 2:
            u, s, _ = np.linalg.svd(want, full_matrices=False)
            want = u[:, :2] * s[:2]
        assert np.allclose(far(got), far(want), atol=1e-8)


def test_new_points_take_the_nearest_label(spark):
    x = shaped(6, 200)
    label = clusters(x, 5, 5)[0]
    rng = np.random.default_rng(8)
    new = np.vstack([x[::9] + rng.normal(0, 0.3, x[::9].shape), rng.uniform(-30, 30, (10, 3))])
    fitted = spark.createDataFrame([("a", i, v.tolist(), label[i]) for i, v in enumerate(x)], "g string, id long, v array<double>, label long")
    asked = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(new)] + [("none", 1, [0.0, 0.0, 0.0])], "g string, id long, v array<double>")
    got = {(r.g, r.id): (r.label, round(r.confidence, 9)) for r in density_tree.assign(fitted, asked, block=40).collect()}
    near = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(near, np.inf)
    core = np.sort(near, axis=1)[:, 4]
    for i, v in enumerate(new):
        d = np.linalg.norm(x - v, axis=1)
        j = d.argmin()
        want = label[j] if d[j] <= 1.5 * core[j] else -1
        assert got["a", i] == (want, round(float(np.exp(-d[j])), 9) if want >= 0 else 0.0)
    assert got["none", 1] == (-1, 0.0)


def test_search_takes_the_best_quality(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.3, (15, 4)) for c in (0, 4, 9)])
    d = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "k int, id long, v array<double>")
    got = density_tree.density_search(d, "k", "id", "v", dims=(2, 3), sizes=(5,), samples=(3,)).collect()
    assert len(got) == 45 and len({(r.dims, r.min_cluster_size, r.min_samples) for r in got}) == 1
    name = {r.id: r.label for r in got}
    assert [name[i] for i in (2, 20, 40)] == [min(i for i in name if name[i] == name[j]) for j in (2, 20, 40)] and len({name[2], name[20], name[40]}) == 3


def test_neighbours_from_products_are_exact():
    """Far from the origin, with copies and equal distances, and blocks shorter than a list."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 1, (130, 4)), 1) + 1000
    x[40:60] = x[0]
    blocks = [[x.tobytes() for x in (np.arange(i, j), x[i:j])] for i, j in ((0, 50), (50, 53), (53, 130))]
    rows = [(one, blocks[k : k + 2]) for one in blocks for k in (0, 2)]
    got = density_tree._nearest(7)(iter([pd.DataFrame(rows[:3], columns=["one", "many"]), pd.DataFrame(rows[3:], columns=["one", "many"])]))
    lists = {u: (d, v) for f in got for u, d, v in zip(f["u"], f["d"], f["v"])}
    d = density_tree.distances(x, x)
    np.fill_diagonal(d, np.inf)
    for i in range(130):
        want = np.lexsort((np.arange(130), d[i]))[:7]
        assert lists[i][1].tolist() == want.tolist() and lists[i][0].tolist() == d[i, want].tolist()


def test_least_outgoing_edges_are_exact():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (60, 3)), 1) + 100
    core, comp = np.round(rng.uniform(0, 1, 60), 1), rng.integers(0, 4, 60)
    for known in (np.inf, 0.7):
        w = np.full(20, known)
        node = np.arange(60)
        one, two = [z.tobytes() for z in (node[:20], x[:20], core[:20], comp[:20], w)], [z.tobytes() for z in (node, x, core, comp)]
        got = next(density_tree._least_outgoing(iter([pd.DataFrame({"one": [one], "many": [[two]]})])))
        d = density_tree.distances(x[:20], x)
        want = []
        for c in sorted(set(comp[:20])):
            edges = [(max(d[i, j], core[i], core[j]), min(i, j), max(i, j)) for i in range(20) for j in range(60) if comp[i] == c != comp[j]]
            want += [e for e in [min(edges)] if e[0] <= known]
        assert sorted(want) == sorted((w, u, v) for u, v, w in got.itertuples(index=False))


def test_parameters_of_the_same_points_share_neighbours_and_trees(spark, monkeypatch):
    x = shaped(9, 120)
    met, rows = density_tree._met, []
    monkeypatch.setattr(density_tree, "_met", lambda one, many: rows.append(one.count()) or met(one, many))
    grid = [(k, m) for k in (3, 5) for m in (4, 6)]
    d = spark.createDataFrame([(f"{k} {m}", "s", i, v.tolist(), k, m) for k, m in grid for i, v in enumerate(x)], "g string, s string, id long, v array<double>, k int, m int")
    got = {(r.g, r.id): (r.label, round(r.confidence, 9)) for r in density_tree.density_clusters(d).collect()}
    assert got == wanted({f"{k} {m}": (x, k, m) for k, m in grid})
    assert rows[0] == 1


def test_components_may_wait(spark):
    """A component that doesn't know its least edge takes none, and the forest is the same."""
    edges = [(0, 1, 1.0), (1, 2, 5.0), (2, 3, 2.0), (3, 4, 4.0), (0, 4, 9.0)]
    listed = spark.createDataFrame([(u, v, w, u, v) for u, v, w in edges], "u long, v long, w double, a long, b long")
    asked = []

    def further(labels, best):
        names = sorted(r.comp for r in best.collect())
        asked.append(names)
        return None, spark.createDataFrame([(c,) for c in names[: len(names) // 2]], "comp long")

    forest, labels = graphs.spanning_forest(spark.range(5).toDF("node"), listed, further)
    assert {tuple(r) for r in forest.select("u", "v", "w").collect()} == set(edges[:4]) and labels.select("root").distinct().count() == 1
    assert len(asked) > 2
