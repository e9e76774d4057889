"""Names matched and merged against lists, linkage against the plain cubic form, and table functions against DataFrame operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import tables
from tideline.operators import clustering, matching, providers, timeops


def cubic_linkage(sim: np.ndarray, method: str = "average", k: int | None = None, least: float | None = None) -> np.ndarray:
    """Agglomerative groups of a small similarity matrix, down to k groups or while groups are at least `least` alike. Ward works on distances 1 - sim."""
    n = len(sim)
    d = (1 - sim).astype(float)
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(n)}
    while len(groups) > (k or 1):
        ids = sorted(groups)
        sub = d[np.ix_(ids, ids)]
        a, b = divmod(int(sub.argmin()), len(ids))
        i, j = ids[min(a, b)], ids[max(a, b)]
        if least is not None and d[i, j] > 1 - least + 1e-12:
            break
        ni, nj = len(groups[i]), len(groups[j])
        for m in ids:
            if m in (i, j):
                continue
            if method == "average":
                v = (ni * d[i, m] + nj * d[j, m]) / (ni + nj)
            elif method == "ward":
                nm = len(groups[m])
                v = np.sqrt(((ni + nm) * d[i, m] ** 2 + (nj + nm) * d[j, m] ** 2 - nm * d[i, j] ** 2) / (ni + nj + nm))
            else:
                v = min(d[i, m], d[j, m])
            d[i, m] = d[m, i] = v
        groups[i] += groups.pop(j)
    out = np.zeros(n, int)
    for g, members in enumerate(sorted(groups.values(), key=min)):
        out[members] = g
    return out


def vocabulary(seed, n):
    rng = np.random.default_rng(seed)
    words = ["red", "cup", "big", "table", "lamp", "the", "of", "Ä", "plate", "door"]
    return sorted({" ".join(dict.fromkeys(rng.choice(words, int(rng.integers(1, 5))).tolist())) for _ in range(n)} | {"", "!?"})


def test_matches_equal_the_list_version(spark):
    names = vocabulary(1, 60)
    groups = ["red cup", "the big table", "lamp of door", "cup Red", "..."]
    got = {r["name"]: r["group"] for r in matching.match_to_fixpoint(spark.createDataFrame([(x,) for x in [*names, *names, None]], "name string"), spark.createDataFrame([(g,) for g in [*groups, None]], "`group` string")).collect()}
    want = providers.match_until_settled(names, groups, providers.Rules())
    assert got == {x: want.get(x) for x in names} and any(got.values()) and not all(got.values())
    none = matching.match_to_fixpoint(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "`group` string"))
    assert [tuple(r) for r in none.collect()] == [("a", None, None)]


def test_grown_matches_follow_chains(spark):
    names = ["a b c", "b c d", "c d e", "d e f", "x y"]
    d = spark.createDataFrame([(x,) for x in names], "name string")
    got = {r["name"]: (r["group"], r["round"]) for r in matching.match_to_fixpoint(d, spark.createDataFrame([("a b",)], "`group` string"), grow=True).collect()}
    assert got == {"a b c": ("a b", 1), "b c d": ("a b", 2), "c d e": ("a b", 3), "d e f": ("a b", 4), "x y": (None, None)}


@pytest.mark.parametrize("least", [1, 3])
def test_merged_names_equal_the_list_version(spark, least):
    rng = np.random.default_rng(2)
    counts = {x: int(rng.integers(1, 8)) for x in vocabulary(3, 60)}
    got = {r["name"]: r["merged"] for r in matching.merge_names(spark.createDataFrame([*counts.items(), (None, 3)], "name string, n long"), least).collect()}
    groups = providers.Rules().merge(counts, least)
    assert got == {x: None for x in counts} | {x: g for g, xs in groups.items() for x in xs}
    assert matching.merge_names(spark.createDataFrame([], "name string, n long"), 1).collect() == []


@pytest.mark.parametrize("method", ["average", "ward", "single"])
def test_linkage_equals_the_cubic_form(method):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 12, 40):
        d = rng.uniform(0, 1, (n, n))
        sim = 1 - np.triu(d, 1) - np.triu(d, 1).T
        for k in {1, min(2, n), min(5, n), n}:
            assert list(clustering.linkage(sim, method, k)) == list(cubic_linkage(sim, method, k)), (n, k)
        for least in (0.9, 0.6, 0.1):
            assert list(clustering.linkage(sim, method, least=least)) == list(cubic_linkage(sim, method, least=least))
    assert len(set(clustering.linkage(np.ones((6, 6)), method, 3))) == 3  # all equal


def test_linked_groups_choose_k(spark):
    c = np.repeat([0, 1, 2], 3)
    sim = np.where(c[:, None] == c[None, :], 0.9, 0.1)
    rows = [(p, f"l{i}", f"l{j}", float(sim[i, j]), 4) for p in ("kitchen", "hall") for i in range(9) for j in range(9) if i != j] + [("one", "x", "x", 1.0, 2)]
    got = clustering.linked_groups(spark.createDataFrame(rows, "place string, a string, b string, sim double, n int"), "place").collect()
    for p in ("kitchen", "hall"):
        assert [r.cluster for r in sorted((r for r in got if r.place == p), key=lambda r: r.label)] == list(c)
    assert [(r.label, r.cluster, r.k) for r in got if r.place == "one"] == [("x", 0, 1)]


def test_table_function_equals_hop_stats(spark):
    assert tables.register(spark) == ["hop_features", "decayed_scores"]
    rng = np.random.default_rng(7)
    rows = [("abc"[int(rng.integers(0, 3))], int(t), float(v)) for t, v in zip(rng.integers(0, 400, 90), rng.normal(size=90))] + [("a", None, 1.0), ("a", 5, None), ("lone", 100, 2.0), (None, 3, 4.0)]
    d = spark.createDataFrame(rows, "k string, t long, v double").repartition(3)
    got = spark.sql("SELECT * FROM hop_features(TABLE(SELECT * FROM {d}) PARTITION BY k ORDER BY t, key => 'k', time => 't', value => 'v', size => 20L, slide => 5L)", d=d)
    want = timeops.hop_stats(d.where("t is not null and v is not null"), ["k"], "t", "v", 20, 5)
    names = ["k", "window_end", "n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")]]
    rows = lambda x: sorted((tuple(r) for r in x.select(*names).collect()), key=str)
    assert rows(got) == rows(want)
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM hop_features(TABLE(SELECT * FROM {d}) PARTITION BY k ORDER BY t, key => 'k', time => 'x', value => 'v', size => 20L, slide => 5L)", d=d)
    with pytest.raises(Exception, match="multiple"):
        spark.sql("SELECT * FROM hop_features(TABLE(SELECT * FROM {d}) PARTITION BY k ORDER BY t, key => 'k', time => 't', value => 'v', size => 20L, slide => 3L)", d=d)
