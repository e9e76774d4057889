"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import hamerly, minhash, spelling

CLASHING = ("word", "w", "h", "n", "id", "a", "b", "k", "node", "key", "u", "v", "c", "s1", "label", "main", "q", "cluster", "was", "upper", "x", "all")


def clash(d):
    return d.withColumns({c: F.lit(c) for c in CLASHING})


# --- 11


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = fold(run)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 5
    n = {w: c for w, c in count.items() if c >= 3}
    alphabet = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        near[w] = sorted((edits & set(n)) - {w}, key=lambda x: (-n[x], x))
        form[w] = near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def spelled(d):
    got = [tuple(r) for r in spelling.group_variants(d).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_variants_equal_brute_force(spark, sf, size):
    d = spark.read.parquet(f"{sf}/../{size}/documents.parquet")
    want = variants([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    assert spelled(d) == want and any(x[1] for x in want)


def test_variants_edge_cases(spark):
    chain = "colour " * 3 + "color " * 6 + "colors " * 12 + "xcolors " * 24
    ties = "aaaaab " * 3 + "aaaaac " * 6 + "aaaaad " * 6
    letters = "ÀÉÎõü ÀÉÎõu ÀÉÎõu " * 3 + "ABCDÉ abcdÉ ABcdÉ abcde "
    rows = [(1, None), (2, ""), (3, chain), (None, ties), (4, letters), (4, letters), (5, "z" * 3000 + " " + "z" * 3001 + " " + ("z" * 1500 + "y" + "z" * 1500)), (5, "z" * 3000 + " " + "z" * 3001), (5, "z" * 3000 + " " + "z" * 3001), (6, " ".join(["word"] * 50))]
    d = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = spelled(d)
    assert got == variants(rows)
    assert ("colour", "color", "xcolors", 3, 1, 6) in got and ("aaaaab", "aaaaac", "aaaaac", 3, 2, 6) in got
    assert spelled(d.limit(0)) == set()


# --- 12


def lloyd(rows, k=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, q in kept:
            of[near(q)[1]].append(q)
        cents = [[sum(x) // len(of[j]) for x in zip(*of[j])] if of[j] else c for j, c in enumerate(cents)]
    best = [(i, *near(q)) for i, q in kept]
    inertia = Counter()
    for _, d, j in best:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in best), key=str)


def clustered(d, **how):
    got = hamerly.cluster(d, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_clusters_equal_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert clustered(d) == lloyd([(r.vec_id, r.embedding) for r in d.collect()])


def test_clusters_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(40)] + [(40, None), (41, [1.0]), (42, [1.0, None]), (43, [nan, 1.0]), (44, [1.0, -inf]), (None, [2.0, 2.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (45, [0.00048828125, -0.00001])]
    d = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for k in (1, 2, 8):
        assert clustered(d, k=k, dims=2) == lloyd(rows, k=k, dims=2)
    assert clustered(d.where("vec_id < 3"), dims=2) == lloyd(rows[:3], dims=2)
    assert clustered(d.limit(0), dims=2) == []


def test_bounds_hold_for_every_vector_after_every_round():
    rng = np.random.default_rng(5)
    q, c = rng.integers(-900, 900, (400, 6)), rng.integers(-900, 900, (7, 6))
    a, u, low = hamerly.scan(q, c)
    scanned = 0
    for _ in range(15):
        new = np.array([q[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(7)])
        drift = np.sqrt(((new - c) ** 2.0).sum(1)) * (1 + 1e-9)
        c, before = new, u.copy()
        a, u, low = hamerly.reassign(q, a, u, low, c, drift)
        d = np.sqrt(((q[:, None, :] - c) ** 2.0).sum(2))
        own = d[np.arange(len(q)), a]
        d[np.arange(len(q)), a] = np.inf
        assert (own <= d.min(1) + 1e-9).all() and (u >= own).all() and (low <= d.min(1)).all()
        scanned += (u == before).sum()
    with pytest.raises(OverflowError):
        hamerly.squared(np.array([[2**33]]), np.array([[0]]))


# --- 13


def linked(rows, size=4, percent=80):
    sets = [minhash.shingles(t, size) if t else set() for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    seen = set()
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        up[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def sketched(d, **how):
    return sorted((tuple(r) for r in minhash.near_duplicates(d, **how).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_duplicates_equal_brute_force(spark, sf, size):
    d = spark.read.parquet(f"{sf}/../{size}/documents.parquet")
    want = linked([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    assert sketched(d) == want and any(not x[3] for x in want)


def test_near_duplicates_edge_cases(spark):
    base = [f"w{i}" for i in range(60)]
    long = " ".join(f"t{i % 997}x{i % 31}" for i in range(400_000))
    near = " ".join([*base[:30], "new", *base[31:]])
    rows = [(9, " ".join(base)), (3, near), (3, "other words under an id that is taken"), (1, None), (2, ""), (4, " \t\n"), (5, "one Two"), (6, "ONE two\n"), (6, "one two"), (7, "two one"), (None, "no id but text enough to link"), (None, "NO ID but text enough  to link"), (11, long), (10, long + " more"), (12, "É a b c"), (13, "é a b c")]
    d = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sketched(d) == linked(rows)
    assert sketched(d, size=5, percent=50) == linked(rows, 5, 50)
    assert sketched(d.limit(0)) == []


def test_chains_in_large_groups_are_found_whole(spark):
    """Texts that each differ from the one before in a few words: first and last share nothing, and no bucket is one star."""
    rows = [(1000 - i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60))) for i in range(300)]
    rows += [(2000 + i, " ".join(f"p{k}" if k % 9 else f"p{k}x{i}" for k in range(90))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sketched(d) == linked(rows)


def test_every_bin_is_filled_and_equal_bins_estimate_likeness():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 3000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert len(set(minhash.sketches(x, np.array([0, n]))[0].tolist())) > min(n, 100) // 2
    errors = []
    for _ in range(40):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (320, 40, 40))
        s = minhash.sketches(np.r_[both, a, both, b], np.array([0, 360, 720]))
        errors.append((s[0] == s[1]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05
