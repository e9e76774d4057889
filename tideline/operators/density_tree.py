"""Density clusters (HDBSCAN) of groups of any size, as tables.

1. Nearest neighbours by blocks: pairs of blocks of a group's points meet in one row each, and every point keeps its nearest ones. Products of
   matrices tell which pairs can be near enough (with a margin over their rounding); only those get their distance, dimension by dimension.
   Groups of the same points (parameters of a search) share their neighbours, and those of the same depth their tree.
2. The minimum spanning tree of mutual reachability by contraction (graphs.spanning_forest). A component's least edge is looked for among its
   points' neighbours. Where unlisted neighbours could be nearer than that, its points are searched for again in blocks, or it waits and lets others
   take their edges: of a tree's components at most half wait, those with the most points to search for.
3. The merge tree from the sorted edges. A tree of more than BOUND edges is split at its middle edge: what the lighter half joins
   are trees of their own, and single nodes of the heavier half; all parts of a level are split together.
4. The condensed tree, its excess of mass and the choice of clusters by pointer doubling; chains of clusters with one open child
   are composed (largest of a constant and a sum), so that deep trees take few rounds.

Work of step 1 grows with the square of a group's points; memory does not. Equal distances are ordered by the ids of their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.graphs import cut, roots, spanning_forest
from tideline.operators.preparing import prepared, principal

#: Points of a block, neighbours kept of each point, and edges that one task sorts out.
BLOCK, LISTED, BOUND = 1024, 16, 1_000_000
#: Blocks of the other side in a row of a pair, parts that a group's blocks are dealt into, and the most tasks for that.
WIDE, DEALT, TASKS = 8, 8, 1000


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, summed dimension by dimension, so that a pair's value is the same in any block and direction."""
    d = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d += np.square(x[:, j, None] - y[None, :, j])
    return np.sqrt(d)


def _packed(points: DataFrame, *more: str) -> DataFrame:
    """(t, b, node, v and the columns `more`) -> t, b, p: each block's nodes, vectors and more columns as bytes."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf["node"].to_numpy(np.int64), np.stack(pdf["v"]).astype(float), *[pdf[c].to_numpy(np.float64 if c in FLOATS else np.int64) for c in more]]
        return pd.DataFrame({"t": [key[0]], "b": [key[1]], "p": [[x.tobytes() for x in parts]]})

    return points.select("t", "b", "node", "v", *more).groupBy("t", "b").applyInPandas(run, "t long, b int, p array<binary>")


#: Packed columns that are no longs.
FLOATS = ("core", "w")


def _unpacked(parts: list[bytes], *more: str) -> list[np.ndarray]:
    node = np.frombuffer(parts[0], np.int64)
    return [node, np.frombuffer(parts[1]).reshape(len(node), -1), *[np.frombuffer(x, np.float64 if c in FLOATS else np.int64) for x, c in zip(parts[2:], more)]]


def _met(asking: DataFrame, asked: DataFrame) -> DataFrame:
    """Packed blocks -> one, many: each asking block with the blocks of its t, WIDE of them in a row; an asking block's rows follow each other in one task.

    The blocks of a t are dealt into DEALT tasks, each of which gets all that they ask; a fixed number, as the blocks' bytes don't tell the work.
    """
    n = max(1, min(TASKS, asking.count()))
    one = asking.select("t", F.pmod("b", F.lit(DEALT)).alias("salt"), F.col("p").alias("one"))
    many = asked.groupBy("t", F.floor(F.col("b") / WIDE).alias("w")).agg(F.collect_list("p").alias("many"))
    many = many.join(one.select("t", "salt").distinct(), "t").select("t", "salt", "many")
    return one.repartition(n, "t", "salt").hint("merge").join(many.repartition(n, "t", "salt"), ["t", "salt"]).select("one", "many")


def _lifted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, margin: a @ b is the squared distance less x's own square; rows of x are off by less than their margin."""
    xx, yy = np.square(x).sum(axis=1), np.square(y).sum(axis=1)
    return np.hstack([-2 * x, np.ones((len(x), 1))]), np.vstack([y.T, yy[None, :]]), 1e-12 * (xx + yy.max())


def _exact(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """distances() of some pairs."""
    d = np.zeros(len(r))
    for j in range(x.shape[1]):
        d += np.square(x[r, j] - y[c, j])
    return np.sqrt(d)


def _firsts(keys: np.ndarray, most: int) -> np.ndarray:
    """Of sorted keys the positions of the first `most` of each."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return np.flatnonzero(np.arange(len(keys)) - np.repeat(start, np.diff(np.r_[start, len(keys)])) < most)


def _nearer(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, held: tuple, listed: int) -> tuple:
    """held (row, node, d: the nearest so far, sorted) with what block y has nearer."""
    r0, v0, d0 = held
    far = np.full(len(x), np.inf)
    full = np.flatnonzero(np.bincount(r0, minlength=len(x)) == listed)
    far[full] = d0[np.searchsorted(r0, full, "right") - 1]
    left, right, margin = _lifted(x, y)
    if np.isinf(far).any() and len(y) > listed:
        # the point itself may be among them
        some = np.argpartition(left @ right[:, : max(BLOCK, listed + 1)], listed, axis=1)[:, : listed + 1]
        rows = np.repeat(np.arange(len(x)), listed + 1)
        d = np.where(b[some.ravel()] == a[rows], np.inf, _exact(x, y, rows, some.ravel())).reshape(some.shape)
        far = np.minimum(far, np.sort(d, axis=1)[:, listed - 1])
    limit = (far * far + margin - np.square(x).sum(axis=1))[:, None]
    hits = []
    for i in range(0, len(y), BLOCK):
        g = left @ right[:, i : i + BLOCK]
        at = np.flatnonzero(g <= limit)
        hits.append((at // g.shape[1], at % g.shape[1] + i))
    r, c = (np.concatenate(z) for z in zip(*hits))
    other = a[r] != b[c]
    r, c = r[other], c[other]
    r, v, d = np.r_[r0, r], np.r_[v0, b[c]], np.r_[d0, _exact(x, y, r, c)]
    order = np.lexsort((v, d, r))
    keep = order[_firsts(r[order], listed)]
    return r[keep], v[keep], d[keep]


def _nearest(listed: int):
    """Rows of _met -> u, d, v: every asking point's nearest ones of those rows that came together."""

    def out(a: np.ndarray, held: tuple) -> pd.DataFrame:
        r, v, d = held
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        return pd.DataFrame({"u": a[r[start]], "d": np.split(d, start[1:]), "v": np.split(v, start[1:])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        last, held = None, none
        for f in frames:
            for one, many in zip(f["one"], f["many"]):
                if last is None or one[0] != last:
                    if len(held[0]):
                        yield out(a, held)
                    last, held = one[0], none
                    a, x = _unpacked(one)
                b, y = (np.concatenate(z) for z in zip(*map(_unpacked, many)))
                held = _nearer(a, x, b, y, held, listed)
        if len(held[0]):
            yield out(a, held)

    return run


def _least_of(a: np.ndarray, x: np.ndarray, ca: np.ndarray, la: np.ndarray, wa: np.ndarray, b: np.ndarray, y: np.ndarray, cb: np.ndarray, lb: np.ndarray) -> pd.DataFrame:
    left, right, margin = _lifted(x, y)
    g = left @ right
    g[la[:, None] == lb[None, :]] = np.inf
    rows = np.flatnonzero(np.isfinite(g).any(axis=1))
    most = wa.copy()
    if len(rows):
        near = g[rows].argmin(axis=1)
        most[rows] = np.minimum(most[rows], np.maximum(np.maximum(_exact(x, y, rows, near), ca[rows]), cb[near]))
    r, c = np.nonzero((g <= (most * most + margin - np.square(x).sum(axis=1))[:, None]) & np.isfinite(g))
    w = np.maximum(np.maximum(_exact(x, y, r, c), ca[r]), cb[c])
    u, v = np.minimum(a[r], b[c]), np.maximum(a[r], b[c])
    order = np.lexsort((v, u, w, la[r]))
    keep = order[_firsts(la[r][order], 1)]
    return pd.DataFrame({"u": u[keep], "v": v[keep], "w": w[keep]})


def _least_outgoing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of _met -> of each asking component the edge to another that is least by (w, smaller end, larger end), where one is not over what it knows."""
    for f in frames:
        for one, many in zip(f["one"], f["many"]):
            x = _unpacked(one, "core", "comp", "w")
            for p in many:
                yield _least_of(*x, *_unpacked(p, "core", "comp"))


def _dealt(block: int, n: str = "n"):
    return F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col(n) / block).cast("int"))).cast("int")


def reachability_trees(points: DataFrame, trees: DataFrame, depths: int, listed: int = LISTED, block: int = BLOCK) -> DataFrame:
    """points (node, t, v, n: their number in t, at least two) and trees (t, ki, k) -> u, v, w: the minimum spanning trees of each t's mutual reachability,
    k neighbours deep; their nodes are node * depths + ki."""
    blocks = cut(_packed(points.withColumn("b", _dealt(block))))
    n = max(listed, trees.agg(F.max("k")).first()[0] or 0)
    near = _met(blocks, blocks).mapInPandas(_nearest(n), "u long, d array<double>, v array<long>")
    lists = near.groupBy("u").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "v")))), 1, n).alias("near"))
    deep = trees.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("ki", "k"))).alias("ks"))
    cores = F.transform("ks", lambda x: F.struct(x["ki"].alias("ki"), F.element_at("near", F.least(x["k"], F.size("near")))["d"].alias("core")))
    lists = cut(points.select("node", "t").join(deep, "t").join(lists, F.col("node") == F.col("u")).select("node", "t", "near", cores.alias("cores")))
    each = lists.select("node", "t", F.size("near").alias("found"), F.element_at("near", -1)["d"].alias("end"), F.inline("cores"))
    # beyond its list a point has nothing nearer than the list's last, and a list shorter than n is all there is
    name = lambda x: F.col(x) * depths + F.col("ki")
    full = cut(each.select("node", "ki", name("node").alias("named"), (F.col("t") * depths + F.col("ki")).alias("tree"), "t", "core", F.when(F.col("found") == n, F.greatest("core", "end")).alias("far")))
    pairs = lists.select("node", F.inline("near"), "cores")
    pairs = pairs.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"), "d").distinct()
    ends = lambda x: lists.select(F.col("node").alias(x), F.col("cores").alias("c" + x))
    e = pairs.join(ends("u"), "u").join(ends("v"), "v").select("u", "v", "d", F.inline(F.arrays_zip("cu", "cv")))
    e = e.select("u", "v", F.col("cu.ki").alias("ki"), F.greatest("d", "cu.core", "cv.core").alias("w")).select(name("u").alias("u"), name("v").alias("v"), "w")
    edges = e.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))
    vectors = points.select("node", "v")

    def further(labels: DataFrame, best: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        known = labels.join(full.select(F.col("named").alias("node"), "tree", "far"), "node").join(best.select("comp", "w"), "comp", "left")
        asks = F.col("far").isNotNull() & (F.col("w").isNull() | (F.col("far") <= F.col("w")))
        comps = cut(known.groupBy("tree", "comp").agg(F.count_if(asks).alias("asks"), F.first("w").alias("w")))
        number = comps.groupBy("tree").agg(F.count("*").alias("c")).where("c > 1")
        order = Window.partitionBy("tree").orderBy(F.col("asks").desc(), "comp")
        doubtful = cut(comps.where("asks > 0").join(number, "tree").withColumn("waits", F.row_number().over(order) <= F.floor(F.col("c") / 2)))
        held, taken = doubtful.where("waits").select("comp"), doubtful.where("not waits").select("comp")
        if taken.head() is None:
            return None, held
        ask = labels.join(taken, "comp").join(full.select(F.col("named").alias("node"), F.col("node").alias("pt"), "tree", "core", "far"), "node").join(best.select("comp", "w"), "comp", "left").where("w is null or far <= w")
        ask = cut(ask.where("far is not null").select("node", "pt", F.col("tree").alias("t"), "core", "comp", F.coalesce("w", F.lit(float("inf"))).alias("w")))
        count = lambda d: d.groupBy("t").agg(F.count("*").alias("n"))
        with_vectors = lambda d: d.join(count(d), "t").withColumn("b", _dealt(block)).join(vectors.toDF("pt", "v"), "pt")
        rest = full.select(F.col("named").alias("node"), F.col("node").alias("pt"), F.col("tree").alias("t"), "core").join(ask.select("t").distinct(), "t", "left_semi").join(labels, "node")
        one, two = cut(_packed(with_vectors(ask), "core", "comp", "w")), cut(_packed(with_vectors(rest), "core", "comp"))
        got = _met(one, two).mapInPandas(_least_outgoing, "u long, v long, w double")
        return cut(got.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))), held

    tree, _ = spanning_forest(full.select(F.col("named").alias("node")), edges, further)
    return tree.select("u", "v", "w")


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part's edges -> its merges in order: e, the two nodes that meet, and the size of what they become. A merge is the node -1 - e."""
    pdf = pdf.sort_values("e")
    size = {**dict(zip(pdf["u"], pdf["su"])), **dict(zip(pdf["v"], pdf["sv"]))}
    up = {x: x for x in size}
    name = dict(up)

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for e, u, v in zip(pdf["e"].tolist(), pdf["u"].tolist(), pdf["v"].tolist()):
        a, b = find(u), find(v)
        if size[a] < size[b]:
            a, b = b, a
        out.append((e, name[a], name[b], size[a] + size[b]))
        up[b], name[a], size[a] = a, -1 - e, size[a] + size[b]
    return pd.DataFrame(out, columns=["e", "one", "two", "size"])


def merge_tree(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """edges (part, e, u, v) of forests, e in the order of merging -> e, one, two, size: the nodes that each edge joins (points as they are, the merge of
    an earlier edge f as -1 - f) and how many points that makes. No task gets more than `bound` edges."""
    d = cut(edges.select("part", "e", "u", "v", F.lit(1).cast("long").alias("su"), F.lit(1).cast("long").alias("sv")))
    done = None
    while True:
        sizes = d.groupBy("part").agg(F.count("*").alias("n"), F.percentile_approx("e", 0.5, 1000).alias("middle"), F.max("e").alias("last"))
        small = d.join(sizes.where(F.col("n") <= bound).select("part"), "part", "left_semi")
        merged = cut(small.groupBy("part").applyInPandas(_merge, "e long, one long, two long, size long"))
        done = merged if done is None else done.unionByName(merged)
        big = cut(d.join(sizes.where(F.col("n") > bound), "part").withColumn("light", F.col("e") <= F.least("middle", F.col("last") - 1)))
        if big.head() is None:
            return done
        # nodes are told apart by their part: the same name may be in one part only
        light = big.where("light")
        nodes = light.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        ordered = light.select("u", "v", F.col("e").cast("double").alias("w"), F.col("e").alias("a"), F.col("e").alias("b"))
        comps = cut(spanning_forest(nodes, ordered)[1])
        held = light.select("e", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("su").alias("s")), F.struct(F.col("v").alias("node"), F.col("sv").alias("s")))).alias("x")).select("e", "x.*")
        tops = held.join(comps, "node").groupBy("root").agg(F.max("e").alias("top"))
        weight = held.select("node", "s").distinct().join(comps, "node").groupBy("root").agg(F.sum("s").alias("s"))
        renamed = cut(comps.join(tops, "root").join(weight, "root").select("node", (-1 - F.col("top")).alias("name"), F.col("s").alias("weight"), "top"))
        parts = light.join(renamed.select(F.col("node").alias("u"), "top"), "u").select((2 * F.col("top")).alias("part"), "e", "u", "v", "su", "sv")
        heavy = big.where("not light")
        for x in ("u", "v"):
            heavy = heavy.join(renamed.select(F.col("node").alias(x), F.col("name").alias(f"n{x}"), F.col("weight").alias(f"w{x}")), x, "left")
            heavy = heavy.withColumns({x: F.coalesce(f"n{x}", x), f"s{x}": F.coalesce(f"w{x}", f"s{x}")})
        heavy = heavy.select((2 * F.col("last") + 1).alias("part"), "e", "u", "v", "su", "sv")
        d = cut(parts.unionByName(heavy))


def _totals(tree: DataFrame) -> DataFrame:
    """(c, parent, mass) -> (c, total): of a leaf its mass, of another the larger of its mass and its children's totals."""
    tree = cut(tree)
    known = tree.join(tree.select(F.col("parent").alias("c")), "c", "left_anti").select("c", F.col("mass").alias("total"))
    open_ = tree.join(known, "c", "left_anti")
    chains = None
    known, open_ = cut(known), cut(open_)
    while open_.head() is not None:
        kids = tree.join(open_.select(F.col("c").alias("parent")), "parent", "left_semi").join(known, "c", "left")
        seen = kids.groupBy("parent").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("sum"), F.count_if(F.col("total").isNull()).alias("waits"), F.max(F.when(F.col("total").isNull(), F.col("c"))).alias("on"))
        now = open_.join(seen, open_.c == seen.parent).select("c", "mass", "sum", "waits", "on")
        # an open cluster with one open child is max(m, a + total of `on`); such chains are composed
        links = now.where("waits = 1").select("c", F.col("mass").alias("m"), F.col("sum").alias("a"), "on")
        if chains is not None:
            links = links.join(chains, "c", "left_anti").unionByName(chains)
        links = cut(links)
        nxt = links.select(F.col("c").alias("_c"), F.col("m").alias("_m"), F.col("a").alias("_a"), F.col("on").alias("_on"))
        links = links.join(nxt, links.on == nxt["_c"], "left").select("c", F.when(F.col("_c").isNull(), F.col("m")).otherwise(F.greatest("m", F.col("a") + F.col("_m"))).alias("m"), (F.col("a") + F.coalesce("_a", F.lit(0.0))).alias("a"), F.coalesce("_on", "on").alias("on"))
        links = cut(links)
        ends = links.join(known.select(F.col("c").alias("on"), "total"), "on").select("c", F.greatest("m", F.col("a") + F.col("total")).alias("total"))
        settled = now.where("waits = 0").select("c", F.greatest("mass", "sum").alias("total")).unionByName(ends).groupBy("c").agg(F.max("total").alias("total"))
        known = cut(known.unionByName(settled))
        chains = cut(links.join(known, "c", "left_anti"))
        open_ = cut(open_.join(known, "c", "left_anti"))
    return known


def _topmost(tree: DataFrame) -> DataFrame:
    """(c, parent, chosen) -> (c, top): the chosen cluster nearest the root on the way up from c; null without one."""
    d = cut(tree.select("c", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("c")).alias("top")))
    while True:
        over = d.select(F.col("c").alias("_c"), F.col("up").alias("_u"), F.col("top").alias("_t"))
        d = cut(d.join(over, d.up == over["_c"], "left").select("c", F.col("_u").alias("up"), F.coalesce("_t", "top").alias("top")))
        if d.where("up is not null").head() is None:
            return d.select("c", "top")


def density_clusters(df: DataFrame, bound: int = BOUND, block: int = BLOCK, listed: int = LISTED) -> DataFrame:
    """(g, id, v, k, m): points of groups, with each group's neighbours k and least cluster size m -> g, id, label, confidence.

    label is the smallest id of a cluster, -1 for noise; confidence is the point's density over the cluster's greatest. Groups of fewer than
    2 m points are noise. ids are longs, unique in a group; vectors are finite and of one length in a group. An empty table gives an empty result.
    A column s, if there is one, names groups of the same ids and vectors; what they have in common is done once.
    """
    shared = "s" in df.columns
    df = df.select("g", "id", "v", "k", "m", *["s"] * shared) if shared else df.withColumn("s", F.col("g"))
    points = df.select("s", "id", "v")
    points = points.dropDuplicates(["s", "id"]) if shared else points
    # numbers in the order of (s, id): equal distances are ordered by them
    points = cut(points.orderBy("s", "id").select(F.monotonically_increasing_id().alias("node"), "s", "id", "v"))
    spaces = points.groupBy("s").agg(F.min("node").alias("t"), F.count("*").alias("n"))
    groups = df.select("s", "g", "k", "m").distinct().join(spaces, "s").withColumn("k", F.least("k", F.col("n") - 1).cast("int"))
    groups = groups.withColumn("ki", F.dense_rank().over(Window.partitionBy("t").orderBy("k")) - 1)
    groups = cut(groups.withColumn("mi", F.row_number().over(Window.partitionBy("t", "k").orderBy("m", "g")) - 1))
    # a point is node * depths + ki in a tree, and that times `sizes` plus mi in a group
    depths, least = (1 + (x or 0) for x in groups.agg(F.max("ki"), F.max("mi")).first())
    named = lambda x: (F.col(x) * depths + F.col("ki")) * least + F.col("mi")
    trees = cut(groups.where("n >= 2 * m and n > 1").select("t", "n", "ki", "k").distinct())
    some = points.join(spaces, "s").join(trees.select("t").distinct(), "t", "left_semi").select("node", "t", "v", "n")
    tree = reachability_trees(cut(some), trees, depths, listed, block)
    members = cut(points.select("node", "s", "id").join(groups.select("s", "g", "ki", "mi"), "s").select(named("node").alias("node"), "g", "id"))
    of = points.select("node", "s").join(spaces, "s").select("node", "t")
    e = tree.withColumns({"node": F.floor(F.col("u") / depths).cast("long"), "ki": F.pmod("u", F.lit(depths)).cast("int")}).join(of, "node")
    e = cut(e.orderBy("t", "ki", "w", "u", "v").select(F.monotonically_increasing_id().alias("e"), "t", "ki", "u", "v", "w"))
    first = e.groupBy("t", "ki").agg(F.min("e").alias("part"))
    merges = merge_tree(e.join(first, ["t", "ki"]).select("part", "e", "u", "v"), bound).join(e.select("e", "t", "ki", "w"), "e")
    # from here on every group by itself
    its = groups.where("n >= 2 * m and n > 1").select("t", "ki", "mi", "g", "m")
    node = lambda x: F.when(F.col(x) >= 0, F.col(x) * least + F.col("mi")).otherwise(-1 - ((-1 - F.col(x)) * least + F.col("mi"))).alias(x)
    merges = merges.join(its, ["t", "ki"]).select((F.col("e") * least + F.col("mi")).alias("e"), node("one"), node("two"), "size", "g", "m", "w")
    lam = 1 / F.greatest("w", F.lit(1e-12))
    merges = cut(merges.select("e", "one", "two", "size", "g", "m", lam.alias("lam")))
    kids = merges.select((-1 - F.col("e")).alias("parent"), "g", "m", "lam", F.explode(F.array("one", "two")).alias("node"))
    inner = merges.select((-1 - F.col("e")).alias("node"), "size")
    kids = cut(kids.join(inner, "node", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long"))))
    big = kids.where("size >= m")
    split = big.groupBy("parent").count().where("count = 2").select("parent")
    starts = cut(big.join(split, "parent").select("node", "parent", "g", F.col("lam").alias("born")))
    tops = merges.join(kids.select((-1 - F.col("node")).alias("e")), "e", "left_anti").select((-1 - F.col("e")).alias("node"), "g")
    # every merge of m points or more belongs to the cluster that starts at or above it
    mature = merges.where("size >= m").select((-1 - F.col("e")).alias("node"))
    ups = mature.join(big.select("node", "parent"), "node", "left").join(starts.select(F.col("node").alias("_s")), F.col("node") == F.col("_s"), "left")
    cluster = cut(roots(ups.select("node", F.when(F.col("_s").isNotNull() | F.col("parent").isNull(), F.col("node")).otherwise(F.col("parent")).alias("up"))).toDF("node", "c"))
    born = starts.select("node", "born", "parent").unionByName(tops.select("node", F.lit(0.0).alias("born"), F.lit(None).cast("long").alias("parent")))
    born = cut(born.join(cluster.toDF("parent", "above"), "parent", "left").select(F.col("node").alias("c"), "born", F.col("above").alias("parent")))
    # points leave a cluster with the smaller part that they are in, or with a split
    leave = kids.where("size < m").select("parent", "size", "lam").unionByName(starts.join(kids.select("node", "size"), "node").select("parent", "size", F.col("born").alias("lam")))
    leave = leave.join(cluster.toDF("parent", "c"), "parent").join(born.select("c", "born"), "c")
    mass = leave.groupBy("c").agg(F.sum(F.col("size") * (F.col("lam") - F.col("born"))).alias("mass"))
    nodes = cut(born.join(mass, "c", "left").select("c", "parent", F.coalesce("mass", F.lit(0.0)).alias("mass")))
    total = _totals(nodes)
    under = nodes.join(total, "c").groupBy("parent").agg(F.sum("total").alias("under")).where("parent is not null")
    chosen = nodes.join(under.select(F.col("parent").alias("c"), "under"), "c", "left").select("c", "parent", (F.col("parent").isNotNull() & (F.col("mass") >= F.coalesce("under", F.lit(0.0)))).alias("chosen"))
    top = _topmost(chosen)
    # the merge at which a point leaves: the first above it that has m points
    small = kids.where("size < m").select("node", F.col("parent").alias("up"))
    left = roots(small).where("node >= 0").select("node", F.col("root").alias("fall"))
    lams = merges.select((-1 - F.col("e")).alias("fall"), "lam")
    placed = left.join(lams, "fall").join(cluster.toDF("fall", "c"), "fall").join(top, "c").where("top is not null").select("node", "lam", "top")
    placed = cut(placed.join(members.select("node", "id"), "node"))
    about = placed.groupBy("top").agg(F.min("id").alias("label"), F.max("lam").alias("most"))
    placed = placed.join(about, "top").select("node", "label", F.least(F.lit(1.0), F.col("lam") / F.col("most")).alias("confidence"))
    return members.join(placed, "node", "left").select("g", "id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def qualities(d: DataFrame, most_noise: float = 0.3) -> DataFrame:
    """(g, id, v, label, confidence) -> g, quality: of each group .3 number + .2 sizes + .2 tightness + .2 noise + .1 confidence; 0 without a cluster."""
    named = d.where("label <> -1")
    x = named.select("g", "id", "label", F.posexplode("v").alias("p", "x"))
    centre = x.groupBy("g", "label", "p").agg(F.avg("x").alias("c"))
    far = x.join(centre, ["g", "label", "p"]).groupBy("g", "id", "label").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("far"))
    each = far.groupBy("g", "label").agg(F.count("*").alias("n"), F.avg("far").alias("far"))
    each = each.groupBy("g").agg(F.count("*").alias("k"), F.avg(F.when(F.col("n") < 5, 0.0).otherwise(F.least(F.lit(1.0), F.col("n") / 10))).alias("sizes"), F.avg(F.exp(-F.col("far"))).alias("tight"))
    all_ = d.groupBy("g").agg((F.count_if(F.col("label") == -1) / F.count("*")).alias("noise"), F.avg(F.when(F.col("label") != -1, F.col("confidence"))).alias("sure"))
    k = F.col("k")
    number = F.when(k < 5, k / 5).when(k > 40, 1 - (k - 40) / 40).otherwise(1.0)
    calm = F.when(F.col("noise") <= most_noise, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("noise") - most_noise) / 0.2))
    score = 0.3 * number + 0.2 * F.col("sizes") + 0.2 * F.col("tight") + 0.2 * calm + 0.1 * F.col("sure")
    return all_.join(each, "g", "left").select("g", F.coalesce(score, F.lit(0.0)).alias("quality"))


def density_search(df: DataFrame, group: str, id_: str, vector: str, dims: tuple[int, ...] = (8, 12, 15), sizes: tuple[int, ...] = (5, 10), samples: tuple[int, ...] = (3, 5)) -> DataFrame:
    """group, id, label, confidence, dims, min_cluster_size, min_samples: clusters of prepared vectors under the parameters of each group's best quality.

    All parameters of all groups are clustered together, each as a group of its own. Of equal qualities the first parameters (in the order given) win.
    """
    v = cut(principal(prepared(df, group, id_, vector), group, id_, list(dims)))
    grid = [F.struct(F.lit(n).alias("m"), F.lit(k).alias("k")) for n in sizes for k in samples]
    d = v.select(F.col(group).alias("_group"), F.col(id_).alias("id"), "dims", "v", F.inline(F.array(*grid)))
    d = cut(d.withColumn("g", F.struct("_group", "dims", "m", "k")))
    found = cut(density_clusters(d.select("g", "id", "v", "k", "m", F.struct("_group", "dims").alias("s"))))
    score = qualities(found.join(d.select("g", "id", "v"), ["g", "id"]))
    place = lambda name, given: F.array_position(F.array(*[F.lit(x) for x in given]), F.col(f"g.{name}"))
    best = score.groupBy(F.col("g._group").alias("_group")).agg(F.min_by("g", F.struct((-F.col("quality")).alias("q"), place("dims", dims).alias("a"), place("m", sizes).alias("b"), place("k", samples).alias("c"))).alias("g"))
    return found.join(best, "g").select(F.col("_group").alias(group), F.col("id").alias(id_), "label", "confidence", F.col("g.dims").alias("dims"), F.col("g.m").alias("min_cluster_size"), F.col("g.k").alias("min_samples"))


def _nearest_of(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, a, x, b, y in zip(f["g"], f["na"], f["va"], f["nb"], f["vb"]):
                d = distances(np.stack(x), np.stack(y))
                d[np.asarray(a)[:, None] == np.asarray(b)[None, :]] = np.inf
                at = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(a)), at.shape[1])
                out = pd.DataFrame({"g": g, "u": np.asarray(a)[rows], "v": np.asarray(b)[at.ravel()], "d": d[rows, at.ravel()]})
                yield out[np.isfinite(out["d"])]

    return run


def _nearest_fitted_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for g, a, x, b, y in zip(f["g"], f["na"], f["va"], f["nb"], f["vb"]):
            d, b = distances(np.stack(x), np.stack(y)), np.asarray(b)
            order = np.argsort(b, kind="stable")
            at = order[d[:, order].argmin(axis=1)]
            yield pd.DataFrame({"g": g, "id": np.asarray(a), "node": b[at], "d": d[np.arange(len(at)), at]})


def assign(fitted: DataFrame, new: DataFrame, k: int = 5, reach: float = 1.5, block: int = BLOCK) -> DataFrame:
    """fitted (g, id, v, label) and new points (g, id, v) -> g, id, label, confidence of the new ones.

    A new point takes the label of the nearest fitted point (of equally near ones the smallest id) if it is not farther than `reach` times that point's own
    k-th neighbour, else -1; so do points of groups without a fitted one. Confidence is exp(-distance), 0 for noise.
    """
    def blocks(d: DataFrame, n: str, v: str) -> DataFrame:
        size = d.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
        d = d.join(size, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")))
        return d.groupBy("g", "b").agg(F.collect_list(F.struct("id", "v")).alias("p")).select("g", F.col("p.id").alias(n), F.col("p.v").alias(v))

    known = cut(blocks(fitted, "nb", "vb"))
    own = known.select("g", F.col("nb").alias("na"), F.col("vb").alias("va")).join(known, "g")
    near = own.mapInPandas(_nearest_of(k), f"g {dict(fitted.dtypes)['g']}, u long, v long, d double")
    core = near.groupBy("g", F.col("u").alias("node")).agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("near")).select("g", "node", F.element_at("near", -1).alias("core"))
    asked = blocks(new, "na", "va").join(known, "g").mapInPandas(_nearest_fitted_of, f"g {dict(fitted.dtypes)['g']}, id long, node long, d double")
    best = asked.groupBy("g", "id").agg(F.min(F.struct("d", "node")).alias("x")).select("g", "id", "x.*")
    best = best.join(core, ["g", "node"], "left").join(fitted.select("g", F.col("id").alias("node"), "label"), ["g", "node"])
    best = best.select("g", "id", F.when(F.col("d") <= reach * F.col("core"), F.col("label")).alias("label"), "d")
    out = new.select("g", "id").join(best, ["g", "id"], "left")
    label = F.coalesce("label", F.lit(-1).cast("long"))
    return out.select("g", "id", label.alias("label"), F.when(label >= 0, F.exp(-F.col("d"))).otherwise(0.0).alias("confidence"))
