"""SimHash near-duplicates, linked through BK-trees.

Fingerprints are made in the JVM: 3-word shingles, XXH64, and 64 bit counters packed two to a long, so a document's
shingles meet in one partial aggregate. Linking works on distinct fingerprints only, so exact copies cost nothing.

Two fingerprints that differ in at most r bits agree on some `blocks - r` of `blocks` bit blocks. Each choice of blocks
routes every fingerprint to one shard; each shard holds a BK-tree (children keyed by integer Hamming distance to
the parent) that is searched with radius r, following only edges whose key is within r of the distance at hand.
Shards are shipped to the tasks that search them by the shuffle and not as broadcast variables: together they
grow with the corpus. The number of blocks follows the number of fingerprints, so that a shard of unrelated
fingerprints stays small at any size; the result is exact for every choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, connected_components, cut, one_row_each, pieces

RADIUS = 3
SPACE = r"[\x20\x09-\x0D]"
#: Runs up to this size are handled in plain Python, larger ones by array operations.
SMALL = 24
#: Queries searched at a time in a large tree.
CHUNK = 1024
LOW = 0x0000000100000001


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., text) -> (keys..., n_shingles, fp long). Null or blank text: fp 0. Rows with equal keys are one document."""
    words = pieces(ascii_lower(F.coalesce("text", F.lit(""))), SPACE)
    d = docs.select(*keys, words.alias("w"))
    n = F.size("w")
    three = F.arrays_zip(F.slice("w", 1, n - 2).alias("a"), F.slice("w", 2, n - 2).alias("b"), F.slice("w", 3, n - 2).alias("c"))
    short = F.array(F.struct(F.array_join("w", " ").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c")))
    d = d.select(*keys, F.inline_outer(F.when(n >= 3, three).when(n > 0, short)))
    d = d.select(*keys, F.when(F.col("a").isNotNull(), F.xxhash64(F.concat_ws(" ", "a", "b", "c"))).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LOW))).alias(f"s{j}") for j in range(32)]
    g = d.groupBy(*keys).agg(F.count("h").alias("n_shingles"), *sums)
    bits = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{j}", 32)
        for count, bit in ((low, j), (high, j + 32)):
            one = F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")
            bits = bits.bitwiseOR(F.when(2 * count > F.col("n_shingles"), one).otherwise(F.lit(0).cast("long")))
    return g.select(*keys, "n_shingles", bits.alias("fp"))


def block_choices(n: int, radius: int = RADIUS, room: int = 16) -> list[int]:
    """Bit masks of the shard keys: the fewest blocks for which n unrelated fingerprints leave about `room` to a shard."""
    blocks = radius + 1
    while True:
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(parts[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
        if n <= room << min(m.bit_count() for m in masks) or blocks >= radius + 4:
            return masks
        blocks += 1


class BKTree:
    """A BK-tree over distinct 64-bit values, built and searched level by level over arrays."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.child = np.full((len(values), 65), -1, np.int32)
        level = [(0, np.arange(1, len(values)))]
        while level:
            following = []
            for node, below in level:
                if not len(below):
                    continue
                d = np.bitwise_count(values[below] ^ values[node])
                order = np.argsort(d, kind="stable")
                below, d = below[order], d[order]
                starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                for a, b in zip(starts, np.r_[starts[1:], len(d)]):
                    self.child[node, d[a]] = below[a]
                    following.append((below[a], below[a + 1 : b]))
            level = following

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (positions in queries, node numbers) of values within the radius."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            qs, nodes = [], []
            for off in range(-radius, radius + 1):
                at = d + off
                ok = (at >= 1) & (at <= 64)
                c = self.child[node[ok], at[ok]]
                qs.append(q[ok][c >= 0])
                nodes.append(c[c >= 0].astype(np.int64))
            q, node = np.concatenate(qs), np.concatenate(nodes)


def _settle(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs (a, b) in the forest root, which stays flat."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(ra[differ], rb[differ]), np.minimum(ra[differ], rb[differ]))
        while not np.array_equal(root, up := root[root]):
            root = up


def shard_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct values: no link between components is lost, no clique is emitted."""
    if len(values) <= SMALL:
        v = values.tolist()
        children: list[dict[int, int]] = [{} for _ in v]
        root = list(range(len(v)))

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        ends = []
        for x in range(1, len(v)):
            todo = [0]
            while todo:
                node = todo.pop()
                d = (v[x] ^ v[node]).bit_count()
                if d <= radius and (a := find(node)) != (b := find(x)):
                    root[max(a, b)] = min(a, b)
                    ends.append((x, node))
                todo += [c for k, c in children[node].items() if d - radius <= k <= d + radius]
            node = 0
            while (nxt := children[node].get(d := (v[x] ^ v[node]).bit_count())) is not None:
                node = nxt
            children[node][d] = x
        e = np.array(ends, np.int64).reshape(-1, 2)
        return values[e[:, 0]], values[e[:, 1]]
    tree, root = BKTree(values), np.arange(len(values))
    for start in range(0, len(values), CHUNK):
        for q, node in tree.search(values[start : start + CHUNK], radius):
            root = _settle(root, q + start, node)
    away = np.flatnonzero(root != np.arange(len(values)))
    return values[away], values[root[away]]


def _search_shards(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def emit(t, k, fp, last):
            """Links of all finished runs, and what is left of the run that may go on."""
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = np.r_[0, cuts, len(fp)]
            stop = len(bounds) - 1 if last else len(bounds) - 2
            sizes = np.diff(bounds)
            us, vs = [], []
            for i in np.flatnonzero(sizes[:stop] > 1):
                u, v = shard_links(fp[bounds[i] : bounds[i + 1]].view(np.uint64), radius)
                us.append(u)
                vs.append(v)
            rest = None if last else (t[bounds[stop] :], k[bounds[stop] :], fp[bounds[stop] :])
            u, v = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (us, vs))
            return pd.DataFrame({"u": u, "v": v}), rest

        for f in frames:
            now = tuple(f[c].to_numpy() for c in ("t", "k", "fp"))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            if len(now[2]):
                out, held = emit(*now, last=False)
                yield out
        if held is not None:
            yield emit(*held, last=True)[0]

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fps (fp long) -> edges (u, v): in every shard a spanning forest of the pairs within the radius."""
    masks = block_choices(fps.count(), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks)])
    routed = fps.select("fp", F.inline(keys)).repartition("t", "k").sortWithinPartitions("t", "k")
    return routed.select("t", "k", "fp").mapInPandas(_search_shards(radius), "u long, v long")


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    """documents -> (doc_id, th, fp, label, component_id), one row for each pair of doc_id and text; label is the component's own name."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.length("text").alias("tn"))
    d = cut(fingerprints(d, ("doc_id", "th", "tn")).select("doc_id", "th", "fp"))
    nodes = cut(d.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = connected_components(links(nodes.select("fp"), radius))
    named = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    groups = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return d.join(named.join(groups, "label").select("fp", "label", "component_id"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """documents -> (doc_id, fingerprint, component_id), one row per document.

    Rows that repeat a doc_id and text are one document and give one row. Null and blank texts have
    fingerprint zero and link like any other; a null doc_id keeps its row and never names a component unless all its
    members are null. Extra columns are ignored, whatever their names. A bit that is set in exactly half of the shingles is 0. Very long texts are
    read whole; an empty table gives an empty result.
    """
    return _grouped(docs, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate group: of the texts under its smallest doc_id the one of the smallest hash. Columns as given.

    Documents are told apart by doc_id and text, so another text under the same or a null doc_id is kept or goes by its own group;
    a null doc_id is kept only where all of a group are null. Of rows that repeat the kept doc_id and text one stays (the smallest by the hash of all its columns). Null
    and blank texts are one group; an empty table gives an empty result; columns may have any name.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("x")
    kept = _grouped(docs, radius).groupBy("label").agg(first).select("x.doc_id", "x.th")
    return one_row_each(docs, kept)
