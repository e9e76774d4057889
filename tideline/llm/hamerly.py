"""Centroid clustering in integers, with Hamerly's bounds.

Every vector keeps its cluster, one upper bound of the distance to its own centroid and one lower bound of the distance to the second
nearest. A round moves the bounds by what the centroids have drifted; a vector whose upper bound stays below the lower
one, or below half the distance from its centroid to the next, keeps its cluster unseen. Of the others the upper bound is
made exact, and those still in doubt are scanned against all centroids in integers. Bounds are rounded outwards and compared strictly,
so that ties always reach the scan, where the smaller number wins.

A round is one pass without a shuffle of vectors: rows are written with their bounds to the shared folder, and the centroids, whose
number is a parameter, travel with the task. Sums move only by the vectors that changed their cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut

CLUSTERS, ROUNDS, SEED, DIMS, SCALE = 8, 10, 3, 64, 1024
#: Rounding of the bounds: far above the error of a square root or a sum, far below a distance of one.
SLACK = 1e-9
ROW = "vec_id {}, q array<long>, cluster int, was int, upper double, lower double"


def usable(x: Column, dims: int) -> Column:
    """Exactly `dims` components, none null, NaN or infinite."""
    d = x.cast("array<double>")
    return (F.size(x) == dims) & F.forall(d, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def _vectors(batch: pa.RecordBatch, at: int) -> np.ndarray:
    c = batch.column(at)
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _arrays(q: np.ndarray) -> pa.Array:
    n, dims = q.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dims, dims), pa.int32()), pa.array(q.reshape(-1)))


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances in 64-bit integers, refused where they would not fit."""
    d = q - c
    if d.size and np.square(d.astype(np.float64)).sum(axis=-1).max() > 9e18:
        raise OverflowError("a squared distance does not fit into 64 bits")
    return (d * d).sum(axis=-1)


def scan(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact nearest centroid (of equal ones the smaller number), an upper bound of its distance, a lower bound of the second nearest's."""
    d = np.stack([squared(q, c) for c in centroids], axis=1)
    a = d.argmin(axis=1)
    rows = np.arange(len(q))
    upper = np.sqrt(d[rows, a].astype(np.float64)) * (1 + SLACK)
    if d.shape[1] == 1:
        return a, upper, np.full(len(q), np.inf)
    d[rows, a] = np.iinfo(np.int64).max
    return a, upper, np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK)


def reassign(q, cluster, upper, lower, centroids, drift):
    """One round for vectors with bounds; drift: what each centroid has moved since (upper bounds)."""
    if len(centroids) > 1:
        apart = np.array([min(np.sqrt(float(squared(a, b))) for j, b in enumerate(centroids) if j != i) for i, a in enumerate(centroids)])
        ranked = np.sort(drift)
        away = np.where(drift[cluster] == ranked[-1], ranked[-2], ranked[-1]) if (drift == ranked[-1]).sum() == 1 else ranked[-1]
    else:
        apart, away = np.array([np.inf]), 0.0
    upper = (upper + drift[cluster]) * (1 + SLACK)
    lower = np.maximum(lower - away, 0) * (1 - SLACK)
    safe = np.maximum(lower, apart[cluster] / 2 * (1 - SLACK))
    doubt = np.flatnonzero(upper >= safe)
    if len(doubt):
        upper[doubt] = np.sqrt(squared(q[doubt], centroids[cluster[doubt]]).astype(np.float64)) * (1 + SLACK)
        doubt = doubt[upper[doubt] >= safe[doubt]]
    if len(doubt):
        cluster = cluster.copy()
        cluster[doubt], upper[doubt], lower[doubt] = scan(q[doubt], centroids)
    return cluster, upper, lower


def _start(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _vectors(b, 1)
                a, upper, lower = scan(q, centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), _arrays(q), pa.array(a, pa.int32()), pa.array(np.full(len(q), -1), pa.int32()), pa.array(upper), pa.array(lower)], names=["vec_id", "q", "cluster", "was", "upper", "lower"])

    return run


def _round(centroids: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, was = _vectors(b, 1), b.column(2).to_numpy()
                bounds = (b.column(i).to_numpy(zero_copy_only=False).copy() for i in (4, 5))
                a, upper, lower = reassign(q, was, *bounds, centroids, drift)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(a, pa.int32()), b.column(2), pa.array(upper), pa.array(lower)], names=["vec_id", "q", "cluster", "was", "upper", "lower"])

    return run


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(squared(_vectors(b, 1), centroids[a]))], names=["vec_id", "cluster", "distance"])

    return run


def _sums(moved: DataFrame, by: str, dims: int) -> dict[int, list[int]]:
    """cluster -> [number, component sums], exact, of at most one row for each cluster."""
    sums = [F.sum(F.get("q", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
    return {r[0]: [r[1], *map(int, r[2:])] for r in moved.groupBy(by).agg(F.count("*"), *sums).collect()}


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; one row a usable vector.

    Vectors of another length and those with a null, NaN or infinite component are left out, as the contract says; equal vectors and repeated vec_ids stay.
    Start centroids are the k of smallest hash; equal hashes (repeated vec_ids) are ordered by components, null vec_ids come last.
    With fewer than k vectors each is a centroid. Components whose squared distances don't fit 64 bits raise an error.
    Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * SCALE).cast("long"))
    kept = vectors.where(usable(F.col("embedding"), dims)).select("vec_id", x.alias("q"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.orderBy(key.asc_nulls_last(), "q").limit(k).collect()
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    if not seeds:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    centroids = np.array([r.q for r in seeds], np.int64)
    row = ROW.format(id_type)
    state = cut(kept.mapInArrow(_start(centroids), row))
    totals = [[0] * (dims + 1) for _ in centroids]
    for i in range(rounds):
        moved = state.where("cluster <> was")
        for sign, by in ((1, "cluster"), (-1, "was")):
            for c, s in _sums(moved, by, dims).items():
                if c >= 0:
                    totals[c] = [a + sign * b for a, b in zip(totals[c], s)]
        new = np.array([[s // t[0] for s in t[1:]] if t[0] else old.tolist() for t, old in zip(totals, centroids)], np.int64)
        drift = np.sqrt(np.square((new - centroids).astype(np.float64)).sum(axis=1)) * (1 + SLACK)
        centroids = new
        state = cut(state.mapInArrow(_round(centroids, drift), row))
    d = cut(state.mapInArrow(_distances(centroids), f"vec_id {id_type}, cluster int, distance long"))
    inertia = {r[0]: r[1] for r in d.groupBy("cluster").agg(F.sum("distance")).collect()}
    about = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    about = d.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return d.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
