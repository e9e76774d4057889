"""Nearest neighbours by cosine: matrix products over Arrow batches against blocks of a checked size, and one merge of the k best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that are shipped to every task at a time, and rows of a product of two batches that are held at a time (8 bytes * CHUNK * 10,000).
BLOCK, CHUNK = 10_000, 256


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; null and zero vectors stay zero, so that their cosines are 0."""
    width = next((len(v) for v in vectors if v is not None), 0)
    x = np.array([np.zeros(width) if v is None else v for v in vectors], np.float64).reshape(len(vectors), width)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _blocks(df: DataFrame, id_: str, n: int) -> Iterator[pd.DataFrame]:
    """The rows in blocks of about n, dealt by hash; one block at a time is on the driver."""
    parts = -(-df.count() // n)
    for i in range(parts):
        yield (df if parts == 1 else df.where(F.pmod(F.xxhash64(id_), F.lit(parts)) == i)).toPandas()


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, of equal ones those that come first: one partition a row, and no sort."""
    n = s.shape[1]
    if k >= n:
        return np.broadcast_to(np.arange(n), s.shape)
    least = np.partition(s, n - k, axis=1)[:, n - k, None]
    over, tied = s > least, s == least
    free = k - over.sum(axis=1, keepdims=True)
    return np.nonzero(over | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= free)))[1].reshape(len(s), k)


def nearest_in_table(table: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """q, n, s: the k rows of the table nearest to each query row (its own id aside), equal cosines by the smaller id.

    The table is read in place; each task keeps the k best of a query over all its batches, so that
    tasks times queries times k small rows are shuffled.
    """
    kind, out = dict(table.dtypes)[id_], None
    for block in _blocks(queries.select(id_, vector), id_, BLOCK):
        ids, q = block[id_].to_numpy(), _unit(block[vector])

        def run(frames: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            best = None
            for f in frames:
                if not len(f):
                    continue
                f = f.sort_values(id_)  # of equal cosines the smaller id comes first
                n, x = f[id_].to_numpy(), _unit(f[vector]).T
                for i in range(0, len(ids), CHUNK):
                    own = ids[i : i + CHUNK]
                    s = np.round(q[i : i + CHUNK] @ x, digits)
                    s[own[:, None] == n[None, :]] = -np.inf
                    at = _best(s, k)
                    here = pd.DataFrame({"q": np.repeat(own, at.shape[1]), "n": n[at].ravel(), "s": np.take_along_axis(s, at, 1).ravel()})
                    best = here if best is None else pd.concat([best, here])
                best = best.sort_values(["q", "s", "n"], ascending=[True, False, True]).groupby("q", sort=False).head(k)
            if best is not None:
                yield best[best["s"] > -np.inf]

        got = table.select(id_, vector).mapInPandas(run, f"q {kind}, n {kind}, s double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return table.select(F.col(id_).alias("q"), F.col(id_).alias("n"), F.lit(0.0).alias("s")).limit(0)
    w = Window.partitionBy("q").orderBy(F.desc("s"), "n")
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def vote(rows: DataFrame, keys: list[str], vector: str, known: DataFrame, label: str, k: int) -> DataFrame:
    """keys, label, prob: shares of the labels among the k labelled vectors nearest to each row.

    The labelled vectors come in blocks of a checked size; a row keeps its k best of each block and then of all. Equal cosines are
    ordered by a hash of vector and label, so that results don't depend on how files lie.
    """
    kinds, out = dict(rows.dtypes), None
    known = known.select(F.xxhash64(vector, label).alias("_id"), F.col(vector).alias("_v"), F.col(label).cast("string").alias("_l")).where("_l is not null and _v is not null")
    for block in _blocks(known, "_v", BLOCK):
        block = block.sort_values(["_id", "_l"])
        names, x, order = block["_l"].to_numpy(), _unit(block["_v"]), block["_id"].to_numpy()

        def run(frames: Iterator[pd.DataFrame], names=names, x=x, order=order) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                for i in range(0, len(f), CHUNK):
                    part = f.iloc[i : i + CHUNK]
                    s = np.round(_unit(part[vector]) @ x.T, 9)
                    at = _best(s, k)
                    d = part[keys].loc[part.index.repeat(at.shape[1])].reset_index(drop=True)
                    yield d.assign(_l=names[at].ravel(), _s=np.take_along_axis(s, at, 1).ravel(), _o=order[at].ravel())

        got = rows.select(*keys, vector).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", _l string, _s double, _o long")
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("nothing is labelled")
    w = Window.partitionBy(*keys).orderBy(F.desc("_s"), "_o")
    best = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    share = F.count("*") / F.sum(F.count("*")).over(Window.partitionBy(*keys))
    return best.groupBy(*keys, F.col("_l").alias("label")).agg(share.alias("prob"))
