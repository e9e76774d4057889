"""Order-dependent selection: greedy spacing, spaced top-k, hash samples, batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.sequential import fold, spacing


def greedy_spacing(df: DataFrame, keys: list[str], t: str, gap: int) -> DataFrame:
    """keys, t: from the earliest on, each time that lies more than `gap` after the last one kept.

    The choice is sequential within a key by definition: its times are streamed in order, and only the last one kept is carried.
    """
    kinds = dict(df.dtypes)
    d = df.select(*keys, t).where(F.col(t).isNotNull())
    return fold(d, keys, [t], [t], spacing(gap), ", ".join(f"{c} {kinds[c]}" for c in [*keys, t]))


def greedy_topk(df: DataFrame, keys: list[str], t: str, score: str, id_: str, k: Column | int, gap: int) -> DataFrame:
    """keys, t, score, id: in order of ascending score (then id), each that lies more than `gap` from all kept, until k are.

    k is a number or a column that is constant within a key; what is carried are the k times kept. Null scores come first.
    """
    kinds = dict(df.dtypes)
    out = [*keys, t, score, id_]
    d = df.select(*out, (F.lit(k) if isinstance(k, int) else k).cast("long").alias("_k"))

    def step(kept: list[int] | None, used: list[np.ndarray]) -> tuple[list[int], list[int]]:
        kept = [] if kept is None else kept
        times, most, picked = used[0], int(used[1][0]), []
        if len(kept) >= most:
            return kept, picked
        free = np.ones(len(times), bool)
        for x in kept:
            free &= np.abs(times - x) > gap
        while len(kept) < most and free.any():
            at = int(free.argmax())
            picked.append(at)
            kept.append(int(times[at]))
            free[: at + 1] = False
            free &= np.abs(times - times[at]) > gap
        return kept, picked

    return fold(d, keys, [score, id_, t], [t, "_k"], step, ", ".join(f"{c} {kinds[c]}" for c in out))


def hash_sample(df: DataFrame, strata: list[str], id_: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum, in the order of md5(seed:id): the same on every engine and every run."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")).cast("binary"))
    w = Window.partitionBy(*strata).orderBy("_h", id_)
    return df.withColumn("_h", h).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_h", "_rn")


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds batch and place within it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_rn", F.row_number().over(w) - 1)
    return d.withColumn("batch", F.floor(F.col("_rn") / size).cast("long")).withColumn("place", (F.col("_rn") % size).cast("long")).drop("_rn")


def stride(df: DataFrame, keys: list[str], order: list[str], step: int, most: int) -> DataFrame:
    """Every step-th row of a key from its first on, `most` of them at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_rn", F.row_number().over(w) - 1)
    return d.where((F.col("_rn") % step == 0) & (F.floor(F.col("_rn") / step) < most)).drop("_rn")
