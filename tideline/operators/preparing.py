"""Vectors of groups of any size made ready for clustering: stable dimensions, robust scaling, a power transform, principal components.

Statistics are aggregates by group and dimension; only tables of one row for each of these meet the vectors again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.graphs import cut
from tideline.operators.quantiles import quantiles

#: Exponents tried in the first pass, and passes, each with a sixth of the last one's step.
LOW, HIGH, TRIED, PASSES = -2.0, 4.0, 13, 5


def power(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The Yeo-Johnson transform, with an exponent for each column."""
    size, e = np.abs(x), np.where(x >= 0, lam, 2 - lam)
    flat = np.abs(e) < 1e-9
    return np.copysign(np.where(flat, np.log1p(size), (np.power(size + 1, e) - 1) / np.where(flat, 1.0, e)), x)


def _sums(g: str, tried: int, step: float):
    """A partition's vectors (v) of each group -> n, j (the Jacobian's sum of each dimension), and mean and square sum about it of every dimension under every exponent tried."""

    def merged(a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        n, far = a[0] + b[0], b[2] - a[2]
        return n, a[1] + b[1], a[2] + far * (b[0] / n), a[3] + b[3] + far * far * (a[0] * b[0] / n)

    def rows(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(name, n, j, mean.ravel(), square.ravel()) for name, (n, j, mean, square) in held.items()], columns=[g, "n", "j", "mean", "square"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for name, part in f.groupby(g):
                x = np.stack(part["v"])
                lam = np.asarray(part["lam"].iloc[0])[None, :] + (np.arange(tried) - tried // 2)[:, None] * step
                y = np.stack([power(x, t) for t in lam])
                mean = y.mean(axis=1)
                held[name] = merged(held.get(name), (len(x), (np.sign(x) * np.log1p(np.abs(x))).sum(axis=0), mean, np.square(y - mean[:, None]).sum(axis=1)))
            if len(held) > 1000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def total(pdf: pd.DataFrame) -> tuple:
        out = None
        for n, j, mean, square in zip(pdf["n"], pdf["j"], pdf["mean"], pdf["square"]):
            out = merged(out, (n, np.asarray(j), np.asarray(mean).reshape(tried, -1), np.asarray(square).reshape(tried, -1)))
        return out

    return run, total


SUMS = "n long, j array<double>, mean array<double>, square array<double>"


def exponents(d: DataFrame, g: str) -> DataFrame:
    """(g, v) -> g, lam, mean, sd by dimension: the exponent of the largest normal likelihood of each group's values, by passes over ever finer steps, and the moments under it."""
    kind = dict(d.dtypes)[g]
    step = (HIGH - LOW) / (TRIED - 1)
    lam = cut(d.groupBy(g).agg(F.max(F.size("v")).alias("n")).select(g, F.array_repeat(F.lit((LOW + HIGH) / 2), F.col("n")).alias("lam")))

    def finer(step: float):
        run, total = _sums(g, TRIED, step)

        def best(key: tuple, pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
            n, j, _, square = total(pdf)
            tried = np.asarray(at["lam"].iloc[0])[None, :] + (np.arange(TRIED) - TRIED // 2)[:, None] * step
            loss = n / 2 * np.log(np.maximum(square / n, 1e-300)) - (tried - 1) * j
            took = np.where(np.isnan(loss), np.inf, loss).argmin(axis=0)
            return pd.DataFrame({g: [key[0]], "lam": [tried[took, np.arange(tried.shape[1])]]})

        return run, best

    for _ in range(PASSES):
        run, best = finer(step)
        sums = d.select(g, "v").join(lam, g).mapInPandas(run, f"{g} {kind}, {SUMS}")
        lam = cut(sums.groupBy(g).cogroup(lam.groupBy(g)).applyInPandas(best, f"{g} {kind}, lam array<double>"))
        step = step / (TRIED // 2)
    run, total = _sums(g, 1, 0.0)

    def moments(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, _, mean, square = total(pdf)
        return pd.DataFrame({g: [key[0]], "mean": [mean[0]], "sd": [np.sqrt(square[0] / n)]})

    sums = d.select(g, "v").join(lam, g).mapInPandas(run, f"{g} {kind}, {SUMS}")
    return cut(lam.join(sums.groupBy(g).applyInPandas(moments, f"{g} {kind}, mean array<double>, sd array<double>"), g))


def prepared(df: DataFrame, g: str, id_: str, vector: str) -> DataFrame:
    """g, id, v: dimensions of variance and interquartile range over 1e-6, scaled by median and range, power-transformed and standardised. NaN and infinities are 0."""
    value = F.when(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf")), 0.0).otherwise(F.col("x"))
    d = cut(df.select(g, id_, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("p", "x")).withColumn("x", value))
    q = quantiles(d, [g, "p"], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).join(d.groupBy(g, "p").agg(F.var_pop("x").alias("var")), [g, "p"])
    q = q.where("var > 1e-6 and q3 - q1 > 1e-6").select(g, "p", "q2", (F.col("q3") - F.col("q1")).alias("range"))
    d = d.join(q, [g, "p"]).select(g, id_, F.struct("p", ((F.col("x") - F.col("q2")) / F.col("range")).alias("x")).alias("x"))
    d = cut(d.groupBy(g, id_).agg(F.array_sort(F.collect_list("x"))["x"].alias("v")))
    kind = dict(d.dtypes)

    def standard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, part in f.groupby(g):
                lam, mean, sd = (np.asarray(part[c].iloc[0]) for c in ("lam", "mean", "sd"))
                x = (power(np.stack(part["v"]), lam) - mean) / np.where(sd > 0, sd, 1.0)
                yield pd.DataFrame({g: name, id_: part[id_].to_numpy(), "v": list(x)})

    return cut(d.join(exponents(d, g), g).mapInPandas(standard, f"{g} {kind[g]}, {id_} {kind[id_]}, v array<double>"))


def _products(g: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, part in f.groupby(g, dropna=False):
                x = np.stack(part["v"])
                s = x.T @ x
                yield pd.DataFrame({g: name, "i": np.arange(len(s)), "s": list(s), "n": len(x)})

    return run


def principal(df: DataFrame, g: str, id_: str, dims: list[int]) -> DataFrame:
    """g, id, dims, v: the first `dims` principal components of standardised vectors, for each number asked for; v as it is where it has no more dimensions."""
    kind = dict(df.dtypes)
    parts = df.select(g, "v").mapInPandas(_products(g), f"{g} {kind[g]}, i int, s array<double>, n long")
    sums = parts.select(g, "i", F.posexplode("s").alias("j", "s")).groupBy(g, "i", "j").agg(F.sum("s").alias("s"))

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        # a square of the dimensions, however many vectors the group has
        n = pdf["i"].max() + 1
        a = np.zeros((n, n))
        a[pdf["i"], pdf["j"]] = pdf["s"]
        vectors = np.linalg.eigh(a)[1][:, ::-1]
        return pd.DataFrame({g: [pdf[g].iloc[0]], "axes": [vectors.T[: max(dims)].tolist()]})

    a = cut(sums.groupBy(g).applyInPandas(axes, f"{g} {kind[g]}, axes array<array<double>>"))
    dot = lambda axis: F.aggregate(F.zip_with("v", axis, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = df.join(a, g).select(g, id_, "v", F.transform("axes", dot).alias("all")).withColumn("dims", F.explode(F.array(*[F.lit(k) for k in dims])))
    v = F.when(F.col("dims") >= F.size("v"), F.col("v")).otherwise(F.slice("all", 1, F.col("dims")))
    return d.select(g, id_, "dims", v.alias("v"))
