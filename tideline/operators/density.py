"""Online density scoring with a decayed Gaussian mixture, and the choice of anomalies from its scores."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.config import Density


#: What a fitted mixture is made of.
STATE = ("weight", "mean", "cov", "m", "c")


class DecayedMixture:
    """Weights, means and second moments that forget: w <- d w + (1 - d) mean p, and so on for each block of rows.

    The updated covariances are used for scores.
    """

    def __init__(self, components: int = 2, decay: float = 0.9, epsilon: float = 0.01, ridge: float = 1e-3):
        self.k, self.decay, self.epsilon, self.ridge = components, decay, epsilon, ridge

    def fit(self, x: np.ndarray, rounds: int = 25) -> DecayedMixture:
        """Expectation-maximisation from a deterministic start: rows at even ranks of the first coordinate."""
        n, d = x.shape
        order = np.argsort(x[:, 0], kind="stable")
        self.mean = x[order[np.linspace(0, n - 1, 2 * self.k + 1).astype(int)[1::2]]].astype(float)
        self.cov = np.repeat((np.cov(x.T).reshape(d, d) if n > 1 else np.eye(d))[None], self.k, 0) + self.ridge * np.eye(d)
        self.weight = np.full(self.k, 1 / self.k)
        for _ in range(rounds):
            p = self.responsibilities(x)
            w = p.sum(axis=0) + 1e-9
            self.weight, self.mean = w / w.sum(), p.T @ x / w[:, None]
            for j in range(self.k):
                e = x - self.mean[j]
                self.cov[j] = (p[:, j, None] * e).T @ e / w[j] + self.ridge * np.eye(d)
        self.m, self.c = self.mean.copy(), self.cov + np.einsum("ki,kj->kij", self.mean, self.mean)
        self.m, self.c = self.m * self.weight[:, None], self.c * self.weight[:, None, None]
        return self

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            e = x - self.mean[j]
            sign, log = np.linalg.slogdet(self.cov[j])
            out[:, j] = np.log(self.weight[j] + 1e-300) - 0.5 * (log + x.shape[1] * np.log(2 * np.pi) + np.einsum("ni,ij,nj->n", e, np.linalg.inv(self.cov[j]), e))
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = self.log_joint(x)
        top = z.max(axis=1)
        return top + np.log(np.exp(z - top[:, None]).sum(axis=1))

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        z = self.log_joint(x)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def update(self, x: np.ndarray) -> None:
        p = (1 - self.epsilon) * self.responsibilities(x) + self.epsilon / self.k
        d, n = self.decay, len(x)
        self.weight = d * self.weight + (1 - d) * p.sum(axis=0) / n
        self.m = d * self.m + (1 - d) * p.T @ x / n
        self.c = d * self.c + (1 - d) * np.einsum("nk,ni,nj->kij", p, x, x) / n
        self.mean = self.m / self.weight[:, None]
        self.cov = self.c / self.weight[:, None, None] - np.einsum("ki,kj->kij", self.mean, self.mean) + self.ridge * np.eye(x.shape[1])
        self.weight = self.weight / self.weight.sum()


    def to_json(self) -> str:
        """All that a mixture knows, as text."""
        return json.dumps({"k": self.k, "decay": self.decay, "epsilon": self.epsilon, **{n: getattr(self, n).tolist() for n in STATE}})

    @classmethod
    def from_json(cls, text: str) -> DecayedMixture:
        d = json.loads(text)
        m = cls(d["k"], d["decay"], d["epsilon"])
        for n in STATE:
            setattr(m, n, np.array(d[n]))
        return m


def score_series(x: np.ndarray, cfg: Density = Density()) -> pd.DataFrame:
    """Of each full block after the first: start, mean log density before its update, its least likely row and that row's strongest feature."""
    b = cfg.block
    rows = []
    if len(x) < 2 * b:
        return pd.DataFrame(rows, columns=["block", "score", "low_row", "feature"])
    model = DecayedMixture(cfg.components, cfg.decay, cfg.epsilon).fit(x[:b])
    for i in range(b, len(x) - b + 1, b):
        part = x[i : i + b]
        s = model.log_density(part)
        low = int(s.argmin())
        far = np.abs(part[low] - part.mean(axis=0)) / (part.std(axis=0) + 1e-9)
        rows.append((i // b, float(s.mean()), i + low, int(far.argmax())))
        model.update(part)
    return pd.DataFrame(rows, columns=["block", "score", "low_row", "feature"])


def density_scores(df: DataFrame, keys: list[str], order: list[str], vector: str, cfg: Density = Density()) -> DataFrame:
    """keys, block, score, low_row, feature: the series of each key (participant, session, sensor) is scored alone, in order."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = score_series(np.stack(pdf[vector].to_numpy()).astype(float), cfg)
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "block", "score", "low_row", "feature"]]

    return df.select(*keys, *order, vector).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block long, score double, low_row long, feature long")


def fit_densities(df: DataFrame, keys: list[str], order: list[str], vector: str, cfg: Density = Density()) -> DataFrame:
    """keys, model (text): a mixture for each key, fitted on its first block and updated by every full block after it. Write it anywhere to keep it."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values(order)[vector].to_numpy()).astype(float)
        model = DecayedMixture(cfg.components, cfg.decay, cfg.epsilon).fit(x[: cfg.block])
        for i in range(cfg.block, len(x) - cfg.block + 1, cfg.block):
            model.update(x[i : i + cfg.block])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "model": [model.to_json()]})

    return df.select(*keys, *order, vector).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", model string")


def score_only(df: DataFrame, models: DataFrame, keys: list[str], vector: str, name: str = "score") -> DataFrame:
    """df with each row's log density under its key's mixture, which isn't updated; rows of keys without one go."""

    def run(vectors: pd.Series, models: pd.Series) -> pd.Series:
        held, out = {}, np.empty(len(vectors))
        for text, at in models.groupby(models, sort=False).groups.items():
            if text not in held:
                held[text] = DecayedMixture.from_json(text)
            rows = models.index.get_indexer(at)
            out[rows] = held[text].log_density(np.stack(vectors.to_numpy()[rows]).astype(float))
        return pd.Series(out)

    return df.join(models, keys).withColumn(name, F.pandas_udf(run, "double")(F.col(vector), F.col("model"))).drop("model")
