"""Mixing to target weights with soft domain membership.

A softmax classifier, fitted on a bounded sample of the labelled table, gives each document posteriors of its domain. Rates
r >= 0 (expected copies) minimise the squared error of the expected domain token totals, sum r * tokens * posterior,
against their targets, with a pull towards 1. At the minimum a document's rate is the projection on r >= 0 of
1 - posterior . multipliers, with one multiplier for each domain; projected steps move the multipliers along the gradient, scaled by
the curvature of the documents whose rates are not 0. A step needs the totals of the whole corpus, one distributed sum of as
many numbers as pairs of domains, and nothing of a document is ever collected. What is missed is told: a target that no rates reach leaves a residual.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut

TOKENS = re.compile(r"[^\W\d_]+|[^\w\s]+")
#: Documented bounds of the fit: labelled documents fetched (about; never above twice that), and features kept.
SAMPLE, FEATURES = 6000, 2000
EPOCHS, RIDGE = 300, 1e-3
#: Pull towards rate 1, and the share of all tokens to which the gradient of each multiplier is brought down.
PULL, TOLERANCE = 0.02, 1e-7
#: Steps that are looked for; if they don't reach the tolerance, fitting fails and says so.
MOST_STEPS = 60
#: Production weights: share of the corpus's tokens by domain (quality, toxic); domains that aren't named get none.
WEIGHTS = {"q1_t0": 0.9, "q0_t0": 0.1}


class Classifier:
    """Softmax regression on the presence of tokens."""

    def __init__(self, domains: list[str], features: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.features, self.weights, self.bias = domains, features, weights, bias
        self.row = {f: i for i, f in enumerate(features)}

    def __getstate__(self):
        return self.domains, self.features, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def present(self, text: str) -> list[int]:
        """Features of a whole text."""
        return [i for i in map(self.row.get, set(TOKENS.findall(text.lower()))) if i is not None] if text else []

    def posteriors(self, texts: list[str]) -> np.ndarray:
        z = np.tile(self.bias, (len(texts), 1))
        for k, t in enumerate(texts):
            if at := self.present(t):
                z[k] += self.weights[at].sum(axis=0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(samples: Iterable[tuple[str, str]]) -> Classifier | None:
    """(text, domain) pairs -> classifier, None without any. Features are the tokens whose presence differs most, by chi-square, between domains.

    Texts are taken one by one, and of each only the numbers of its tokens are held.
    """
    number: dict[str, int] = {}
    held, of = [], []
    for t, d in samples:
        ts = set(TOKENS.findall((t or "").lower()))
        held.append(np.fromiter((number.setdefault(x, len(number)) for x in ts), np.int32, len(ts)))
        of.append(d)
    if not of:
        return None
    domains = sorted(set(of))
    y = np.array([domains.index(d) for d in of], np.int64)
    seen = np.zeros(len(number), np.int64)
    for ts in held:
        seen[ts] += 1
    common = sorted(t for t, i in number.items() if seen[i] >= 5)
    row = np.full(len(number), -1, np.int32)
    row[[number[t] for t in common]] = np.arange(len(common))
    held = [at[at >= 0] for at in (row[ts] for ts in held)]
    counts = np.zeros((len(common), len(domains)))
    for at, k in zip(held, y):
        counts[at, k] += 1
    sizes = np.bincount(y, minlength=len(domains)).astype(float)
    expected = counts.sum(axis=1, keepdims=True) * sizes / max(sizes.sum(), 1)
    chi = ((counts - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=1)
    best = sorted(np.argsort(-chi, kind="stable")[:FEATURES].tolist())
    best = [i for i in best if chi[i] > 25]
    features = [common[i] for i in best]
    model = Classifier(domains, features, np.zeros((len(features), len(domains))), np.log(sizes / sizes.sum()))
    x = np.zeros((len(held), len(features)))  # as wide as the weights: a product of two widths would copy it in every epoch
    column = np.full(len(common), -1, np.int32)
    column[best] = np.arange(len(best))
    for k, at in enumerate(column[at] for at in held):
        x[k, at[at >= 0]] = 1
    goal = np.eye(len(domains), dtype=np.float32)[y]
    # each feature is scaled by its own curvature, so that rare marks are learned as fast as common ones
    pace = 1 / (x.mean(axis=0, dtype=np.float32)[:, None] * 0.25 * 8 + 1e-3)
    w, b, vw, vb = model.weights, model.bias, 0.0, 0.0
    for _ in range(EPOCHS if features else 0):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        e = p / p.sum(axis=1, keepdims=True) - goal
        vw = 0.9 * vw - 0.1 * pace * (x.T @ e / len(x) + RIDGE * w / 10)
        vb = 0.9 * vb - 0.1 * e.mean(axis=0)
        w, b = w + vw, b + vb
    return Classifier(domains, features, w.astype(np.float64), b.astype(np.float64))


def domain(labels: DataFrame) -> Column:
    return F.format_string("q%d_t%d", labels["quality"], labels["toxic"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Fit on about `sample` labelled documents, chosen by hash; None where there are none.

    Labels with a null in any column are left out; of contradicting labels of a document the largest domain counts.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.select("doc_id", domain(known).alias("domain")).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    n = known.count()
    if not n:
        return None
    share = min(1.0, sample / n)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(share * 1e6)).limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "domain").limit(2 * sample)
    return fit((r["text"], r["domain"]) for r in rows.toLocalIterator())


def rate_of(p: str | Column, multipliers: list[float]) -> Column:
    """The rate of a document by its posteriors."""
    return F.greatest(F.lit(0.0), 1 - sum((F.get(p, F.lit(i)) * float(m) for i, m in enumerate(multipliers)), F.lit(0.0)))


def fit_rates(soft: DataFrame, targets: dict[str, float], domains: list[str], pull: float = PULL) -> tuple[list[float], dict[str, float]]:
    """(tokens, p array) -> multipliers that give rates, and the totals reached. targets: tokens by domain."""
    k = len(domains)
    goal = np.array([targets.get(d, 0.0) for d in domains])

    def look(multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals under these multipliers, and how they bend."""
        r = rate_of("p", multipliers.tolist())
        d = soft.select(F.col("tokens").cast("double").alias("t"), r.alias("r"), *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(k)])
        t, live = F.col("t"), F.when(F.col("r") > 0, F.col("t"))
        got = d.agg(*[F.sum(t * F.col("r") * F.col(f"p{i}")) for i in range(k)], *[F.sum(live * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(i, k)]).first()
        got = [x or 0.0 for x in got]
        bend, rest = np.zeros((k, k)), iter(got[k:])
        for i in range(k):
            for j in range(i, k):
                bend[i, j] = bend[j, i] = next(rest)
        return np.array(got[:k]), bend

    at = np.zeros(k)
    totals, bend = look(at)
    start, n = totals.copy(), max(totals.sum(), 1.0)
    size = np.maximum(start, 1e-6 * n) * pull
    gradient = lambda m, t: t - goal - size * m
    g = gradient(at, totals)
    damping = 0.0
    for _ in range(MOST_STEPS):
        if np.abs(g).max() <= TOLERANCE * n:
            return at.tolist(), dict(zip(domains, totals.tolist()))
        step = np.linalg.solve(bend + np.diag(size) + damping * n * np.eye(k), g)
        there = at + step
        totals_there, bend_there = look(there)
        g_there = gradient(there, totals_there)
        # both are gradients of one concave function: a step is good while the slope along it has not turned too far
        if np.isfinite(g_there).all() and g_there @ step >= -0.5 * (g @ step):
            at, totals, bend, g, damping = there, totals_there, bend_there, g_there, damping / 4 if damping > 1e-6 else 0.0
        else:
            damping = max(4 * damping, 1e-3)
    raise RuntimeError(f"the rates did not settle in {MOST_STEPS} steps; a domain's slope is {np.abs(g).max() / n:.2g} of all tokens")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, relative: bool = False, pull: float = PULL) -> DataFrame:
    """(documents, labels) -> the documents' columns, n_tokens, domain, posterior map, rate, copies, missed map.

    weights: each domain's share of the corpus's tokens, or with `relative` the multiple of its present expected total.
    copies rounds the rate to a whole number by the document's hash, so that expected totals hold. missed: of each domain the expected total
    reached less its target, as a share of all tokens, the same on every row; the classifier gives every domain some of every document, so a
    target of 0 is missed by what the kept documents hold of it. Null and empty texts
    have no tokens, and the classifier's prior as posterior; very long texts are scored whole. Without labelled documents every rate is 1. Repeated rows get equal
    rates and copies. Columns named like a result are replaced, all others are kept whatever they are called; an empty table gives an empty result.
    """
    weights = WEIGHTS if weights is None else weights
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    own = ["n_tokens", "domain", "posterior", "rate", "copies", "missed"]
    kept = [c for c in docs.columns if c not in own]
    text = F.coalesce("text", F.lit(""))
    tokens = F.size(F.array_remove(F.split(text, r"\s+"), "")).cast("long")
    model = train(docs, labels)
    if model is None:
        nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        return docs.select(*kept, tokens.alias("n_tokens"), F.lit(None).cast("string").alias("domain"), nothing.alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), nothing.alias("missed"))
    domains, shared = model.domains, [model]

    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series(list(shared[0].posteriors(texts.tolist())))

    score.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    key = F.coalesce(F.col("_d").cast("string"), F.lit(""))
    soft = cut(docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), tokens.alias("tokens"), F.pandas_udf(score, "array<double>")(text).alias("p")))
    present = [x or 0.0 for x in soft.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(len(domains))]).first()]
    n = sum(present)
    if relative:
        targets = {d: weights.get(d, 0.0) * x for d, x in zip(domains, present)}
    else:
        whole = sum(weights.get(d, 0.0) for d in domains) or 1.0
        targets = {d: weights.get(d, 0.0) / whole * n for d in domains}
    multipliers, reached = fit_rates(soft, targets, domains, pull)
    names = F.array(*[F.lit(d) for d in domains])
    missed = F.map_from_arrays(names, F.array(*[F.lit((reached[d] - targets[d]) / max(n, 1.0)) for d in domains]))
    rated = soft.dropDuplicates(["_d", "_t"]).select("_d", "_t", F.col("tokens").alias("n_tokens"), "p", rate_of("p", multipliers).alias("rate"))
    # a row is carried as one value, so that no name of its columns meets another
    rows = docs.select(F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_h"), F.struct(*kept).alias("_row"))
    out = rows.join(rated, F.expr("_i <=> _d and _h = _t"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), key).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    domain_ = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))
    return out.select("_row", "n_tokens", domain_.alias("domain"), F.map_from_arrays(names, F.col("p")).alias("posterior"), "rate", copies.alias("copies"), missed.alias("missed")).select("_row.*", *own)


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float], relative: bool = False, nearest: bool = False) -> DataFrame:
    """The documents, each as often as its copies say; columns as given, whatever their names. Nulls, empty tables and repeated rows as in mix().

    nearest rounds each rate to the nearest whole number instead of by hash: totals are then met as closely as
    whole documents can, and no document is dropped or doubled by chance.
    """
    m = mix(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), labels, weights, relative)
    copies = F.floor(F.col("rate") + 0.5).cast("int") if nearest else F.col("copies")
    return m.select("_row", copies.alias("_n")).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select("_row.*")
