"""Outside models behind one interface: descriptions, label merging, analyses, embeddings. The rule-based provider needs no network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def describe(self, frames: list[str]) -> list[dict]: ...

    def merge(self, counts: dict[str, int], least: int) -> dict[str, list[str]]: ...

    def match(self, name: str, groups: list[str]) -> str | None: ...

    def embed(self, text: str) -> np.ndarray: ...


class Estimator(Protocol):
    """A neural model of frames: poses (persons of joints x, y, confidence), segments (mask and box of each), depth."""

    def pose(self, frame: np.ndarray) -> list[list[tuple[float, float, float]]]: ...

    def segment(self, frame: np.ndarray) -> list[tuple[np.ndarray, tuple[float, float, float, float, float]]]: ...

    def depth(self, frame: np.ndarray) -> np.ndarray: ...


class Thresholds:
    """Deterministic stand-in: what is brighter than the mean is the person; depth is brightness from 0 to 1."""

    def depth(self, frame: np.ndarray) -> np.ndarray:
        low, high = frame.min(initial=np.inf), frame.max(initial=-np.inf)
        return (frame - low) / (high - low) if high > low else np.zeros(frame.shape)

    def segment(self, frame: np.ndarray) -> list[tuple[np.ndarray, tuple[float, float, float, float, float]]]:
        mask = frame > frame.mean() if frame.size else np.zeros(frame.shape, bool)
        if not mask.any():
            return []
        y, x = np.nonzero(mask)
        return [(mask, (float(x.min()), float(y.min()), float(x.max()), float(y.max()), float(mask.mean())))]

    def pose(self, frame: np.ndarray) -> list[list[tuple[float, float, float]]]:
        found = self.segment(frame)
        if not found:
            return []
        y, x = np.nonzero(found[0][0])
        at = np.linspace(0, len(y) - 1, 17).astype(int)
        return [[(float(x[i]), float(y[i]), 1.0) for i in at]]


def estimate(frames: DataFrame, keys: list[str], frame: str, model: Estimator) -> DataFrame:
    """keys, joints (of the first person; null without one), mask (of all segments), depth of each two-dimensional frame; a null or empty frame has none."""
    kinds = dict(frames.dtypes)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in it:
            joints, masks, depths = [], [], []
            for x in f[frame]:
                a = np.array([np.asarray(r, float) for r in x]) if x is not None and len(x) else None
                people, parts = (model.pose(a), model.segment(a)) if a is not None else ([], [])
                joints.append([{"x": p, "y": q, "conf": c} for p, q, c in people[0]] if people else None)
                masks.append(np.any([m for m, _ in parts], axis=0).astype(int).tolist() if parts else None)
                depths.append(model.depth(a).tolist() if a is not None else None)
            yield f[keys].assign(joints=joints, mask=masks, depth=depths)

    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return frames.select(*keys, frame).mapInPandas(run, named + ", joints array<struct<x: double, y: double, conf: double>>, mask array<array<int>>, depth array<array<double>>")


def words(text: str) -> set[str]:
    return set(re.findall(r"[^\W_]+", text.lower()))


class Rules:
    """Deterministic stand-in: hashed words for embeddings, word overlap for matches, frequency for groups."""

    def __init__(self, dims: int = 64, alike: float = 0.5):
        self.dims, self.alike = dims, alike

    def describe(self, frames: list[str]) -> list[dict]:
        seen = sorted({w for f in frames for w in words(f)}, key=lambda w: hashlib.md5(w.encode()).hexdigest())[:3]
        return [{"primary_location": w, "action_at_location": f"at {w}", "user_movement": "still", "confidence": round(1 / (i + 1), 3)} for i, w in enumerate(seen)]

    def merge(self, counts: dict[str, int], least: int) -> dict[str, list[str]]:
        groups: dict[str, list[str]] = {}
        for name in sorted(counts, key=lambda n: (-counts[n], n)):
            home = self.match(name, list(groups))
            if home is not None:
                groups[home].append(name)
            elif counts[name] >= least:
                groups[name] = [name]
        return groups

    def match(self, name: str, groups: list[str]) -> str | None:
        w = words(name)
        scored = [(len(w & words(g)) / max(1, len(w | words(g))), g) for g in groups]
        best = max(scored, key=lambda s: (s[0], s[1]), default=(0.0, None))
        return best[1] if best[0] >= self.alike else None

    def embed(self, text: str) -> np.ndarray:
        v = np.zeros(self.dims)
        for w in words(text):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % self.dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return v / n if n else v


def analyse(label: str) -> dict:
    """A label's parts: verb, target, instruments, intent."""
    w = re.findall(r"[^\W_]+", label.lower())
    return {"verb": w[0] if w else "", "target": w[-1] if len(w) > 1 else "", "instruments": w[1:-1], "intent": {"category": w[0] if w else "", "goal": ""}}


def humanize(labels: list[str], name: Callable[[str, int], str], tries: int = 10) -> dict[str, str]:
    """A short unique name for each label: collisions are retried, at last 'other'."""
    out: dict[str, str] = {}
    left = sorted(labels)
    for attempt in range(tries):
        again = []
        for x in left:
            n = name(x, attempt)
            if n and n not in out.values():
                out[x] = n
            else:
                again.append(x)
        if not again:
            break
        left = again
    return {**out, **{x: "other" for x in labels if x not in out}}


def match_until_settled(items: list[str], groups: list[str], provider: Provider, batch: int = 100) -> dict[str, str]:
    """Items in batches to groups, again and again while anything new is matched; what is left has no match."""
    found: dict[str, str] = {}
    left = sorted(set(items))
    while left:
        new = {x: g for i in range(0, len(left), batch) for x in left[i : i + batch] if (g := provider.match(x, groups))}
        if not new:
            break
        found |= new
        left = [x for x in left if x not in new]
    return found


def merged_names(counts: DataFrame, name: str, n: str, provider: Provider, least: int, most: int = 100_000) -> DataFrame:
    """name, merged: a vocabulary's names merged by the provider. The vocabulary (names, not rows) is checked to have `most` names at most."""
    spark = counts.sparkSession
    rows = counts.groupBy(name).agg(F.sum(n).alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of over {most} names")
    groups = provider.merge({r[0]: r[1] for r in rows if r[0] is not None}, least)
    return spark.createDataFrame([(x, g) for g in sorted(groups) for x in groups[g]], f"{name} string, merged string")


def merge_within(counts: DataFrame, place: str, name: str, n: str, provider: Provider, least: int) -> DataFrame:
    """place, name, merged: the names of each place (activities of a location) merged among themselves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = provider.merge(dict(zip(pdf[name], (int(x) for x in pdf[n]))), least)
        return pd.DataFrame([(pdf[place].iloc[0], x, g) for g in sorted(groups) for x in groups[g]], columns=[place, name, "merged"])

    summed = counts.where(F.col(name).isNotNull() & F.col(place).isNotNull()).groupBy(place, name).agg(F.sum(n).alias(n))
    return summed.groupBy(place).applyInPandas(run, f"{place} string, {name} string, merged string")


def consolidated(counts: DataFrame, mapping: DataFrame, keys: list[str], name: str, n: str) -> DataFrame:
    """keys, merged, total, names: counts summed under the merged names, with how many names each took in; what isn't mapped keeps its name."""
    d = counts.join(mapping, [*keys, name], "left").withColumn("merged", F.coalesce("merged", name))
    return d.groupBy(*keys, "merged").agg(F.sum(n).alias("total"), F.count_distinct(name).alias("names"))


def distinct_names(df: DataFrame, name: str, most: int = 1000) -> list[str]:
    """The distinct names of a column, for a provider that is shown all of them at once; more than it can be shown are refused, none is left out."""
    rows = df.select(name).where(F.col(name).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct values of {name}")
    return sorted(r[0] for r in rows)


def truth_groups(truth: DataFrame, label: str, groups: list[str], provider: Provider, alike: float = 0.2) -> DataFrame:
    """label, group, reason: the discovered groups that share words with each distinct truth label; a label without any has one row with a null group."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in it:
            rows = []
            for x in f[label]:
                w = words(x or "")
                hit = [(g, w & words(g)) for g in groups if len(w & words(g)) >= alike * max(1, len(w | words(g)))]
                best = provider.match(x or "", groups)
                hit = [*hit, *([(best, w & words(best))] if best is not None and best not in {g for g, _ in hit} else [])]
                rows += [(x, g, " ".join(sorted(s))) for g, s in hit if s] or [(x, None, "")]
            yield pd.DataFrame(rows, columns=[label, "group", "reason"])

    return truth.select(label).distinct().mapInPandas(run, f"{label} string, group string, reason string")


def describe(clips: DataFrame, key: str, frames: str, provider: Provider) -> DataFrame:
    """key, rank, location, action, movement, confidence: up to three descriptions of each clip."""
    kind = dict(clips.dtypes)[key]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in it:
            rows = [(k, i + 1, d["primary_location"], d["action_at_location"], d["user_movement"], float(d["confidence"])) for k, fs in zip(f[key], f[frames]) for i, d in enumerate(provider.describe(list(fs))[:3])]
            yield pd.DataFrame(rows, columns=[key, "rank", "location", "action", "movement", "confidence"])

    return clips.select(key, frames).mapInPandas(run, f"{key} {kind}, rank int, location string, action string, movement string, confidence double")


def embed(df: DataFrame, text: str, provider: Provider) -> DataFrame:
    """Adds embedding; an empty or null text has the zero vector."""
    f = F.pandas_udf(lambda s: pd.Series([provider.embed(t or "").tolist() for t in s]), "array<double>")
    return df.withColumn("embedding", f(text))


def job_status(jobs: DataFrame, done: tuple[str, ...] = ("ended", "completed")) -> DataFrame:
    """Latest status of each job, and whether it is over."""
    d = jobs.groupBy("job").agg(F.max_by("status", F.struct("t", "status")).alias("status"), F.max("t").alias("t"))
    return d.withColumn("over", F.col("status").isin(*done))


def request(custom_id: str, prompt: str) -> str:
    return json.dumps({"custom_id": custom_id, "body": {"messages": [{"role": "user", "content": prompt}]}})
