"""Segments worth describing: cluster members and anomalies, spaced, capped and free of overlap."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import Segments
from tideline.operators.select import hash_sample
from tideline.operators.sequential import fold, spacing


def candidates(clusters: DataFrame, keys: list[str], cfg: Segments) -> DataFrame:
    """Confident members of labels that are neither single nor too large; label -1 is noise."""
    d = clusters.where((F.col("confidence") > cfg.min_confidence) & (F.col("label") != -1))
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "sensor", "label")))
    return d.where((F.col("_n") > 1) & (F.col("_n") < cfg.max_cluster_size)).drop("_n")


def spaced(d: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Of each sensor's rows in order of time, those more than `gap` after the last one kept (lowest label first at equal times)."""
    out, kinds = [*keys, "sensor", "window_end", "label", "id"], dict(d.dtypes)
    return fold(d.select(*out), [*keys, "sensor"], ["window_end", "label", "id"], ["window_end"], spacing(gap), ", ".join(f"{c} {kinds[c]}" for c in out))


def without_overlap(d: DataFrame, keys: list[str], size: int) -> DataFrame:
    """In order of sensor, then time: windows (end - size, end] that overlap none accepted before.

    What is carried are a participant's accepted ends in order, so that each window is held against its two neighbours only.
    """
    out, kinds = [*keys, "sensor", "window_end", "label", "id"], dict(d.dtypes)

    def step(ends: list[int] | None, used: list[np.ndarray]) -> tuple[list[int], list[int]]:
        ends, kept = [] if ends is None else ends, []
        for i, x in enumerate(used[0].tolist()):
            at = bisect_left(ends, x)
            if (at == 0 or x - ends[at - 1] >= size) and (at == len(ends) or ends[at] - x >= size):
                ends.insert(at, x)
                kept.append(i)
        return ends, kept

    return fold(d.select(*out), keys, ["sensor", "window_end", "label", "id"], ["window_end"], step, ", ".join(f"{c} {kinds[c]}" for c in out))


def compile_segments(clusters: DataFrame, keys: list[str], cfg: Segments = Segments(), seed: str = "42") -> DataFrame:
    """keys, sensor, window_end, label, id from clusters (keys, sensor, window_end, label, confidence, id)."""
    d = spaced(candidates(clusters, keys, cfg), keys, cfg.window_us)
    d = hash_sample(d, [*keys, "sensor", "label"], "id", cfg.max_samples, seed)
    return without_overlap(d, keys, cfg.window_us)


def attach_anomalies(segments: DataFrame, anomalies: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, window_end, labels: anomalies (keys, t, name) label the segment that holds them (the earliest), or make one of their own."""
    from tideline.operators.joins import range_join

    s = segments.select(*keys, (F.col("window_end") - size).alias("_s"), F.col("window_end").alias("_e"))
    a = range_join(anomalies, s, keys, "t", "_s", "_e", 2 * size, "left")
    a = a.groupBy(*keys, "t", "name").agg(F.min("_e").alias("_e")).select(*keys, F.coalesce("_e", "t").alias("window_end"), F.col("name").alias("label"))
    both = segments.select(*keys, "window_end", F.col("label").cast("string").alias("label")).unionByName(a)
    return both.groupBy(*keys, "window_end").agg(F.array_sort(F.collect_set("label")).alias("labels"))
