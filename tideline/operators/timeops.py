"""Event-time operators on microsecond columns: windows, sessions, gaps, grids, differences.

Hopping windows are built from panes: readings are aggregated once per slide, and only panes are copied to the windows
they lie in, so that the shuffle and the copies do not grow with size / slide times the readings.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.sequential import fold


def hop_ends(t: Column, size: int, slide: int, anchor: Column | None = None) -> Column:
    """Ends of the windows [end - size, end) that hold t; ends lie at anchor + size + i * slide (i >= 0 with an anchor)."""
    base = t - anchor if anchor is not None else t
    if anchor is None:
        low = F.floor(base / slide) + 1
        return F.transform(F.sequence(low, F.floor((base + size) / slide)), lambda k: k.cast("long") * slide)
    last = F.floor(base / slide)
    first = F.greatest(F.lit(0).cast("long"), F.floor((base - size) / slide) + 1)
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: anchor + k.cast("long") * slide + size))


def hop_stats(df: DataFrame, keys: list[str], t: str, value: str, size: int, slide: int, anchor: str | None = None) -> DataFrame:
    """keys, window_end, n, mean, sd (population), low, high, total of every non-empty hopping window.

    The size is a multiple of the slide; every aggregate is merged from panes of one slide.
    """
    if size % slide:
        raise ValueError("the size must be a multiple of the slide")
    base = F.col(t) - F.col(anchor) if anchor else F.col(t)
    also = [anchor] if anchor else []
    v = F.col(value)
    panes = df.groupBy(*keys, *also, F.floor(base / slide).alias("_pane")).agg(
        F.count(v).alias("n"), F.sum(v).alias("_s"), (F.var_pop(v) * F.count(v)).alias("_m2"), F.min(v).alias("low"), F.max(v).alias("high")
    )
    per = size // slide
    first = F.greatest(F.col("_pane") - (per - 1), F.lit(0).cast("long")) if anchor else F.col("_pane") - (per - 1)
    copies = panes.withColumn("_k", F.explode(F.sequence(first, F.col("_pane"))))
    start = F.col("_k") * slide + (F.col(anchor) if anchor else F.lit(0))
    # a window's few panes (size / slide at most), whose second moments are merged about their own means: sums of squares would cancel
    part = F.when(F.col("n") > 0, F.struct(F.col("_pane"), F.col("n").cast("double").alias("n"), (F.col("_s") / F.col("n")).alias("mean"), F.col("_m2").alias("m2")))
    out = copies.groupBy(*keys, (start + size).cast("long").alias("window_end")).agg(
        F.sum("n").alias("n"), F.sum("_s").alias("total"), F.array_sort(F.collect_list(part)).alias("_parts"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    sd = F.when(F.col("n") > 0, F.sqrt(merged_moment("_parts") / F.col("n")))
    return out.select(*keys, "window_end", "n", (F.col("total") / F.nullif("n", F.lit(0))).alias("mean"), sd.alias("sd"), "low", "high", "total")


def merged_moment(parts: str) -> Column:
    """Array of (n, mean, m2) -> the sum of squared deviations of all their rows about the common mean (Chan, Golub and LeVeque)."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, x: Column) -> Column:
        n, far = a["n"] + x["n"], x["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + far * x["n"] / n).alias("mean"), (a["m2"] + x["m2"] + far * far * a["n"] * x["n"] / n).alias("m2"))

    return F.aggregate(parts, zero, merge, lambda a: a["m2"])


def ordered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def tumbling_blocks(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Adds block: rows of a key in runs of n (the last may be short)."""
    return ordered(df, keys, order, "_rn").withColumn("block", F.floor((F.col("_rn") - 1) / n).cast("long")).drop("_rn")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, also: list[str] | None = None) -> DataFrame:
    """keys, session (1..), start, end, n: unions of intervals that touch or overlap, or lie within `gap` of each other."""
    w = Window.partitionBy(*keys).orderBy(start, end, *(also or []))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    d = df.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "session").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def sessionize(df: DataFrame, keys: list[str], t: str, gap: int, also: list[str]) -> DataFrame:
    """Adds session (1..): a new one begins where the pause exceeds the gap."""
    w = Window.partitionBy(*keys).orderBy(t, *also)
    fresh = F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def gap_plan(clips: DataFrame, keys: list[str], start: str, end: str, least: int, lo: str, hi: str) -> DataFrame:
    """keys, kind (clip or gap), start, end: clips cut to [lo, hi) and what they leave open for longer than `least`.

    Clips are sorted by start; a clip that overlaps what came before it begins where that ends.
    """
    c = clips.withColumn("s", F.greatest(start, lo)).withColumn("e", F.least(end, hi)).where("s < e")
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(lo))
    c = c.withColumn("before", reach).withColumn("last", F.lead("s").over(w).isNull())
    final = F.greatest("before", "e")
    clip = c.select(*keys, F.lit("clip").alias("kind"), F.greatest("s", "before").alias("start"), F.col("e").alias("end")).where("start < end")
    gap = c.select(*keys, F.lit("gap").alias("kind"), F.col("before").alias("start"), F.col("s").alias("end")).where(F.col("end") - F.col("start") > least)
    tail = c.where("last").select(*keys, F.lit("gap").alias("kind"), final.alias("start"), F.col(hi).alias("end")).where(F.col("end") - F.col("start") > least)
    return clip.unionByName(gap).unionByName(tail)


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def grid(bounds: DataFrame, lo: str, hi: str, step: int, name: str) -> DataFrame:
    """A row for every lo + i * step up to hi."""
    n = F.floor((F.col(hi) - F.col(lo)) / step)
    return bounds.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn(name, F.col(lo) + F.col("_i") * step).drop("_i")


def interpolate(df: DataFrame, keys: list[str], t: str, value: str, name: str, edge: str = "hold_trailing") -> DataFrame:
    """Linear interpolation of null values along t. Trailing nulls hold the last value; leading ones stay null, or with edge='clamp' take the first."""
    if edge not in ("hold_trailing", "clamp"):
        raise ValueError(edge)
    w = Window.partitionBy(*keys).orderBy(t)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(t))
    d = df.withColumns({
        "_v0": F.last(value, ignorenulls=True).over(back), "_t0": F.last(at, ignorenulls=True).over(back),
        "_v1": F.first(value, ignorenulls=True).over(ahead), "_t1": F.first(at, ignorenulls=True).over(ahead),
    })
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(t) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    lead = F.col("_v1") if edge == "clamp" else F.lit(None).cast("double")
    out = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_v0").isNull(), lead).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(line)
    return d.withColumn(name, out).drop("_v0", "_t0", "_v1", "_t1")


def runs(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """keys, state, run, length: maximal runs of equal states."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    d = df.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, state, "run").agg(F.count("*").alias("length"))


def segments(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Adds segment: n segments of floor(rows / n) rows (one at least); what is left over makes further ones."""
    d = ordered(df, keys, order, "_rn").withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    return d.withColumn("segment", F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn", "_n")


def back_project(df: DataFrame, keys: list[str], end: str, label: str, slide: int, steps: int) -> DataFrame:
    """keys, window_end, label: each label at the `steps` slides before its own end (not at it); the latest end wins, then the largest label."""
    d = df.select(*keys, F.col(end).alias("_e"), label, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_i"))
    d = d.withColumn("window_end", F.col("_e") - F.col("_i") * slide)
    return d.groupBy(*keys, "window_end").agg(F.max_by(label, F.struct("_e", label)).alias(label))


def decayed_mean(df: DataFrame, keys: list[str], order: list[str], value: str, decay: float, name: str) -> DataFrame:
    """The exponentially decayed mean after all rows of a key, in order; its rows are streamed, and only the mean is carried."""
    kinds = dict(df.dtypes)

    def step(mean: float | None, used: list[np.ndarray]) -> tuple[float, list[int]]:
        for x in used[0].tolist():
            mean = x if mean is None else decay * mean + (1 - decay) * x
        return mean, []

    return fold(df.select(*keys, *order, value), keys, order, [value], step, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {name} double", name)


def frame_times(df: DataFrame, start: str, end: str, n: str) -> DataFrame:
    """A row per frame: n frames evenly spaced from start up to end."""
    d = df.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    return d.withColumn("frame_t", F.expr(f"{start} + (frame * ({end} - {start})) div greatest(1, {n})"))


def wrapped_turn(a: Column) -> Column:
    """An angle difference in radians, to [0, pi]."""
    d = F.abs(a) % (2 * math.pi)
    return F.least(d, 2 * math.pi - d)
