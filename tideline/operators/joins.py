"""Joins in time: points in intervals, overlaps, bands, as-of, first match, upsert.

Range conditions are planned as equi-joins: intervals are copied to the buckets they cross, points have one bucket, and the
exact condition is checked within. A bucket's width should be near the usual length of an interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, bucket: int, how: str = "inner") -> DataFrame:
    """start <= t < end and equal keys. Columns of both sides but the keys must differ."""
    p = points.withColumn("_b", F.floor(F.col(t) / bucket))
    span = F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))
    i = intervals.where(F.col(start) < F.col(end)).withColumn("_b2", F.explode(span)).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = (F.col("_b") == F.col("_b2")) & (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return p.join(i, on, how).drop("_b", "_b2", *[f"_r_{k}" for k in keys])


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_start: str, a_end: str, b_start: str, b_end: str, bucket: int, closed: bool = False) -> DataFrame:
    """Pairs of intervals that overlap (closed: or touch). A pair is made in the first bucket that both cross, once."""
    cross = lambda s, e: F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))
    x = a.withColumn("_b", F.explode(cross(a_start, a_end)))
    y = b.withColumn("_b2", F.explode(cross(b_start, b_end))).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    less = (lambda p, q: F.col(p) <= F.col(q)) if closed else (lambda p, q: F.col(p) < F.col(q))
    on = (F.col("_b") == F.col("_b2")) & less(a_start, b_end) & less(b_start, a_end)
    on = on & (F.col("_b") == F.floor(F.greatest(a_start, b_start) / bucket))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return x.join(y, on).drop("_b", "_b2", *[f"_r_{k}" for k in keys])


def first_match(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def asof(df: DataFrame, keys: list[str], order: list[str], value: str, where: str, name: str) -> DataFrame:
    """The latest value among rows strictly before each row that satisfy `where`: one sort, no join."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(F.expr(where), F.col(value)), ignorenulls=True).over(w))


def lookup(df: DataFrame, mapping: DataFrame, key: str, to: str, default: str) -> DataFrame:
    """Left join on a mapping (key, value), with a default where it says nothing. Spark broadcasts the mapping by its measured size."""
    m = mapping.toDF("_k", "_v")
    return df.join(m, df[key] == m["_k"], "left").withColumn(to, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def unprocessed(df: DataFrame, results: DataFrame, keys: list[str], failed: str | None = None) -> DataFrame:
    """Rows whose key has no result, or a failed one only."""
    good = results.where(f"not ({failed})") if failed else results
    return df.join(good.select(*keys).distinct(), keys, "left_anti")
