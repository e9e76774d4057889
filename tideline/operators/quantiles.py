"""Exact quantiles of keys that hold any number of rows: histograms narrow the spans of the wanted ranks, and only small spans are sorted."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.graphs import cut

#: Equal bins between a span's least and greatest value, or between their logarithms where a span covers more than OCTAVES powers of two.
BINS = 4096
OCTAVES = 24
#: Rows of a span that are left to be sorted; a larger one is divided again, unless it holds a single value.
SORTED = 1_000_000
LARGEST = sys.float_info.max


def _half(v: str) -> Column:
    """Half of a value, as a whole range may exceed the largest number; infinities count as the largest numbers."""
    return F.greatest(F.least(F.col(v), F.lit(LARGEST)), F.lit(-LARGEST)) / 2


def _scale(v: str) -> Column:
    """Grows with the value: its sign times its power of two, lifted so that even the smallest numbers lie on their side of 0."""
    h = _half(v)
    return F.when(h == 0, 0.0).otherwise(F.signum(h) * (F.log2(F.abs(h)) + 1080))


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], most_sorted: int = SORTED) -> DataFrame:
    """keys and a column for each quantile, interpolated between the two nearest ranks as percentile() does; nulls and NaN are left out.

    A rank's span is the range of values known to hold it: first all values of the key, then the bin that the rank falls into, with the least
    and greatest value found there. One far outlier, or a heavy tail, thus costs another pass over the rows of the wanted spans, not a bin
    that holds nearly everything; a pass by logarithms and five by values (52 bits, 12 a pass) narrow any span to a single value. Everything shuffled is combined first: bins by span, then distinct values with their counts.
    The spans, two a quantile and key at most, are written to the shared folder in every pass.
    """
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = d.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    # the ranks (from 0) on both sides of each quantile
    wanted = ends.select(*keys, "_lo", "_hi", F.explode(F.array(*[F.struct(F.lit(n).alias("_q"), ((F.col("_n") - 1) * p).alias("_r")) for n, p in at.items()])).alias("_w"), "_n").select(*keys, "_lo", "_hi", "_n", "_w.*")
    wanted = cut(wanted)
    spans = wanted.select(*keys, "_lo", "_hi", F.lit(0).cast("long").alias("_from"), "_n", F.explode(F.array(F.floor("_r"), F.ceil("_r"))).alias("_k")).distinct()
    wide = _half("_hi") - _half("_lo")
    while (spans.agg(F.max(F.when(wide > 0, F.col("_n")))).first()[0] or 0) > most_sorted:
        spans = cut(_narrowed(d, spans, keys, wide))
    # spans of a key don't overlap, so that a span is known by its least value
    values = _within(d, spans, keys).groupBy(*keys, "_lo", "_from", "_v").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*keys, "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("_e", F.col("_from") + F.sum("_c").over(up)).withColumn("_s", F.col("_e") - F.col("_c")).drop("_from")
    ranked = values.join(spans.select(*keys, "_lo", "_k"), [*keys, "_lo"]).where("_k >= _s and _k < _e").select(*keys, "_k", "_v")
    wanted = wanted.select(*keys, "_q", "_r")
    low = wanted.join(ranked.withColumnsRenamed({"_k": "_k0", "_v": "_v0"}), keys).where("_k0 = floor(_r)")
    both = low.join(ranked.withColumnsRenamed({"_k": "_k1", "_v": "_v1"}), keys).where("_k1 = ceil(_r)")
    x = F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise((F.col("_k1") - F.col("_r")) * F.col("_v0") + (F.col("_r") - F.col("_k0")) * F.col("_v1"))
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == n, x)).alias(n) for n in at])


def _within(d: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie in a span, with it."""
    return d.join(spans.select(*keys, "_lo", "_hi", "_from").distinct(), keys).where("_v >= _lo and _v <= _hi")


def _narrowed(d: DataFrame, spans: DataFrame, keys: list[str], wide: Column) -> DataFrame:
    """Each rank with the bin of its span that holds it; the least and the greatest value of a span never share a bin."""
    octaves = _scale("_hi") - _scale("_lo")
    share = F.when(octaves > OCTAVES, (_scale("_v") - _scale("_lo")) / octaves).otherwise((_half("_v") - _half("_lo")) / wide)
    place = F.when(wide > 0, F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int"))).otherwise(0)
    bins = _within(d, spans, keys).groupBy(*keys, F.col("_lo").alias("_of"), "_from", place.alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    up = Window.partitionBy(*keys, "_of").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("_from", F.col("_from") + F.sum("_n").over(up) - F.col("_n"))
    ranks = spans.select(*keys, F.col("_lo").alias("_of"), "_k")
    return bins.join(ranks, [*keys, "_of"]).where("_k >= _from and _k < _from + _n").select(*keys, "_lo", "_hi", "_from", "_n", "_k")
