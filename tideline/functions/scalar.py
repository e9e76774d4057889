"""Column functions: time units, label cleaning, array algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that mean that nothing is known.
SENTINELS = ["", "nan", "no_match", "unknown", "unknown_location", "unknown_activity"]


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def sanitize(label: Column) -> Column:
    return F.translate(label, " -/", "___")


def is_known(label: Column) -> Column:
    return label.isNotNull() & ~F.lower(label).isin(SENTINELS)


def clean_number(x: Column) -> Column:
    """NaN, infinities and nulls as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def session_key(prefix: Column, ordinal: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s-%02d-%s_%s", prefix, ordinal.cast("int"), start.cast("string"), end.cast("string"))


def stamp_in_name(name: Column) -> Column:
    """The first yyyymmdd_hhmmss in a file name, as a zone-less timestamp; null where there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")


def hand_of(path: Column) -> Column:
    """Which hand a recording belongs to, by the first name its path contains; dominant by default."""
    p = F.lower(path)
    return F.when(p.contains("non_dominant") | p.contains("non-dominant") | p.contains("nondominant"), "non_dominant").otherwise("dominant")


def local_shift(ts: Column, from_zone: str, to_zone: str) -> Column:
    """Zone-less local time of one zone as that of another."""
    return F.convert_timezone(F.lit(from_zone), F.lit(to_zone), ts)


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson's correlation of the rows that have both; 0 where either is constant, which the built-in one divides by."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.coalesce(F.nanvl(F.try_divide(F.avg(x * y) - F.avg(x) * F.avg(y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)), F.lit(0.0))
