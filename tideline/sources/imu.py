"""Readers of wrist recordings and session files. Schemas are given; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANDROID = "watch_ts bigint, epoch_ts bigint, x double, y double, z double"
ROTATION = ANDROID + ", w double, unnamed string"
IWATCH = ", ".join(f"{c} double" for c in ["ts", *(f"{s}_{a}" for s in ("accel", "gravity", "rot", "mag") for a in "xyz"), "roll", "pitch", "unnamed", "yaw", *(f"quat_{a}" for a in "xyzw"), "local_ts_diff"])


def read_android(spark: SparkSession, path: str, rotation: bool = False) -> DataFrame:
    """Headerless CSV: file, t (microseconds), x, y, z (and w)."""
    d = spark.read.schema(ROTATION if rotation else ANDROID).csv(path)
    return d.select(F.col("_metadata.file_path").alias("file"), (F.col("epoch_ts") * 1000).alias("t"), "x", "y", "z", *(["w"] if rotation else []))


def read_iwatch(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Space-divided, 22 columns: file, t and one part (accel, gravity, rot, mag) as x, y, z; other columns are not parsed."""
    d = spark.read.schema(IWATCH).option("sep", " ").csv(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.round(F.col("ts") * 1e6).cast("bigint").alias("t"), *[F.col(f"{part}_{a}").alias(a) for a in "xyz"])


def session_bounds(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Start and end of each recording: the least and greatest time, whatever the rows' order."""
    return readings.groupBy(*keys).agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"))
