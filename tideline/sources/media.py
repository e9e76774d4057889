"""Media as tables: file manifests, metadata defaults and clip plans. Decoding is a pluggable step outside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.joins import range_join


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and modification time of all files below a folder; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return d.select("path", "length", "modificationTime")


def usable(files: DataFrame, stamp: Column, least: int = 1000) -> DataFrame:
    """Files of a size worth reading, not hidden, whose name has a time stamp."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where((F.col("length") >= least) & ~name.startswith(".") & stamp.isNotNull())


def with_defaults(meta: DataFrame, fps: float, width: int) -> DataFrame:
    """Frame rate, duration and width with fallbacks: an unknown duration is frames / fps."""
    d = meta.withColumn("fps", F.coalesce(F.when(F.col("fps") > 0, F.col("fps")), F.lit(float(fps))))
    return d.withColumn("duration_s", F.coalesce("duration_s", F.col("frames") / F.col("fps"))).withColumn("width", F.coalesce("width", F.lit(width)))


def clip_plan(clips: DataFrame, videos: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Clips (cs, ce) in the video (vs, ve) that holds their start: offset from its start, length cut at its end."""
    d = range_join(clips, videos, keys, "cs", "vs", "ve", bucket)
    return d.withColumn("offset_s", (F.col("cs") - F.col("vs")) / 1e6).withColumn("length_s", (F.least("ce", "ve") - F.col("cs")) / 1e6)


def renamed(files: DataFrame, folder: str) -> DataFrame:
    """Copy plan (src, dst): recordings routed by sensor name."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    sensor = F.when(name.contains("doppler"), "doppler").when(name.contains("micarray") | name.contains("audio"), "micarray").when(name.contains("flir") | name.contains("thermal"), "flir").otherwise("other")
    return files.select(F.col("path").alias("src"), F.concat_ws("/", F.lit(folder), sensor, F.regexp_replace(name, r"\s+", "_")).alias("dst"))
