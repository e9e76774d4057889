"""Chunked text logs: records end with ` ||`, fields are divided by ` | `, the payload is base64. Payloads are never unpickled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def until_first_bad(df: DataFrame, keys: list[str], order: str, bad: str) -> DataFrame:
    """Rows of a file up to, and without, its first malformed record."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_broken", F.max(F.col(bad).cast("int")).over(w)).where("_broken = 0").drop("_broken", bad)


def read_chunk_log(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, ts_ns, payload (binary) of all well-formed records before each file's first malformed one."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r" \|\|", -1)).alias("pos", "record"))
    d = d.withColumn("record", F.trim(F.regexp_replace("record", r"^\s+", ""))).where("record <> ''")
    parts = F.split("record", r" \| ")
    d = d.select("file", "pos", parts.getItem(0).try_cast("bigint").alias("ts_ns"), F.expr("try_to_binary(get(split(record, ' \\\\| '), 1), 'base64')").alias("payload"), F.size(parts).alias("_n"))
    d = d.withColumn("bad", F.col("ts_ns").isNull() | F.col("payload").isNull() | (F.col("_n") != 2)).drop("_n")
    return until_first_bad(d, ["file"], "pos", "bad")
