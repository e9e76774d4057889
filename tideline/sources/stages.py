"""Stages that keep what they have done: a manifest of input fingerprints by partition, and a commit that the next run reads.

A partition's fingerprint comes from the names, sizes and times of its files, so a run that finds nothing new reads no row. Data are written
before the manifest: a run that breaks off in between does its partitions again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fingerprints(spark: SparkSession, path: str, by: str) -> DataFrame:
    """part (the directory value of partition column `by`), fingerprint, dir: from the file listing alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "modificationTime")
    f = f.withColumn("part", F.regexp_extract("path", rf"/{by}=([^/]+)/", 1)).where("part <> ''")
    files = F.array_sort(F.collect_list(F.struct("path", "length", F.unix_micros("modificationTime").alias("t"))))
    return f.groupBy("part").agg(F.sha2(F.to_json(files), 256).alias("fingerprint"), F.regexp_extract(F.min("path"), rf"^(.*/{by}=[^/]+)/", 1).alias("dir"))


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").head())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """part, fingerprint of every partition as last committed; none before the first run."""
    schema = "part string, fingerprint string, version long"
    if not exists(spark, f"{root}/manifest"):
        return spark.createDataFrame([], schema).drop("version")
    d = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/manifest")
    return d.groupBy("part").agg(F.max_by("fingerprint", "version").alias("fingerprint"))


def run_stage(spark: SparkSession, path: str, schema: str | StructType, by: str, root: str, stage: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    """(the stage's result for all present partitions, the partitions done in this run).

    `path` holds Parquet files in directories by=value with the columns of `schema`; `stage` maps rows with the column `by` (a string) to result rows that keep it, partition by partition alike.
    Only partitions that are new or changed are read. Results of partitions that are gone are left out.
    """
    now = fingerprints(spark, path, by).cache()
    try:
        old = manifest(spark, root).withColumnRenamed("fingerprint", "was")
        todo = now.join(old, "part", "left").where("was is null or was <> fingerprint").select("part", "dir", "fingerprint").collect()
        if todo:
            d = spark.read.schema(schema).option("basePath", path).parquet(*[r.dir for r in todo])
            out = stage(d.withColumn(by, F.col(by).cast("string")))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{root}/data")
            version = time.time_ns()
            done = spark.createDataFrame([(r.part, r.fingerprint, version) for r in todo], "part string, fingerprint string, version long")
            done.coalesce(1).write.parquet(f"{root}/manifest/{version}")
        present = now.select("part").toPandas()["part"].tolist()  # as many as directories, which every reader lists
        d = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
        return d.withColumn(by, F.col(by).cast("string")).where(F.col(by).isin(present)), sorted(r.part for r in todo)
    finally:
        now.unpersist()
