"""Caches of keyed values (replies, embeddings): an append log with merge on read, and compaction into hash buckets.

A version is a directory; the last version of a key wins. Compacted files are clustered by the key, so that a lookup moves only
what is looked up and the log, never the cache.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.stages import exists


class KeyedCache:
    """path/log/<version> and path/base/<version>; key and value columns as given in `schema` (DDL), key first."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        self.key = schema.split()[0]
        self.columns = spark.createDataFrame([], schema).columns

    def _versions(self, kind: str) -> list[int]:
        """Versions that are committed: a record of one row each, written after their data."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        d = self.spark.read.schema("kind string, version long").option("recursiveFileLookup", "true").parquet(f"{self.path}/commits")
        return sorted(r.version for r in d.where(F.col("kind") == kind).collect())

    def _commit(self, kind: str, version: int) -> None:
        self.spark.createDataFrame([(kind, version)], "kind string, version long").coalesce(1).write.parquet(f"{self.path}/commits/{kind}-{version}")

    def append(self, df: DataFrame) -> None:
        """Adds values; of rows that repeat a key one stays, the largest by its values. Null keys are left out."""
        one = df.select(*self.columns).where(F.col(self.key).isNotNull())
        rest = [c for c in self.columns if c != self.key]
        one = one.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("_x")).select(self.key, "_x.*")
        now = time.time_ns()
        one.write.parquet(f"{self.path}/log/{now}")
        self._commit("log", now)

    def base(self) -> DataFrame | None:
        """The compacted part, known to the session as a table in hash buckets."""
        done = self._versions("base")
        if not done:
            return None
        name = "cache_" + hashlib.md5(f"{self.path}/{done[-1]}".encode()).hexdigest()
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.schema}) USING parquet CLUSTERED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/base/{done[-1]}'")
        return self.spark.table(name)

    def log(self) -> DataFrame | None:
        """Key and values of what was appended since the last compaction, the last version of a key."""
        base = self._versions("base")
        new = [v for v in self._versions("log") if not base or v > base[-1]]
        if not new:
            return None
        rest = [c for c in self.columns if c != self.key]
        d = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/log/{v}" for v in new]).withColumn("_v", F.regexp_extract(F.input_file_name(), r"/log/(\d+)/", 1).cast("long"))
        return d.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_v").alias("_x")).select(self.key, "_x.*")

    def rows(self) -> DataFrame:
        """All keys with their last values."""
        base, log = self.base(), self.log()
        if base is None or log is None:
            return base if log is None and base is not None else log if log is not None else self.spark.createDataFrame([], self.schema)
        return base.join(log.select(self.key), self.key, "left_anti").unionByName(log)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of wanted with the value columns (null where the key has none) and `hit`."""
        rest = [c for c in self.columns if c != self.key]
        base, log, d = self.base(), self.log(), wanted
        for name, part in (("_b", base), ("_l", log)):
            part = part if part is not None else self.spark.createDataFrame([], self.schema)
            d = d.join(part.select(self.key, F.struct(*rest).alias(name)), self.key, "left")
        x = F.coalesce("_l", "_b")
        return d.select(*wanted.columns, *[x[c].alias(c) for c in rest], x.isNotNull().alias("hit"))

    def misses(self, wanted: DataFrame) -> DataFrame:
        """The distinct keys of wanted that have no value."""
        d = wanted.select(self.key).distinct()
        for part in (self.base(), self.log()):
            if part is not None:
                d = d.join(part.select(self.key), self.key, "left_anti")
        return d

    def compact(self) -> None:
        """Writes all keys in hash buckets; versions before stay for readers that have them open. A compaction that breaks off is not seen by readers."""
        now = time.time_ns()
        name = f"compacting_{now}"
        d = self.rows().repartition(self.buckets, self.key)
        d.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/base/{now}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files are outside the catalog and stay
        self._commit("base", now)
