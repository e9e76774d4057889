"""Registration of catalogue queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalar import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: participant = user_id, sensor = event_type, t in microseconds."""
    return read(spark, sf_dir, "events").withColumn("t", micros(F.col("ts")))


def r6(x):
    """Rounded as the oracles round: floating sums differ in their last bits between engines."""
    return F.round(x, 6)


#: The same readings in DuckDB.
EV = "ev AS (SELECT *, epoch_us(ts) AS t FROM events)"
