"""Session builder with the settings the operators assume: UTC and adaptive execution."""

import tempfile

from pyspark.sql import SparkSession


def session(app: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own, any other is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = getattr(spark, "_tideline_folder", None)
    if held is None:
        held = spark._tideline_folder = tempfile.mkdtemp(prefix="tideline-")
    return held
