"""Feature store, keyed caches, batch requests and responses, reports. Model files: models.Trained.save and load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Content of a description response.
DESCRIPTION = "location_analysis array<struct<primary_location string, location string, location_name string, action_at_location string, user_movement string, confidence double>>"


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature rows (participant, sensor, ...) as Parquet, laid out so that sensors and participants are pruned; mode 'ignore' keeps what exists."""
    df.write.mode(mode).partitionBy("participant", "sensor").parquet(path)


def read_features(spark: SparkSession, path: str, sensors: list[str] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.where(F.col("sensor").isin(sensors)) if sensors else d


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def batch_files(requests: DataFrame, key: str, body: str, most_bytes: int = 95_000_000, most_rows: int = 100) -> DataFrame:
    """key, line, file: request lines packed into files under a size and a number of rows. Rows are dealt by hash first, so that the running sizes of different groups are summed in different tasks."""
    line = F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.struct(F.col(body).alias("content")).alias("body")))
    d = requests.select(key, line.alias("line")).withColumn("_g", F.pmod(F.xxhash64(key), F.lit(64)))
    w = Window.partitionBy("_g").orderBy(key)
    d = d.withColumns({"_b": F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w) - 1})
    return d.select(key, "line", F.format_string("%02d-%05d-%05d", F.col("_g"), F.floor((F.col("_b") - 1) / most_bytes), F.floor(F.col("_n") / most_rows)).alias("file"))


def lenient_json(text: Column, schema: str) -> Column:
    """JSON in a reply: inside a fenced block, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(braces), schema, {"mode": "PERMISSIVE"})


def read_responses(spark: SparkSession, path: str, schema: str = DESCRIPTION) -> DataFrame:
    """custom_id, parsed: replies of batch files, the last line of an id (by file name, then place); an unreadable reply is null."""
    d = spark.read.schema("custom_id string, response struct<body struct<choices array<struct<message struct<content string>>>>>").json(path)
    d = d.withColumns({"_file": F.input_file_name(), "_line": F.monotonically_increasing_id()})
    d = d.groupBy("custom_id").agg(F.max_by("response", F.struct("_file", "_line")).alias("response"))
    return d.select("custom_id", lenient_json(F.get("response.body.choices", F.lit(0))["message"]["content"], schema).alias("parsed"))


def locations(responses: DataFrame) -> DataFrame:
    """custom_id, rank, location, action, confidence: a row per described place that has a name."""
    d = responses.select("custom_id", F.posexplode("parsed.location_analysis").alias("rank", "a"))
    some = lambda c: F.nullif(c, F.lit(""))
    place = F.coalesce(some(F.col("a.primary_location")), some(F.col("a.location")), some(F.col("a.location_name")))
    return d.select("custom_id", "rank", place.alias("location"), F.coalesce("a.action_at_location", F.lit("")).alias("action"), F.coalesce("a.confidence", F.lit(0.0)).alias("confidence")).where("location is not null")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export_windows(readings: DataFrame, selected: DataFrame, keys: list[str], path: str) -> None:
    """Raw rows of the selected windows only: the semi-join stands before anything that decodes."""
    readings.join(selected, keys, "left_semi").write.mode("overwrite").partitionBy("window_end").parquet(path)
