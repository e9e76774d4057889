"""Shared pieces of the training-data operators: row keys, ASCII folding, checkpoints, connected components."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; only where it is unset and the master is local (tests) take a folder of our own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs a reread and no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder as Parquet: for wide rows, which a checkpoint would hold uncompressed."""
    path = f"{shared_folder(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the byte-wise path."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once and written once: elsewhere each use in of copies the whole expression into the plan, and copies in copies multiply."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def pieces(text: Column, separators: str) -> Column:
    """Non-empty pieces of a text between runs of separator characters (a regex character class)."""
    return F.array_remove(F.split(text, separators + "+"), "")


def one_row_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text hash (xxhash64) are in kept (doc_id, th); of rows that repeat both, the smallest by the hash of all columns."""
    taken = docs.select("doc_id", F.xxhash64("text").alias("th"), F.struct(*docs.columns).alias("_row"))
    kept = kept.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    rows = taken.join(kept, F.expr("doc_id <=> _d and th = _t"), "left_semi")
    repeats = docs.groupBy("doc_id", F.xxhash64("text").alias("th")).count().where("count > 1").head() is not None
    if repeats:
        rows = rows.groupBy("doc_id", "th").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return rows.select("_row.*")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of any one orderable type -> (node, label): label is the smallest node of the component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until each component is a star around its smallest node. A step is one
    min-aggregation, which is combined before the shuffle, and one equi-join that Spark may split where a hub is hot; the edges never leave
    the executors. Every round is stored as a table: a checkpoint would carry the estimated size of its joins along, which each round
    raises to the fourth power. Self-loops and null ends are ignored.
    """
    e = stored(edges.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a leaf has one smaller neighbour and no larger one, a centre has larger ones only
        ends = both.groupBy("u").agg(F.count(F.when(F.col("v") < F.col("u"), 1)).alias("smaller"), F.bool_or(F.col("v") > F.col("u")).alias("larger"))
        if not ends.agg(F.bool_or((F.col("smaller") > 1) | ((F.col("smaller") > 0) & F.col("larger")))).first()[0]:
            break
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(small.distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
