"""Evaluation of predictions: confusion, accuracy, precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, prediction: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), truth, prediction).agg(F.count("*").alias("n"))


def per_label(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 over the union of labels; 0 where a denominator is 0. One pass over the confusion counts."""
    c = confusion(df, truth, prediction)
    two = F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("t")), F.struct(F.col(prediction).alias("label"), F.lit(False).alias("t")))
    e = c.select("n", (F.col(truth) == F.col(prediction)).alias("hit"), F.inline(two))
    g = e.groupBy("label").agg(
        F.coalesce(F.sum(F.when(F.col("hit") & F.col("t"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & ~F.col("t"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & F.col("t"), F.col("n"))), F.lit(0)).alias("fn"),
    )
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def summary(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """accuracy (= micro precision, recall and F1) and macro averages."""
    return per_label(df, truth, prediction).agg(
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.sum(F.col("tp") + F.col("fn")).alias("n"),
    )
