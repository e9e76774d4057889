"""Labels: soft labels, votes, set-valued ground truth, similarity, choice of the number of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the composite similarity of two label analyses.
WEIGHTS = {"verb": 0.20, "target": 0.30, "instruments": 0.10, "intent": 0.15, "transfer": 0.15, "workflow": 0.10}


def soft_labels(df: DataFrame, window: list[str], label: str, confidence: str) -> DataFrame:
    """window, label, p: the largest confidence of each label over the sum of a window's; all 0 where that sum is 0."""
    d = df.groupBy(*window, label).agg(F.max(confidence).alias("_c"))
    whole = F.sum("_c").over(Window.partitionBy(*window))
    return d.withColumn("p", F.when(whole == 0, 0.0).otherwise(F.col("_c") / whole)).drop("_c")


def majority_vote(df: DataFrame, keys: list[str], model: list[str], label: str, prob: str) -> DataFrame:
    """keys, prediction, confidence, votes from long (model, label, prob) rows.

    A model votes for its most probable label (first in order at a tie); most votes win, ties go to the first label; the
    confidence is the mean of the winners' probabilities.
    """
    own = df.groupBy(*keys, *model).agg(F.min_by(F.struct(F.col(label).alias("l"), F.col(prob).alias("p")), F.struct(-F.col(prob), F.col(label))).alias("b"))
    n = own.groupBy(*keys, F.col("b.l").alias("prediction")).agg(F.count("*").alias("votes"), F.avg("b.p").alias("confidence"))
    best = n.groupBy(*keys).agg(F.min_by(F.struct("prediction", "confidence", "votes"), F.struct(-F.col("votes"), F.col("prediction"))).alias("b"))
    return best.select(*keys, "b.*")


def mean_vote(df: DataFrame, keys: list[str], label: str, prob: str) -> DataFrame:
    """keys, prediction, confidence: the label of the largest share of all models' probability."""
    d = df.groupBy(*keys, label).agg(F.sum(prob).alias("_s")).withColumn("_p", F.col("_s") / F.sum("_s").over(Window.partitionBy(*keys)))
    best = d.groupBy(*keys).agg(F.min_by(F.struct(F.col(label).alias("prediction"), F.col("_p").alias("confidence")), F.struct(-F.round("_p", 12), F.col(label))).alias("b"))
    return best.select(*keys, "b.*")


def atoms(label: Column) -> Column:
    """Parts of a compound label: divided by AND, semicolon or slash."""
    return F.array_remove(F.array_distinct(F.transform(F.split(label, r"\s+AND\s+|\s*[;/]\s*"), F.trim)), "")


def normalize_truth(truth: Column, mapped: Column, prediction: Column) -> Column:
    """The truth in the space of discovered labels: the prediction if it is among the mapped ones, else the first of them."""
    return F.when(F.size(mapped) == 0, truth).when(F.array_contains(mapped, prediction), prediction).otherwise(F.element_at(mapped, 1))


def composite_similarity(parts: dict[str, Column], generic_verb: Column) -> Column:
    """Weighted similarity of two analyses; a generic verb gives half its weight to the target."""
    w = WEIGHTS
    verb = F.when(generic_verb, w["verb"] / 2).otherwise(w["verb"])
    target = F.when(generic_verb, w["target"] + w["verb"] / 2).otherwise(w["target"])
    return verb * parts["verb"] + target * parts["target"] + sum((w[k] * parts[k] for k in ("instruments", "intent", "transfer", "workflow")), F.lit(0.0))


def mirrored(pairs: DataFrame, a: str, b: str, value: str, diagonal: DataFrame) -> DataFrame:
    """An upper triangle as a full square, with 1 on the diagonal (a frame of the ids)."""
    same = diagonal.toDF(a).select(a, F.col(a).alias(b), F.lit(1.0).alias(value))
    return pairs.select(a, b, value).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), value)).unionByName(same)


def choose_k(scores: DataFrame, keys: list[str], k: str, cohesion: str, balance: str, alpha: float) -> DataFrame:
    """keys, k: the first k with the largest alpha * cohesion + (1 - alpha) * balance, both min-max scaled (0 if constant)."""
    w = Window.partitionBy(*keys)

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi == lo, 0.0).otherwise((F.col(c) - lo) / (hi - lo))

    d = scores.withColumn("score", alpha * scaled(cohesion) + (1 - alpha) * scaled(balance))
    best = d.groupBy(*keys).agg(F.min_by(F.struct(k, "score"), F.struct(-F.round("score", 12), F.col(k))).alias("b"))
    return best.select(*keys, f"b.{k}", "b.score")
