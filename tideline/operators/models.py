"""Classifiers by name over vector columns, long probabilities, and the constant model."""

from __future__ import annotations

from pyspark.ml import Estimator, classification
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.neighbours import vote


def _weighted(e: Estimator) -> Estimator:
    return e.setWeightCol("_w")


TRAINERS = {
    "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=20)),
    "logistic": lambda: LogisticRegression(maxIter=30),
    "random_forest": lambda: RandomForestClassifier(numTrees=30, maxDepth=8, seed=42),
    "xgboost": lambda: OneVsRest(classifier=GBTClassifier(maxIter=10, seed=42)),
    "balanced_rf": lambda: _weighted(RandomForestClassifier(numTrees=30, maxDepth=8, seed=42)),
    "balanced_bagging": lambda: _weighted(RandomForestClassifier(numTrees=30, maxDepth=12, featureSubsetStrategy="all", subsamplingRate=0.5, seed=42)),
    "easy_ensemble": lambda: OneVsRest(classifier=_weighted(GBTClassifier(maxIter=10, seed=42)), weightCol="_w"),
}


class Trained:
    """A fitted classifier; with one label only it is constant."""

    def __init__(self, labels: list[str], model=None):
        self.labels, self.model = labels, model

    def predict(self, df: DataFrame, keys: list[str], vector: str) -> DataFrame:
        """keys, label, prob: long probabilities. Models without probabilities give 1 to their choice."""
        names = F.array(*[F.lit(x) for x in self.labels])
        if self.model is None:
            return df.select(*keys, F.lit(self.labels[0]).alias("label"), F.lit(1.0).alias("prob"))
        d = self.model.transform(df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
        if "probability" in d.columns:
            p = vector_to_array("probability")
        else:
            p = F.transform(F.sequence(F.lit(0), F.lit(len(self.labels) - 1)), lambda i: (i == F.col("prediction").cast("int")).cast("double"))
        return d.select(*keys, F.inline(F.arrays_zip(names.alias("label"), p.alias("prob"))))

    def save(self, path: str) -> None:
        """Write labels and model below a path of the shared store, over what is there."""
        spark = SparkSession.active()
        kind = f"{type(self.model).__module__}.{type(self.model).__name__}" if self.model is not None else ""
        spark.createDataFrame([(i, x, kind) for i, x in enumerate(self.labels)], "i int, label string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trained:
        rows = spark.read.parquet(f"{path}/labels").orderBy("i").collect()
        module, _, name = rows[0]["kind"].rpartition(".")
        if name and module not in ("pyspark.ml.classification",):
            raise ValueError(f"not a classifier of this library: {rows[0]['kind']}")
        model = getattr(classification, name).load(f"{path}/model") if name else None
        return Trained([r["label"] for r in rows], model)


class Neighbours(Trained):
    """k nearest labelled vectors; fitting is keeping the table of them."""

    def __init__(self, labels: list[str], known: DataFrame, vector: str, label: str, k: int = 5):
        super().__init__(labels)
        self.known, self.vector, self.label, self.k = known, vector, label, k

    def predict(self, df: DataFrame, keys: list[str], vector: str) -> DataFrame:
        """keys, label, prob: the labels among the nearest with their shares; the others have no row."""
        known = self.known.withColumnRenamed(self.vector, vector)
        return vote(df, keys, vector, known, self.label, self.k)

    def save(self, path: str) -> None:
        raise NotImplementedError("nearest neighbours are saved as their table: write known")


def train(df: DataFrame, vector: str, label: str, trainer: str) -> Trained:
    """Fit a trainer by name; classes are numbered in the order of their names and weighted against their size."""
    sizes = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string")).count().collect()}
    if not sizes:
        raise ValueError("nothing is labelled")
    labels = sorted(sizes)
    if len(labels) == 1:
        return Trained(labels)
    if trainer not in TRAINERS and trainer != "knn":
        raise ValueError(f"unknown trainer {trainer}; there are {sorted([*TRAINERS, 'knn'])}")
    if trainer == "knn":
        return Neighbours(labels, df, vector, label)
    n = sum(sizes.values())
    number = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (k, float(i))])
    weight = F.create_map(*[F.lit(x) for k in labels for x in (k, n / (len(labels) * sizes[k]))])
    text = F.col(label).cast("string")
    d = df.where(text.isNotNull()).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), number[text].alias("label"), weight[text].alias("_w"))
    return Trained(labels, TRAINERS[trainer]().fit(d))
