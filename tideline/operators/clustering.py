"""Clustering: composite quality, k-means with a choice of k, and linkage of small groups. Density clusters are in density_tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality(df: DataFrame, id_: str, label: str, confidence: str, vector: str, most_noise: float = 0.3) -> DataFrame:
    """k, quality: .3 number + .2 sizes + .2 tightness + .2 noise + .1 confidence; label -1 is noise."""
    named = df.where(F.col(label) != -1)
    x = named.select(id_, label, F.posexplode(vector).alias("_p", "_v")).withColumn("_v", F.col("_v").cast("double"))
    c = x.groupBy(label, "_p").agg(F.avg("_v").alias("_m"))
    far = x.join(c, [label, "_p"]).groupBy(id_, label).agg(F.sqrt(F.sum((F.col("_v") - F.col("_m")) ** 2)).alias("_d"))
    groups = far.groupBy(label).agg(F.count("*").alias("n"), F.avg("_d").alias("d"))
    g = groups.agg(F.count("*").alias("k"), F.avg(F.when(F.col("n") < 5, 0.0).otherwise(F.least(F.lit(1.0), F.col("n") / 10))).alias("size"), F.avg(F.exp(-F.col("d"))).alias("tight"))
    z = df.agg((F.count_if(F.col(label) == -1) / F.count("*")).alias("noise"), F.avg(F.when(F.col(label) != -1, F.col(confidence))).alias("sure"))
    k = F.col("k")
    number = F.when(k < 5, k / 5).when(k > 40, 1 - (k - 40) / 40).otherwise(1.0)
    calm = F.when(F.col("noise") <= most_noise, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("noise") - most_noise) / 0.2))
    return g.join(F.broadcast(z)).withColumn("quality", 0.3 * number + 0.2 * F.col("size") + 0.2 * F.col("tight") + 0.2 * calm + 0.1 * F.col("sure"))


def composite(df: DataFrame, id_: str, label: str, vector: str) -> DataFrame:
    """silhouette, calinski_harabasz, davies_bouldin, score: .6 silhouette + .2 CH / 1000 - .2 DB / 10 of numbered clusters, one row.

    Only tables of one row for each cluster and dimension meet each other; points meet their own centroid alone.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    d = df.select(id_, F.col(label).cast("double").alias("_l"), vector)
    shape = ClusteringEvaluator(featuresCol="_f", predictionCol="_l").evaluate(d.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    x = d.select(id_, "_l", F.posexplode(vector).alias("_p", "_v")).withColumn("_v", F.col("_v").cast("double"))
    c = x.groupBy("_l", "_p").agg(F.avg("_v").alias("_m"), F.count("*").alias("_n"))
    own = x.join(c, ["_l", "_p"]).groupBy(id_, "_l").agg(F.sum((F.col("_v") - F.col("_m")) ** 2).alias("_q"))
    spread = own.groupBy("_l").agg(F.avg(F.sqrt("_q")).alias("_s"), F.sum("_q").alias("_q"), F.count("*").alias("_n"))
    middle = c.groupBy("_p").agg((F.sum(F.col("_m") * F.col("_n")) / F.sum("_n")).alias("_g"))
    between = c.join(middle, "_p").agg(F.sum(F.col("_n") * (F.col("_m") - F.col("_g")) ** 2).alias("_b"))
    near = c.select("_p", F.col("_l").alias("_i"), F.col("_m").alias("_a")).join(c.select("_p", F.col("_l").alias("_j"), F.col("_m").alias("_z")), "_p").where("_i <> _j")
    near = near.groupBy("_i", "_j").agg(F.sqrt(F.sum((F.col("_a") - F.col("_z")) ** 2)).alias("_d"))
    one, two = spread.select(F.col("_l").alias("_i"), F.col("_s").alias("_si")), spread.select(F.col("_l").alias("_j"), F.col("_s").alias("_sj"))
    worst = near.join(one, "_i").join(two, "_j").groupBy("_i").agg(F.max((F.col("_si") + F.col("_sj")) / F.col("_d")).alias("_r")).agg(F.avg("_r").alias("davies_bouldin"))
    sizes = spread.agg(F.sum("_q").alias("_w"), F.sum("_n").alias("_n"), F.count("*").alias("_k"))
    # three tables of one row each
    d = sizes.withColumn("_1", F.lit(1)).join(between.withColumn("_1", F.lit(1)), "_1").join(worst.withColumn("_1", F.lit(1)), "_1")
    ch = (F.col("_b") / (F.col("_k") - 1)) / (F.col("_w") / (F.col("_n") - F.col("_k")))
    d = d.select(F.lit(shape).alias("silhouette"), ch.alias("calinski_harabasz"), "davies_bouldin")
    return d.withColumn("score", F.expr("0.6 * silhouette + 0.2 * calinski_harabasz / 1000 - 0.2 * davies_bouldin / 10"))


def kmeans_search(df: DataFrame, id_: str, vector: str, dims: list[int], ks: list[int], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows with the cluster of the best composite, the composite of every size of PCA and k; size 0 is no PCA)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    tried, table = {}, None
    for n in dims:
        e = (PCA(k=n, inputCol="_f", outputCol="_g").fit(d).transform(d) if n else d.withColumn("_g", F.col("_f"))).withColumn("_a", vector_to_array("_g"))
        for k in ks:
            got = KMeans(k=k, seed=seed, featuresCol="_g", predictionCol="cluster").fit(e).transform(e)
            row = composite(got, id_, "cluster", "_a").first()
            tried[n, k] = (row["score"], got.drop("_f", "_g", "_a"))
            one = df.sparkSession.createDataFrame([(n, k, *[row[c] for c in ("silhouette", "calinski_harabasz", "davies_bouldin", "score")])], "dims int, k int, silhouette double, calinski_harabasz double, davies_bouldin double, score double")
            table = one if table is None else table.unionByName(one)
    best = max(tried, key=lambda t: (tried[t][0], -t[1], -t[0]))
    return tried[best][1], table


def kmeans(df: DataFrame, vector: str, ks: list[int], seed: int = 42, dims: int | None = None) -> tuple[DataFrame, dict[int, float]]:
    """(with column cluster for the k of the best silhouette, silhouettes by k), after an optional PCA."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    if dims:
        d = PCA(k=dims, inputCol="_f", outputCol="_g").fit(d).transform(d).drop("_f").withColumnRenamed("_g", "_f")
    d = d.cache()
    try:
        scores, models = {}, {}
        for k in ks:
            models[k] = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(d)
            scores[k] = ClusteringEvaluator(featuresCol="_f", predictionCol="cluster").evaluate(models[k].transform(d))
        best = max(ks, key=lambda k: (scores[k], -k))
        return models[best].transform(d).drop("_f"), scores
    finally:
        d.unpersist()


def merge_heights(d: np.ndarray, method: str = "average") -> list[tuple[float, int, int]]:
    """Agglomerative merges (height, and a member of each side) of a distance matrix, lowest first, by chains of nearest neighbours: each merge
    joins two groups that are each other's nearest, so no step looks at more than one row, and the whole takes the square of the items."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, chain, out = np.ones(n), np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            row[i] = np.inf
            j = int(row.argmin())
            # of equally near groups the one before in the chain, or the chain would not end
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        h, ni, nj = d[i, j], size[i], size[j]
        if method == "average":
            new = (ni * d[i] + nj * d[j]) / (ni + nj)
        elif method == "ward":
            new = np.sqrt(np.maximum((ni + size) * d[i] ** 2 + (nj + size) * d[j] ** 2 - size * h**2, 0) / (ni + nj + size))
        else:
            new = np.minimum(d[i], d[j])
        i, j = min(i, j), max(i, j)
        alive[j], size[i] = False, ni + nj
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        out.append((float(h), i, j))
    return sorted(out, key=lambda m: m[0])


def linkage(sim: np.ndarray, method: str = "average", k: int | None = None, least: float | None = None) -> np.ndarray:
    """Groups of a similarity matrix of labels, down to k groups or while groups are at least `least` alike; numbered by their first member. Ward works on distances 1 - sim."""
    n = len(sim)
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for done, (h, i, j) in enumerate(merge_heights(1 - sim, method)):
        if n - done <= (k or 1) or (least is not None and h > 1 - least + 1e-12):
            break
        i, j = sorted((find(i), find(j)))
        up[j] = i
    first = [find(i) for i in range(n)]
    return np.array([sorted(set(first)).index(f) for f in first], int)


def linked_groups(sims: DataFrame, place: str, method: str = "ward", k: int | None = None, least: float | None = None, alpha: float = 0.5) -> DataFrame:
    """(place, a, b, sim, n) for every ordered pair of a place's labels (n: how often a is counted) -> place, label, cluster, k, quality.

    With neither k nor least, the k from 2 to half the labels of the best alpha * cohesion + (1 - alpha) * balance is taken: cohesion is the mean similarity within clusters, balance 1 / (1 +
    variation of their counts). A place's labels are a vocabulary, and its square fits a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]))
        at = {x: i for i, x in enumerate(names)}
        sim, n = np.eye(len(names)), np.zeros(len(names))
        i = pdf["a"].map(at).to_numpy()
        sim[i, pdf["b"].map(at).to_numpy()] = pdf["sim"]
        n[i] = pdf["n"]

        def quality(c: np.ndarray) -> float:
            inside, sums = [], []
            for x in range(c.max() + 1):
                m = np.flatnonzero(c == x)
                inside.append(sim[np.ix_(m, m)][np.triu_indices(len(m), 1)].mean() if len(m) > 1 else 1.0)
                sums.append(n[m].sum())
            return alpha * float(np.mean(inside)) + (1 - alpha) / (1 + float(np.std(sums) / np.mean(sums)) if np.mean(sums) else 1)

        if k is None and least is None:
            tried = [linkage(sim, method, q) for q in range(2, max(3, len(names) // 2 + 1))] if len(names) > 2 else [np.zeros(len(names), int)]
            c = max(tried, key=quality)
        else:
            c = linkage(sim, method, k, least)
        return pd.DataFrame({place: pdf[place].iloc[0], "label": names, "cluster": c.astype("int32"), "k": np.int32(c.max() + 1), "quality": quality(c)})

    kind = dict(sims.dtypes)
    return sims.groupBy(place).applyInPandas(run, f"{place} {kind[place]}, label {kind['a']}, cluster int, k int, quality double")
