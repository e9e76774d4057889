"""Joins of features, labels, clusters, truth and metadata, and the small steps around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Annotations that say that there is nothing to judge.
EXCLUDED = ["No Person", "No Video", "Unknown"]


def labelled(labels: DataFrame, clusters: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Labels with the cluster of their keys (say location and activity); those without a cluster go."""
    return labels.join(clusters.select(*keys, cluster), keys, "left").where(F.col(cluster).isNotNull())


def training_rows(features: DataFrame, labels: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Features and labels of equal windows, without rows whose vector or label is null."""
    return features.where(F.col(vector).isNotNull()).join(labels.where(F.col(label).isNotNull()), key)


def judged(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Truth and predictions of equal keys (session and window); null keys meet nothing."""
    return truth.join(predictions, keys)


def annotated(annotations: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Every annotation, with what is known of its sample."""
    return annotations.join(samples, key, "left")


def mapped_truth(df: DataFrame, keys: list[str], names: str, mapping: DataFrame) -> DataFrame:
    """keys, mapped: the distinct groups of all names of a row, by a table (name, groups array); names without groups and empty groups add nothing.

    A name is taken apart at `;` and ` AND `, so that a compound meets the table by its parts.
    """
    atoms = F.filter(F.transform(F.flatten(F.transform(names, lambda x: F.split(x, r";| AND "))), F.trim), lambda x: x != "")
    each = df.select(*keys, F.explode_outer(F.array_distinct(atoms)).alias("_name"))
    hit = each.join(mapping.toDF("_name", "_groups"), "_name", "left").select(*keys, F.explode_outer("_groups").alias("_g"))
    return hit.groupBy(*keys).agg(F.array_sort(F.collect_set(F.nullif("_g", F.lit("")))).alias("mapped"))


def not_excluded(label: Column) -> Column:
    return label.isNotNull() & ~F.trim(label).isin(EXCLUDED)


def compose_label(number: Column, location: Column, activity: Column) -> Column:
    """id-location::activity."""
    return F.concat_ws("::", F.concat_ws("-", number.cast("string"), location), activity)


def label_number(label: Column) -> Column:
    return F.substring_index(label, "-", 1).try_cast("long")


def label_activity(label: Column) -> Column:
    return F.element_at(F.split(label, "::"), -1)


def map_pairs(df: DataFrame, keys: list[str], lists: str, name: str, value: str) -> DataFrame:
    """A row for every member of every list of a map."""
    return df.select(*keys, F.explode(lists).alias(name, "_l")).select(*keys, name, F.explode("_l").alias(value))


def recording_prefix(name: Column) -> Column:
    """What names a recording in its path: of watch_recording files all but the first and last part of the name, else name, date and time or the number."""
    parts = F.split(F.element_at(F.split(name, "/"), -1), "_")
    inner = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    return F.when(name.contains("watch_recording"), inner).when(F.size(parts) >= 4, F.array_join(F.slice(parts, 2, 3), "_")).otherwise(F.get(parts, F.lit(1)))


def common_range(df: DataFrame, keys: list[str], sensor: str, t: str) -> DataFrame:
    """keys, lo, hi, sensors: where all sensors of a key have readings; nothing where they share no time."""
    per = df.groupBy(*keys, sensor).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    return per.groupBy(*keys).agg(F.max("_a").alias("lo"), F.min("_b").alias("hi"), F.count("*").alias("sensors")).where("lo <= hi")


def shared_windows(df: DataFrame, keys: list[str], sensor: str, t: str, value: str, size: int, slide: int, least: int) -> DataFrame:
    """keys, window_end, low_n, n, mean: windows [end - size, end) hopping from the start of the sensors' common range while they end inside
    it, kept where every sensor has more than `least` rows.

    Sensors aggregate to panes of one slide before anything is shuffled; panes are copied to windows.
    """
    if size % slide:
        raise ValueError("the size must be a multiple of the slide")
    r = common_range(df, keys, sensor, t)
    d = df.join(r, keys).where(F.col(t) >= F.col("lo"))
    panes = d.groupBy(*keys, "lo", "hi", "sensors", sensor, F.floor((F.col(t) - F.col("lo")) / slide).alias("_p")).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    first = F.greatest(F.lit(0).cast("long"), F.col("_p") - (size // slide - 1))
    w = panes.withColumn("_k", F.explode(F.sequence(first, F.col("_p")))).withColumn("window_end", F.col("lo") + F.col("_k") * slide + size).where("window_end <= hi")
    per = w.groupBy(*keys, "sensors", "window_end", sensor).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")).where(F.col("_n") > least)
    out = per.groupBy(*keys, "sensors", "window_end").agg(F.count("*").alias("_c"), F.min("_n").alias("low_n"), F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"))
    return out.where("_c = sensors").select(*keys, "window_end", "low_n", "n", "mean")


def forward_scores(df: DataFrame, keys: list[str], session: str, label: str, model: DataFrame, least: int) -> DataFrame:
    """keys, session, n, correct: each session's model (keys, session, model: one label) judged on the rows of all later sessions of over `least` rows.

    Counts after a session are suffix sums over sessions, so no pair of sessions is ever made.
    """
    c = df.groupBy(*keys, session, label).agg(F.count("*").alias("_c"))
    c = c.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys, session)))
    # a model's label may be missing in its own session, so it gets a row of no readings there
    m = model.select(*keys, session, F.col("model").alias(label))
    both = c.select(*keys, session, label, F.when(F.col("_n") > least, F.col("_c")).otherwise(0).alias("_c"), F.lit(False).alias("_m"))
    both = both.unionByName(m.select("*", F.lit(0).cast("long").alias("_c"), F.lit(True).alias("_m"))).groupBy(*keys, session, label).agg(F.sum("_c").alias("_c"), F.max("_m").alias("_m"))
    after = lambda *by: Window.partitionBy(*by).orderBy(session).rangeBetween(1, Window.unboundedFollowing)
    s = both.withColumn("correct", F.coalesce(F.sum("_c").over(after(*keys, label)), F.lit(0)))
    s = s.withColumn("n", F.coalesce(F.sum("_c").over(after(*keys)), F.lit(0)))
    return s.where("_m and n > 0").select(*keys, session, "n", "correct")


def aligned(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, place, a, b: two series side by side by place, as long as the shorter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    place = lambda d, name: d.select(*keys, F.row_number().over(w).alias("place"), F.col(value).alias(name))
    return place(a, "a").join(place(b, "b"), [*keys, "place"])


def onto_rows(rows: DataFrame, scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Each row with the score of its block; rows of unscored blocks have none."""
    return rows.join(scores.select(*keys, score), keys, "left")


def top_ranked(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def merged_in_time(sources: dict[str, DataFrame], t: str) -> DataFrame:
    """All sources in one, with the name of each row's source; sorted by time where it is written."""
    out = None
    for name, d in sources.items():
        d = d.withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.orderBy(t, "source")
