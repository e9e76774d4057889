"""Names matched by shared words without a list on the driver: inverted indexes of rare words, and rounds over what is still open.

Likeness is shared words over all words of both names (lower-case). Two names of the likeness share one of the first words of each, in an order of all words,
rarest first, so that frequent words make no candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.graphs import cut


def word_set(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def alike_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct left (a) and right (b) names -> a, b, likeness of at least `least` (over 0)."""
    one = cut(left.select("a", F.explode(word_set(F.col("a"))).alias("w")))
    two = cut(right.select("b", F.explode(word_set(F.col("b"))).alias("w")))
    df = one.select("w").unionByName(two.select("w")).groupBy("w").agg(F.count("*").alias("df"))

    def first(d: DataFrame, x: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(x).orderBy("df", "w"))
        d = d.join(df, "w").withColumns({"at": place, "n": F.count("*").over(Window.partitionBy(x))})
        return d.where(F.col("n") - F.col("at") + 1 >= least * F.col("n") - 1e-9).select(x, "w")

    pairs = first(one, "a").join(first(two, "b"), "w").select("a", "b").distinct()
    a, b = word_set(F.col("a")), word_set(F.col("b"))
    both = F.size(F.array_intersect(a, b))
    score = both / (F.size(a) + F.size(b) - both)
    return pairs.select("a", "b", score.alias("likeness")).where(F.col("likeness") >= least)


def match_to_fixpoint(names: DataFrame, groups: DataFrame, least: float = 0.5, grow: bool = False) -> DataFrame:
    """names (name) and groups (group) -> name, group, round: each name's most alike group (of equally alike ones the last in name order); null where none is.

    With grow, names that were matched in one round stand for their group in the next, until a round matches nothing new; only the last round's
    names are searched among those still open. Null names are left out.
    """
    open_ = cut(names.where("name is not null").select("name").distinct())
    found, k = None, 1
    front = cut(groups.where("`group` is not null").select(F.col("group").alias("alias"), "group").distinct())
    while True:
        near = alike_pairs(open_.toDF("a"), front.select(F.col("alias").alias("b")).distinct(), least).join(front, F.col("b") == F.col("alias"))
        best = near.groupBy(F.col("a").alias("name")).agg(F.max(F.struct("likeness", "group"))["group"].alias("group"))
        new = cut(best.withColumn("round", F.lit(k)))
        if new.head() is None:
            break
        found = new if found is None else found.unionByName(new)
        open_ = cut(open_.join(new, "name", "left_anti"))
        if not grow:
            break
        front, k = new.select(F.col("name").alias("alias"), "group"), k + 1
    rest = open_.select("name", F.lit(None).cast("string").alias("group"), F.lit(None).cast("int").alias("round"))
    return rest if found is None else found.unionByName(rest)


def merge_names(counts: DataFrame, least_count: int, least: float = 0.5) -> DataFrame:
    """counts (name, n; one row a name) -> name, merged: from the most frequent name on (then by name) each joins the most alike name that leads a group, or else
    leads one itself if it counts least_count or more; names that do neither have a null.

    A name is settled once all its more frequent alike names are; every round settles all such names at once.
    """
    d = cut(counts.where("name is not null").select("name", "n"))
    p = alike_pairs(d.select(F.col("name").alias("a")), d.select(F.col("name").alias("b")), least).where("a <> b")
    rank = lambda x, n: F.struct((-F.col(n)).alias("n"), F.col(x).alias("name"))
    p = p.join(d.toDF("a", "na"), "a").join(d.toDF("b", "nb"), "b").where(rank("b", "nb") < rank("a", "na"))
    above = cut(p.select(F.col("a").alias("name"), F.col("b").alias("over"), "likeness"))
    open_, done = d, None
    while open_.head() is not None:
        waits = above.join(open_.select(F.col("name").alias("over")), "over", "left_semi").select("name").distinct()
        ready = open_.join(waits, "name", "left_anti")
        lead = F.when(F.col("n") >= least_count, F.col("name"))
        if done is None:
            now = ready.select("name", lead.alias("merged"))
        else:
            heads = done.where("name = merged").select(F.col("name").alias("over"))
            best = above.join(heads, "over").groupBy("name").agg(F.max(F.struct("likeness", "over"))["over"].alias("home"))
            now = ready.join(best, "name", "left").select("name", F.coalesce("home", lead).alias("merged"))
        now = cut(now)
        done = now if done is None else cut(done.unionByName(now))
        open_ = cut(open_.join(now, "name", "left_anti"))
    return done if done is not None else d.select("name", F.lit(None).cast("string").alias("merged"))
