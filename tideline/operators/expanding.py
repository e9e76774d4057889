"""Models of ever more sessions: statistics of one session are merged with those before it, and no row is copied to a later session.

Per key, class and dimension a session is (n, mean, m2), m2 the sum of squares about the mean; prefixes of these are running sums and
the pairwise terms of merged means, so that values far from zero lose nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expanding_classes(df: DataFrame, keys: list[str], session: str, label: str, vector: str) -> DataFrame:
    """keys, session, label, n, mean (array), sd (array, population): at every session each class seen so far, from all rows of it up to then.

    Null labels are left out; null components count as absent in their own dimension. Sessions are those with a row, ordered by their column.
    """
    d = df.where(F.col(label).isNotNull())
    x = d.select(*keys, session, label, F.posexplode(vector).alias("_p", "_x")).withColumn("_x", F.col("_x").cast("double"))
    part = x.groupBy(*keys, session, label, "_p").agg(F.count("_x").alias("_n"), F.avg("_x").alias("_m"), (F.var_pop("_x") * F.count("_x")).alias("_q"))
    rows = d.groupBy(*keys, session, label).agg(F.count("*").alias("_c"))
    seen = rows.groupBy(*keys, label).agg(F.min(session).alias("_first"))
    # sessions in which a class has no row carry its prefix on: a grid of sessions and classes, not of rows
    at = df.select(*keys, session).distinct().join(seen, keys).where(F.col(session) >= F.col("_first")).drop("_first")
    dims = x.select(*keys, label, "_p").distinct()
    grid = at.join(dims, [*keys, label]).join(part, [*keys, session, label, "_p"], "left").join(rows, [*keys, session, label], "left")
    w = Window.partitionBy(*keys, label, "_p").orderBy(session)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    n, m = F.coalesce("_n", F.lit(0).cast("long")), F.coalesce("_m", F.lit(0.0))
    g = grid.withColumns({"_all": F.sum(n).over(upto), "_n0": F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")), "_rows": F.sum(F.coalesce("_c", F.lit(0).cast("long"))).over(upto)})
    first = F.first("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # means as differences from the first session's, so that running sums stay small
    g = g.withColumn("_base", first)
    g = g.withColumns({"_mean": F.col("_base") + F.sum(n * (m - F.col("_base"))).over(upto) / F.nullif("_all", F.lit(0)), "_mean0": F.col("_base") + F.sum(n * (m - F.col("_base"))).over(before) / F.nullif("_n0", F.lit(0))})
    between = F.when((n > 0) & (F.col("_n0") > 0), (m - F.col("_mean0")) ** 2 * F.col("_n0") * n / F.col("_all")).otherwise(0.0)
    g = g.withColumn("_sq", F.sum(F.coalesce("_q", F.lit(0.0)) + between).over(upto))
    stats = F.struct("_p", F.col("_mean").alias("mean"), F.sqrt(F.col("_sq") / F.nullif("_all", F.lit(0))).alias("sd"))
    out = g.groupBy(*keys, session, label).agg(F.max("_rows").alias("n"), F.array_sort(F.collect_list(stats)).alias("_s"))
    return out.select(*keys, session, label, "n", F.col("_s.mean").alias("mean"), F.col("_s.sd").alias("sd"))


def predict_next(df: DataFrame, models: DataFrame, keys: list[str], session: str, id_: str, label: str, vector: str) -> DataFrame:
    """keys, session, id, prediction: each row under the model of all earlier sessions of its keys, by the nearest class mean (of equally near ones the first name).

    Rows of a first session have no model and no row here.
    """
    later = df.select(*keys, session).distinct()
    later = later.withColumn("_model", F.lag(session).over(Window.partitionBy(*keys).orderBy(session))).where("_model is not null")
    m = models.select(*keys, F.col(session).alias("_model"), F.col(label).alias("_label"), "mean")
    gap = F.aggregate(F.zip_with(F.col(vector), "mean", lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda a, v: a + v)
    d = df.join(later, [*keys, session]).join(m, [*keys, "_model"]).select(*keys, session, id_, F.struct(gap.alias("d"), "_label").alias("_x"))
    return d.groupBy(*keys, session, id_).agg(F.min("_x")["_label"].alias("prediction"))
