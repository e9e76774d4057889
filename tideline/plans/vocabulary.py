"""Catalogue: names matched and merged, label groups, and table functions."""

from pyspark.sql import functions as F

from tideline.config import DAY, HOUR
from tideline.functions import tables
from tideline.operators import clustering, matching
from tideline.plans.registry import EV, events, query, r6, read

NAMES = "nm AS (SELECT p_name || ' ' || lower(p_type) AS name, count(*) AS n FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL GROUP BY 1), wd AS (SELECT name, n, list_distinct(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+')) AS w FROM nm)"


def names(spark, sf):
    return read(spark, sf, "part").where("p_name is not null and p_type is not null").groupBy(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")).agg(F.count("*").alias("n"))


@query(f"""WITH {NAMES}, g AS (SELECT name AS g, w AS gw FROM wd WHERE name LIKE '%widget%'), s AS (SELECT name, g, len(list_intersect(w, gw)) / (len(w) + len(gw) - len(list_intersect(w, gw))) AS s FROM wd, g)
 SELECT wd.name, (SELECT g FROM s WHERE s.name = wd.name AND s.s >= 0.5 ORDER BY s.s DESC, g DESC LIMIT 1) AS "group" FROM wd""")
def matched_names(spark, sf):
    """Every name's most alike of the names with a widget."""
    n = names(spark, sf)
    return matching.match_to_fixpoint(n, n.where("name like '%widget%'").select(F.col("name").alias("group"))).select("name", "group")


@query()
def grown_matches(spark, sf):
    """Names that reach one of the widgets of one type through names that are alike, and in which round."""
    n = names(spark, sf)
    return matching.match_to_fixpoint(n, n.where("name like '%widget economy'").select(F.col("name").alias("group")), grow=True)


@query()
def merged_names(spark, sf):
    """Names merged into more frequent alike ones, from the most frequent on."""
    return matching.merge_names(names(spark, sf), 2)


@query()
def label_linkage(spark, sf):
    """Classes grouped by the cosine of their centroids: Ward linkage, and the number of groups of the best cohesion and balance."""
    d = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    c = d.groupBy("label", "p").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    norm = c.groupBy("label").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    c = c.join(norm, "label").withColumn("x", F.col("x") / F.col("norm"))
    sims = c.select(F.col("label").alias("a"), "p", "x", "n").join(c.select(F.col("label").alias("b"), "p", F.col("x").alias("y")), "p")
    sims = sims.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sim"), F.max("n").alias("n")).withColumn("place", F.lit("all"))
    return clustering.linked_groups(sims, "place").select("label", "cluster", "k", r6("quality").alias("quality"))


@query(f"WITH {EV} SELECT user_id, e AS window_end, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM (SELECT *, unnest(generate_series((t // 21600000000 + 1) * 21600000000, (t // 21600000000 + 4) * 21600000000, 21600000000)) AS e FROM ev) GROUP BY 1, 2 HAVING count(value) > 0")
def sql_hop_features(spark, sf):
    """Windows by the table function, in SQL."""
    tables.register(spark)
    d = events(spark, sf).select("user_id", "t", "value")
    sql = f"SELECT user_id, window_end, n, round(mean, 6) AS mean, low, high FROM hop_features(TABLE(SELECT * FROM {{d}}) PARTITION BY user_id ORDER BY t, key => 'user_id', time => 't', value => 'value', size => {DAY}L, slide => {6 * HOUR}L)"
    return spark.sql(sql, d=d)


@query(f"""WITH RECURSIVE {EV}, n AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev WHERE value IS NOT NULL),
 p AS (SELECT user_id, rn, event_id, v AS mean, 0::DOUBLE AS var, NULL::DOUBLE AS score FROM n WHERE rn = 1 UNION ALL SELECT n.user_id, n.rn, n.event_id, mean + (1 - 0.9::DOUBLE) * (v - mean), 0.9::DOUBLE * (var + (1 - 0.9::DOUBLE) * (v - mean) * (v - mean)), CASE WHEN var > 0 THEN abs(v - mean) / sqrt(var) ELSE 0 END FROM p JOIN n ON n.user_id = p.user_id AND n.rn = p.rn + 1)
 SELECT user_id, event_id, round(score, 6) AS score FROM p""")
def sql_decayed_scores(spark, sf):
    tables.register(spark)
    d = events(spark, sf).select("user_id", "t", "event_id", "value")
    return spark.sql("SELECT user_id, event_id, round(score, 6) AS score FROM decayed_scores(TABLE(SELECT * FROM {d}) PARTITION BY user_id ORDER BY (t, event_id), key => 'user_id', id => 'event_id', value => 'value', decay => 0.9D)", d=d)


@query(f"WITH {EV} SELECT event_type, user_id, t // 86400000000 AS day, count(*) AS n, round(avg(value), 6) AS mean, 0::BIGINT AS done_again FROM ev GROUP BY 1, 2, 3")
def staged_days(spark, sf):
    """Readings of each sensor, user and day by a stage that runs twice; done_again counts what the second run had to do."""
    import uuid

    from tideline.session import shared_folder
    from tideline.sources import stages

    top = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    d = events(spark, sf).select("user_id", "t", "value", "event_type")
    d.write.partitionBy("event_type").parquet(f"{top}/in")
    stage = lambda x: x.groupBy("event_type", "user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))
    for _ in range(2):
        out, done = stages.run_stage(spark, f"{top}/in", d.schema, "event_type", f"{top}/out", stage)
    return out.withColumn("done_again", F.lit(len(done)).cast("long"))


@query("WITH c AS (SELECT DISTINCT item_id, length(text) AS n FROM benchmark) SELECT k.item_id, c.n + CASE WHEN k.item_id % 3 = 0 THEN 1000 ELSE 0 END AS n, c.item_id IS NOT NULL AND k.item_id % 5 <> 0 OR k.item_id % 3 = 0 AND c.item_id IS NOT NULL AS hit FROM (SELECT DISTINCT item_id FROM benchmark) k LEFT JOIN c ON c.item_id = k.item_id AND (k.item_id % 5 <> 0 OR k.item_id % 3 = 0)")
def cached_lengths(spark, sf):
    """Item lengths from a cache: four fifths compacted into buckets, a third appended anew since, the others missing."""
    import uuid

    from tideline.session import shared_folder
    from tideline.sources.cache import KeyedCache

    d = read(spark, sf, "benchmark").select("item_id", F.length("text").alias("n"))
    c = KeyedCache(spark, f"{shared_folder(spark)}/caches/{uuid.uuid4().hex}", "item_id bigint, n int", 8)
    c.append(d.where("item_id % 5 <> 0"))
    c.compact()
    c.append(d.where("item_id % 3 = 0").withColumn("n", F.col("n") + 1000))
    return c.lookup(d.select("item_id").distinct()).select("item_id", "n", "hit")
