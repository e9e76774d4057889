"""Catalogue: joins of features, labels, truth and metadata, windows over common ranges, forward evaluation, ranks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.config import DAY, HOUR
from tideline.operators import pairing, timeops
from tideline.plans.registry import EV, events, query, r6, read


@query("""WITH c AS (SELECT source, lang, min(doc_id) AS cluster FROM documents GROUP BY 1, 2 HAVING count(*) > 3)
 SELECT d.doc_id, c.cluster FROM documents d LEFT JOIN c ON d.source = c.source AND d.lang = c.lang WHERE c.cluster IS NOT NULL""")
def labels_with_clusters(spark, sf):
    d = read(spark, sf, "documents")
    c = d.groupBy("source", "lang").agg(F.min("doc_id").alias("cluster"), F.count("*").alias("n")).where("n > 3")
    return pairing.labelled(d, c, ["source", "lang"], "cluster").select("doc_id", "cluster")


@query("""SELECT vec_id, quality, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) AS size FROM embeddings JOIN labels ON vec_id = doc_id WHERE embedding IS NOT NULL AND quality IS NOT NULL""")
def features_with_labels(spark, sf):
    lab = read(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    d = pairing.training_rows(read(spark, sf, "embeddings"), lab, "vec_id", "embedding", "quality")
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return d.select("vec_id", "quality", F.round(size, 5).alias("size"))


PAIR = f"""{EV}, w AS (SELECT user_id, t // 86400000000 AS day, event_type, value, t, event_id FROM ev),
 tr AS (SELECT user_id, day, arg_max(event_type, (t, event_id)) AS truth FROM w GROUP BY 1, 2),
 c AS (SELECT user_id, day, event_type, count(*) AS n FROM w GROUP BY 1, 2, 3),
 pr AS (SELECT user_id, day, event_type AS pred FROM c QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, event_type) = 1)"""


def truth_and_predictions(spark, sf):
    """Truth: a day's last event. Prediction: its most frequent one."""
    d = events(spark, sf).withColumn("day", F.floor(F.col("t") / DAY))
    truth = d.groupBy("user_id", "day").agg(F.max_by("event_type", F.struct("t", "event_id")).alias("truth"))
    c = d.groupBy("user_id", "day", "event_type").agg(F.count("*").alias("n"))
    pred = c.groupBy("user_id", "day").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("pred"))
    return truth, pred


@query(f"WITH {PAIR} SELECT user_id, count(*) AS n, count(*) FILTER (truth = pred) AS correct FROM tr JOIN pr USING (user_id, day) GROUP BY 1")
def truth_with_predictions(spark, sf):
    d = pairing.judged(*truth_and_predictions(spark, sf), ["user_id", "day"])
    return d.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("pred")).alias("correct"))


@query("SELECT l.doc_id, l.quality, d.source, d.n_chars FROM (SELECT doc_id * 2 AS doc_id, quality FROM labels) l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def annotations_with_samples(spark, sf):
    a = read(spark, sf, "labels").select((F.col("doc_id") * 2).alias("doc_id"), "quality")
    return pairing.annotated(a, read(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")


MAPPING = """am AS (SELECT doc_id, lang || ' AND ' || source || '; no such name;' AS nm FROM documents), ex AS (SELECT DISTINCT doc_id, trim(unnest(regexp_split_to_array(nm, ';| AND '))) AS nm FROM am),
 mp AS (SELECT lang AS nm, list_distinct(list(source)) AS gs FROM documents WHERE source < 'src3' GROUP BY 1), fl AS (SELECT ex.doc_id, unnest(mp.gs) AS g FROM ex JOIN mp ON ex.nm = mp.nm)"""


@query(f"WITH {MAPPING}, g AS (SELECT doc_id, string_agg(DISTINCT g, ',' ORDER BY g) AS mapped FROM fl GROUP BY 1) SELECT d.doc_id, coalesce(mapped, '') AS mapped FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id")
def mapped_truth(spark, sf):
    """Compound truth (language AND source) as the groups that its parts are mapped to."""
    d = read(spark, sf, "documents")
    names = d.select("doc_id", F.array(F.concat(F.col("lang"), F.lit(" AND "), F.col("source"), F.lit("; no such name;"))).alias("names"))
    table = d.where("source < 'src3'").groupBy("lang").agg(F.collect_set("source"))
    return pairing.mapped_truth(names, ["doc_id"], "names", table).select("doc_id", F.array_join("mapped", ",").alias("mapped"))


@query("""WITH s AS (SELECT user_id, user_id || '_' || (epoch_us(ts) // 86400000000) AS w FROM events), m AS (SELECT w, min(user_id)::VARCHAR || '-session' AS session_key FROM s WHERE user_id % 3 <> 0 GROUP BY 1)
 SELECT DISTINCT s.w AS window_id, coalesce(session_key, 'none') AS session_key FROM s LEFT JOIN m ON s.w = m.w""")
def window_session_map(spark, sf):
    s = events(spark, sf).select("user_id", F.concat_ws("_", F.col("user_id").cast("string"), F.floor(F.col("t") / DAY).cast("string")).alias("window_id"))
    m = s.where("user_id % 3 <> 0").groupBy("window_id").agg(F.concat(F.min("user_id").cast("string"), F.lit("-session")).alias("session_key"))
    return pairing.annotated(s.select("window_id").distinct(), m, "window_id").select("window_id", F.coalesce("session_key", F.lit("none")).alias("session_key"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' No Person' WHEN doc_id % 11 = 0 THEN 'Unknown' WHEN doc_id % 13 = 0 THEN 'No Video' WHEN doc_id % 17 = 0 THEN NULL ELSE lang END AS truth FROM documents)
 SELECT * FROM d WHERE truth IS NOT NULL AND trim(truth) NOT IN ('No Person', 'No Video', 'Unknown')""")
def truth_exclusions(spark, sf):
    i = F.col("doc_id")
    truth = F.when(i % 7 == 0, " No Person").when(i % 11 == 0, "Unknown").when(i % 13 == 0, "No Video").when(i % 17 == 0, F.lit(None)).otherwise(F.col("lang"))
    return read(spark, sf, "documents").select("doc_id", truth.alias("truth")).where(pairing.not_excluded(F.col("truth")))


@query("SELECT doc_id, doc_id || '-' || source || '::' || lang AS label, doc_id AS number, lang AS activity FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def composed_labels(spark, sf):
    d = read(spark, sf, "documents").where("lang is not null and source is not null")
    d = d.select("doc_id", pairing.compose_label(F.col("doc_id"), F.col("source"), F.col("lang")).alias("label"))
    return d.select("doc_id", "label", pairing.label_number(F.col("label")).alias("number"), pairing.label_activity(F.col("label")).alias("activity"))


@query("SELECT user_id, event_type AS label, event_id AS window_id FROM events WHERE value > 20")
def map_of_lists(spark, sf):
    """Label -> windows of each user as a map of lists, and taken apart again."""
    d = events(spark, sf).where("value > 20").groupBy("user_id", "event_type").agg(F.collect_list("event_id").alias("ids"))
    m = d.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "ids"))).alias("lists"))
    return pairing.map_pairs(m, ["user_id"], "lists", "label", "window_id")


@query("SELECT user_id, event_type AS label, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS windows FROM events GROUP BY 1, 2")
def label_window_lists(spark, sf):
    d = read(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return d.select("user_id", "label", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("windows"))


@query("""SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN lpad((page_id % 9)::VARCHAR, 8, '0') || '_123456' WHEN page_id % 3 = 1 THEN 'left_20240101_' || lpad((page_id % 5)::VARCHAR, 6, '0') ELSE (page_id % 4)::VARCHAR END AS prefix FROM pages""")
def recording_prefixes(spark, sf):
    i = F.col("page_id")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    name = F.when(i % 3 == 0, F.concat(F.lit("watch_recording/x_"), pad(i % 9, 8), F.lit("_123456_acc.csv"))).when(i % 3 == 1, F.concat(F.lit("in/watch_left_20240101_"), pad(i % 5, 6), F.lit("_acc.csv"))).otherwise(F.concat(F.lit("in/watch_"), (i % 4).cast("string"), F.lit("_acc")))
    return read(spark, sf, "pages").select(pairing.recording_prefix(name).alias("prefix")).distinct().orderBy("prefix")


RANGE = f"""{EV}, sn AS (SELECT event_type AS k, user_id % 3 AS sensor, t, value FROM ev), pe AS (SELECT k, sensor, min(t) AS a, max(t) AS b FROM sn GROUP BY 1, 2), ra AS (SELECT k, max(a) AS lo, min(b) AS hi, count(*) AS sensors FROM pe GROUP BY 1 HAVING max(a) <= min(b))"""


def three_sensors(spark, sf):
    return events(spark, sf).select(F.col("event_type").alias("k"), (F.col("user_id") % 3).alias("sensor"), "t", "value")


@query(f"WITH {RANGE} SELECT * FROM ra")
def sensor_common_range(spark, sf):
    return pairing.common_range(three_sensors(spark, sf), ["k"], "sensor", "t")


@query(f"""WITH {RANGE}, g AS (SELECT k, lo, hi, sensors, unnest(generate_series(0, (hi - lo - 86400000000) // 21600000000)) AS i FROM ra WHERE hi - lo >= 86400000000),
 c AS (SELECT g.k, sensors, lo + i * 21600000000 + 86400000000 AS window_end, sensor, count(value) AS n, sum(value) AS s FROM g JOIN sn ON g.k = sn.k AND sn.t >= lo + i * 21600000000 AND sn.t < lo + i * 21600000000 + 86400000000 GROUP BY 1, 2, 3, 4 HAVING count(value) > 10)
 SELECT k, window_end, min(n) AS low_n, sum(n)::BIGINT AS n, round(sum(s), 4) AS total FROM c GROUP BY k, sensors, window_end HAVING count(*) = sensors""")
def hop_windows_of_all_sensors(spark, sf):
    """Windows of a day, every six hours, over the common range of three sensors, kept where each has more than 10 rows."""
    d = pairing.shared_windows(three_sensors(spark, sf), ["k"], "sensor", "t", "value", DAY, 6 * HOUR, 10)
    return d.select("k", "window_end", "low_n", "n", F.round(F.col("mean") * F.col("n"), 4).alias("total"))


@query("SELECT event_type, bin, n, round(n / (sum(n) OVER (PARTITION BY event_type) * w), 6) AS density FROM (SELECT event_type, least(9, floor((value - lo) / (hi - lo) * 10))::INT AS bin, count(*) AS n, any_value((hi - lo) / 10) AS w FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events) WHERE hi > lo GROUP BY 1, 2)")
def histogram_density(spark, sf):
    """Density of ten equal bins between each key's least and largest value."""
    d = read(spark, sf, "events")
    b = d.join(d.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "event_type").where("hi > lo")
    c = b.groupBy("event_type", F.least(F.lit(9), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10).cast("int")).alias("bin")).agg(F.count("*").alias("n"), F.first((F.col("hi") - F.col("lo")) / 10).alias("w"))
    return c.select("event_type", "bin", "n", r6(F.col("n") / (F.sum("n").over(Window.partitionBy("event_type")) * F.col("w"))).alias("density"))


@query(f"""WITH {EV}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS rn FROM ev) SELECT user_id, (rn - 20) // 10 AS block, count(*) AS n, round(avg(value), 6) AS mean FROM b WHERE rn >= 20 GROUP BY 1, 2 HAVING count(*) = 10""")
def tumbling_blocks_skip(spark, sf):
    """Full blocks of ten readings after the first twenty."""
    d = timeops.ordered(events(spark, sf), ["user_id"], ["t", "event_id"], "rn").where("rn > 20").withColumn("block", F.floor((F.col("rn") - 21) / 10).cast("long"))
    return d.groupBy("user_id", "block").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean")).where("n = 10")


@query(f"""WITH {EV}, b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) // 10 AS block FROM ev), s AS (SELECT user_id, block, round(avg(value), 6) AS score FROM b GROUP BY 1, 2 HAVING count(*) = 10)
 SELECT event_id, score FROM b LEFT JOIN s ON b.user_id = s.user_id AND b.block = s.block""")
def score_onto_rows(spark, sf):
    """Scores of full blocks carried to the readings of each block."""
    b = timeops.tumbling_blocks(events(spark, sf), ["user_id"], ["t", "event_id"], 10)
    s = b.groupBy("user_id", "block").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("score")).where("n = 10")
    return pairing.onto_rows(b, s, ["user_id", "block"], "score").select("event_id", "score")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type)::INT AS rank FROM c QUALIFY rank <= 3")
def top_ranks(spark, sf):
    c = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return pairing.top_ranked(c, ["user_id"], [F.desc("n"), "event_type"], 3)


@query(f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)::INT AS place FROM ev")
def stable_time_order(spark, sf):
    """Places of each user's readings in time; readings of one time stand by their id."""
    return timeops.ordered(events(spark, sf), ["user_id"], ["t", "event_id"], "place").select("event_id", "place")


@query("""WITH u AS (SELECT epoch_us(ts) AS t, event_id AS id, 'events' AS source FROM events UNION ALL SELECT epoch_us(o_orderdate), o_orderkey, 'orders' FROM orders)
 SELECT source, id, t, (t - lag(t) OVER (PARTITION BY id % 50 ORDER BY t, source, id))::BIGINT AS pause FROM u""")
def chronological_merge(spark, sf):
    from tideline.functions.scalar import micros

    o = read(spark, sf, "orders").select(micros("o_orderdate").alias("t"), F.col("o_orderkey").alias("id"))
    u = pairing.merged_in_time({"events": events(spark, sf).select("t", F.col("event_id").alias("id")), "orders": o}, "t")
    return u.select("source", "id", "t", (F.col("t") - F.lag("t").over(Window.partitionBy(F.col("id") % 50).orderBy("t", "source", "id"))).alias("pause"))


FIRST = f"""{EV}, f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM f)"""


@query(f"WITH {FIRST} SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s WHERE session <= 12 GROUP BY 1, 2")
def first_sessions(spark, sf):
    """Each user's first twelve sessions."""
    s = timeops.sessionize(events(spark, sf), ["user_id"], "t", 6 * HOUR, ["event_id"])
    return s.where("session <= 12").groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, p AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id)::INT AS place FROM ev WHERE event_type IN ('click', 'view'))
 SELECT user_id, place, a.value AS a, b.value AS b FROM p a JOIN p b USING (user_id, place) WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def aligned_series(spark, sf):
    """Clicks and views of a user side by side by place, trimmed to the shorter series."""
    d = events(spark, sf)
    return pairing.aligned(d.where("event_type = 'click'"), d.where("event_type = 'view'"), ["user_id"], ["t", "event_id"], "value")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label, pos, avg(v) AS m, sum(v) AS s FROM x GROUP BY 1, 2), z AS (SELECT label, count(DISTINCT vec_id) AS n, sum(v * v) AS q FROM x GROUP BY 1),
 al AS (SELECT pos, avg(v) AS m FROM x GROUP BY 1), nn AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings),
 pd AS (SELECT x.vec_id, x.label AS own, c.label, sum(x.v * x.v) AS xx, sum(x.v * c.s) AS xs FROM x JOIN c ON x.pos = c.pos GROUP BY 1, 2, 3),
 di AS (SELECT vec_id, own, pd.label, CASE WHEN own = pd.label THEN (xx + q / z.n - 2 * xs / z.n) * z.n / nullif(z.n - 1, 0) ELSE xx + q / z.n - 2 * xs / z.n END AS d FROM pd JOIN z ON pd.label = z.label),
 ab AS (SELECT vec_id, min(d) FILTER (own = label) AS a, min(d) FILTER (own <> label) AS b FROM di GROUP BY 1), si AS (SELECT avg(CASE WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS s FROM ab),
 w AS (SELECT sum((v - m) * (v - m)) AS w FROM x JOIN c USING (label, pos)), bt AS (SELECT sum(z.n * (c.m - al.m) * (c.m - al.m)) AS b FROM c JOIN al USING (pos) JOIN z USING (label)),
 sp AS (SELECT label, avg(d) AS s FROM (SELECT vec_id, label, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN c USING (label, pos) GROUP BY 1, 2) GROUP BY 1),
 cd AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY 1, 2),
 db AS (SELECT avg(r) AS db FROM (SELECT i, max((p.s + q.s) / d) AS r FROM cd JOIN sp p ON i = p.label JOIN sp q ON j = q.label GROUP BY 1))
 SELECT round(s, 5) AS silhouette, round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz, round(db, 5) AS davies_bouldin, round(0.6 * s + 0.2 * (b / (k - 1)) / (w / (n - k)) / 1000 - 0.2 * db / 10, 5) AS score FROM si, w, bt, db, nn""")
def cluster_composite(spark, sf):
    """Silhouette (squared distances), Calinski-Harabasz and Davies-Bouldin of given labels, and their composite."""
    from tideline.operators.clustering import composite

    d = composite(read(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "vec_id", "label", "embedding")
    return d.select(F.round("silhouette", 5).alias("silhouette"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 5).alias("davies_bouldin"), F.round("score", 5).alias("score"))
