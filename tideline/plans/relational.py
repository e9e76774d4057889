"""Catalogue: joins in time, scans, predicates, aggregations, selection and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.config import DAY, HOUR
from tideline.functions import scalar
from tideline.operators import joins, select, timeops
from tideline.plans.registry import EV, events, query, r6, read
from tideline.plans.time import MERGED, order_sessions, spans

EVS = f"""{EV}, f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 ss AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM f),
 ses AS (SELECT user_id, session::BIGINT AS session, min(t) AS s, max(t) + 3600000000 AS e FROM ss GROUP BY 1, 2)"""


def event_sessions(spark, sf):
    d = timeops.sessionize(events(spark, sf), ["user_id"], "t", 6 * HOUR, ["event_id"])
    return d.groupBy("user_id", "session").agg(F.min("t").alias("s"), (F.max("t") + HOUR).alias("e"))


@query(f"WITH {EVS} SELECT ev.event_id, ses.session FROM ev JOIN ses ON ev.user_id = ses.user_id AND ev.t >= s AND ev.t < e")
def reading_in_window(spark, sf):
    return joins.range_join(events(spark, sf), event_sessions(spark, sf), ["user_id"], "t", "s", "e", 12 * HOUR).select("event_id", "session")


@query(f"WITH {EV} SELECT event_id, value FROM ev WHERE user_id IN (SELECT user_id FROM ev GROUP BY 1 HAVING max(value) > 150)")
def selected_windows_semi(spark, sf):
    d = events(spark, sf)
    picked = d.groupBy("user_id").agg(F.max("value").alias("m")).where("m > 150")
    return d.join(picked, "user_id", "left_semi").select("event_id", "value")


@query(f"""WITH {MERGED}, p AS (SELECT c_custkey AS k, 883612800000000 + (c_custkey % 50) * 604800000000 AS fs FROM customer)
 SELECT se.k, se.session, p.fs FROM p JOIN se ON p.k = se.k AND p.fs + 7776000000000 > se.s AND p.fs < se.e""")
def file_session_overlap(spark, sf):
    k = F.col("c_custkey")
    p = read(spark, sf, "customer").select(k.alias("k"), (F.lit(883612800000000) + (k % 50) * 604800000000).alias("fs")).withColumn("fe", F.col("fs") + 7776000000000)
    return joins.overlap_join(p, order_sessions(spark, sf).drop("n"), ["k"], "fs", "fe", "s", "e", 30 * DAY).select("k", "session", "fs")


@query(f"WITH {EV} SELECT a.event_id AS purchase, b.event_id AS error FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND b.t >= a.t - 21600000000 AND b.t < a.t + 21600000000")
def band_join(spark, sf):
    d = events(spark, sf)
    a = d.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), (F.col("t") - 6 * HOUR).alias("lo"), (F.col("t") + 6 * HOUR).alias("hi"))
    b = d.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error"), "t")
    return joins.range_join(b, a, ["user_id"], "t", "lo", "hi", 12 * HOUR).select("purchase", "error")


@query(f"""WITH {EVS}, g AS (SELECT event_id, user_id, t - 7200000000 AS gs, t AS ge FROM ev WHERE event_type = 'view')
 SELECT g.event_id, coalesce(min(session), -1) AS session FROM g LEFT JOIN ses ON g.user_id = ses.user_id AND ses.s <= ge AND ses.e >= gs GROUP BY 1""")
def first_overlap_session(spark, sf):
    g = events(spark, sf).where("event_type = 'view'").select("user_id", "event_id", (F.col("t") - 2 * HOUR).alias("gs"), F.col("t").alias("ge"))
    hit = joins.overlap_join(g, event_sessions(spark, sf), ["user_id"], "gs", "ge", "s", "e", 12 * HOUR, closed=True)
    first = joins.first_match(hit, ["event_id"], ["session"]).select("event_id", "session")
    return g.join(first, "event_id", "left").select("event_id", F.coalesce("session", F.lit(-1)).alias("session"))


@query(f"""WITH {EV}, i AS (SELECT event_id AS iid, user_id, t - 10800000000 AS s, t AS e FROM ev WHERE event_type = 'signup'), p AS (SELECT * FROM ev WHERE event_type = 'error'),
 m AS (SELECT p.event_id, p.t, min((s, iid)) AS b FROM p LEFT JOIN i ON p.user_id = i.user_id AND p.t >= s AND p.t < e GROUP BY 1, 2)
 SELECT event_id, coalesce(b[2], -1)::BIGINT AS segment, CASE WHEN b IS NULL THEN t - 5000000 ELSE b[1] END AS start_t FROM (SELECT event_id, t, CASE WHEN b[1] IS NULL THEN NULL ELSE b END AS b FROM m)""")
def point_in_interval(spark, sf):
    d = events(spark, sf)
    i = d.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("iid"), (F.col("t") - 3 * HOUR).alias("s"), F.col("t").alias("e"))
    p = d.where("event_type = 'error'").select("user_id", "event_id", "t")
    hit = joins.range_join(p, i, ["user_id"], "t", "s", "e", 6 * HOUR, "left")
    m = hit.groupBy("event_id", "t").agg(F.min(F.when(F.col("iid").isNotNull(), F.struct("s", "iid"))).alias("b"))
    return m.select("event_id", F.coalesce("b.iid", F.lit(-1)).alias("segment"), F.coalesce("b.s", F.col("t") - 5_000_000).alias("start_t"))


@query(f"""WITH {EV} SELECT user_id, t // 86400000000 AS day, {', '.join(f"round(avg(value) FILTER (event_type = '{x}'), 6) AS {x}" for x in ('click', 'error', 'purchase', 'signup', 'view'))} FROM ev GROUP BY 1, 2""")
def sensor_alignment_pivot(spark, sf):
    d = events(spark, sf).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    return d.pivot("event_type", kinds).agg(F.avg("value")).select("user_id", "day", *[r6(k).alias(k) for k in kinds])


@query("""WITH p AS (SELECT user_id, event_type, round(avg(value), 6) AS m FROM events GROUP BY 1, 2) SELECT user_id, event_type AS label, m AS prob FROM p""")
def unpivot_probabilities(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = read(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).agg(r6(F.avg("value")))
    return wide.unpivot("user_id", kinds, "label", "prob").where("prob is not null")


@query("SELECT n_name, coalesce(r_name, 'none') AS region, upper(replace(replace(replace(n_name, ' ', '_'), '-', '_'), '/', '_')) AS label FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def label_map_default(spark, sf):
    m = read(spark, sf, "region").where("r_regionkey < 3").select("r_regionkey", "r_name")
    d = joins.lookup(read(spark, sf, "nation"), m, "n_regionkey", "region", "none")
    return d.select("n_name", "region", F.upper(scalar.sanitize(F.col("n_name"))).alias("label"))


@query("SELECT doc_id, translate(text, ' -/', '___') AS label FROM documents WHERE text IS NOT NULL")
def label_sanitize(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", scalar.sanitize(F.col("text")).alias("label"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role IS NOT NULL AND lower(role) NOT IN ('', 'nan', 'no_match', 'unknown', 'unknown_location', 'unknown_activity')")
def sentinel_filter(spark, sf):
    return read(spark, sf, "conversations").where(scalar.is_known(F.col("role"))).select("conv_id", "turn", "role")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'no') AND contains(lower(text), 'match') THEN '' ELSE source END AS source FROM documents")
def fuzzy_no_match(spark, sf):
    t = F.lower("text")
    return read(spark, sf, "documents").select("doc_id", F.when(t.contains("no") & t.contains("match"), "").otherwise(F.col("source")).alias("source"))


@query("WITH c AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, n FROM c WHERE n > 1 AND n < 250")
def group_size_filter(spark, sf):
    d = read(spark, sf, "embeddings").withColumn("n", F.count("*").over(Window.partitionBy("label")))
    return d.where("n > 1 and n < 250").select("vec_id", "label", "n")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 20")
def min_rows_guard(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 20")


@query("SELECT event_id, CASE WHEN value BETWEEN 30 AND 40 THEN 'human' WHEN value BETWEEN 45 AND 150 THEN 'hot' WHEN value BETWEEN -5 AND 15 THEN 'cold' WHEN value BETWEEN 16 AND 29 THEN 'ambient' ELSE 'other' END AS band FROM events")
def plausibility_bands(spark, sf):
    v = F.col("value")
    band = F.when(v.between(30, 40), "human").when(v.between(45, 150), "hot").when(v.between(-5, 15), "cold").when(v.between(16, 29), "ambient").otherwise("other")
    return read(spark, sf, "events").select("event_id", band.alias("band"))


@query("SELECT vec_id, round(sum(CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE least(greatest(x, -1), 1) END), 5) AS s FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def clean_and_clip(spark, sf):
    x = scalar.clean_number(F.col("x").cast("double"))
    d = read(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    return d.groupBy("vec_id").agg(F.round(F.sum(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))), 5).alias("s"))


@query(f"""WITH {EV}, m AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM ev GROUP BY 1) SELECT event_id, round(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 255, 6) AS scaled FROM ev JOIN m ON ev.user_id = m.user_id""")
def min_max_scale(spark, sf):
    w = Window.partitionBy("user_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return read(spark, sf, "events").select("event_id", r6(F.coalesce((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)) * 255).alias("scaled"))


@query("SELECT page_id, split_part(url, '://', 1) AS scheme, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, try_cast(nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS INT) AS number FROM pages")
def name_tokens(spark, sf):
    g = lambda i: F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", i)
    return read(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"), g(1).alias("lang"), F.nullif(g(2), F.lit("")).try_cast("int").alias("number"))


@query("SELECT event_id, epoch_us(ts + INTERVAL 330 MINUTE) AS shifted FROM events")
def clock_shift(spark, sf):
    """UTC as the local time of a zone that has no summer time, so that both engines agree whatever their zone tables say."""
    d = read(spark, sf, "events")
    return d.select("event_id", scalar.micros(scalar.local_shift(F.col("ts").cast("timestamp_ntz"), "UTC", "Asia/Kolkata")).alias("shifted"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), -1) AS missing FROM events""")
def lenient_json(spark, sf):
    """Payloads as replies hold them: in a fenced block, inside a sentence, or bare."""
    from tideline.sources import store

    i = F.col("event_id") % 3
    reply = F.when(i == 0, F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n``` and {no more}"))).when(i == 1, F.concat(F.lit("The answer is "), F.col("props"), F.lit("."))).otherwise(F.col("props"))
    d = read(spark, sf, "events").withColumn("j", store.lenient_json(reply, "k bigint, missing bigint"))
    return d.select("event_id", "j.k", F.coalesce("j.missing", F.lit(-1)).alias("missing"))


@query("""SELECT user_id, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS payload, count(*) AS requests, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY 1""")
def json_payload_agg(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf, "events").groupBy("user_id").agg(F.sum(k).alias("payload"), F.count("*").alias("requests"), F.sum(F.octet_length("props")).alias("bytes"))


CHUNKS = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 b AS (SELECT *, max((length(line) < 4)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS broken FROM l)"""


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS records, sum(length(line))::BIGINT AS chars FROM b WHERE broken = 0 GROUP BY 1")
def chunk_log_framing(spark, sf):
    from tideline.sources.chunk_log import until_first_bad

    d = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    d = until_first_bad(d.withColumn("bad", F.length("line") < 4), ["doc_id"], "pos", "bad")
    return d.groupBy("doc_id").agg(F.count("*").alias("records"), F.sum(F.length("line")).alias("chars"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1, 2")
def distinct_counts(spark, sf):
    return read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT source, string_agg(lang, ' OR ' ORDER BY lang) AS langs FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1")
def ordered_or_concat(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), " OR ").alias("langs"))


@query(f"WITH {EV}, c AS (SELECT user_id, event_type, count(*) AS n, min(t) AS f FROM ev GROUP BY 1, 2) SELECT user_id, event_type AS label, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) = 1")
def mode_first_seen(spark, sf):
    c = events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("t").alias("f"))
    return joins.first_match(c, ["user_id"], [F.desc("n"), "f", "event_type"]).select("user_id", F.col("event_type").alias("label"), "n")


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, lang, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def argmax_label(spark, sf):
    c = read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    best = c.groupBy("source").agg(F.min_by(F.struct("lang", "n"), F.struct(-F.col("n"), F.col("lang"))).alias("b"))
    return best.select("source", "b.lang", "b.n")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1")
def entropy_bits(spark, sf):
    c = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return p.groupBy("user_id").agg(r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


@query("""WITH b AS (SELECT user_id, least(9, floor((value - lo) / nullif(hi - lo, 0) * 10))::INT AS bin FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events))
 SELECT user_id, coalesce(bin, 0) AS bin, count(*) AS n FROM b GROUP BY 1, 2""")
def histogram(spark, sf):
    w = Window.partitionBy("user_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    b = F.least(F.lit(9), F.floor((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 10).cast("int"))
    return read(spark, sf, "events").select("user_id", F.when(hi == lo, 0).otherwise(b).alias("bin")).groupBy("user_id", "bin").agg(F.count("*").alias("n"))


@query(f"""WITH {EV} SELECT user_id, round(regr_slope(value, t / 86400000000.0), 5) AS slope, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 4) AS var, round(max(value) - min(value), 6) AS ptp FROM ev GROUP BY 1""")
def trend_and_spread(spark, sf):
    d = events(spark, sf)
    days = (F.col("t") - F.lit(1_700_000_000_000_000)) / DAY
    v = F.col("value")
    return d.groupBy("user_id").agg(F.round(F.regr_slope(v, days), 5).alias("slope"), r6(F.stddev_pop(v)).alias("sd"), F.round(F.var_pop(v), 4).alias("var"), r6(F.max(v) - F.min(v)).alias("ptp"))


@query("SELECT user_id, count(*) FILTER (value > 20) AS high, count(*) FILTER (value BETWEEN 5 AND 20) AS mid, round(count(*) FILTER (value < 5) / count(*), 6) AS low_ratio FROM events GROUP BY 1")
def zone_ratio(spark, sf):
    v = F.col("value")
    return read(spark, sf, "events").groupBy("user_id").agg(F.count_if(v > 20).alias("high"), F.count_if(v.between(5, 20)).alias("mid"), r6(F.count_if(v < 5) / F.count("*")).alias("low_ratio"))


@query(f"""WITH {EVS}, c AS (SELECT user_id, session, count(*) AS n FROM ss GROUP BY 1, 2) SELECT user_id, session::BIGINT AS session, sum(n) OVER (PARTITION BY user_id ORDER BY session)::BIGINT AS seen FROM c""")
def expanding_sessions(spark, sf):
    d = timeops.sessionize(events(spark, sf), ["user_id"], "t", 6 * HOUR, ["event_id"]).groupBy("user_id", "session").agg(F.count("*").alias("n"))
    return d.select("user_id", "session", F.sum("n").over(Window.partitionBy("user_id").orderBy("session")).alias("seen"))


@query(f"WITH {EVS} SELECT user_id, session, lead(session) OVER (PARTITION BY user_id ORDER BY s) AS predicted, CASE WHEN session BETWEEN 1 AND 2 THEN 'early' WHEN session BETWEEN 3 AND 5 THEN 'middle' WHEN session BETWEEN 6 AND 10 THEN 'late' END AS stage FROM ses QUALIFY predicted IS NOT NULL")
def next_session_pair(spark, sf):
    s = event_sessions(spark, sf)
    o = F.col("session")
    stage = F.when(o.between(1, 2), "early").when(o.between(3, 5), "middle").when(o.between(6, 10), "late")
    return s.select("user_id", "session", F.lead("session").over(Window.partitionBy("user_id").orderBy("s")).alias("predicted"), stage.alias("stage")).where("predicted is not null")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) <= 10")
def stratified_hash_sample(spark, sf):
    return select.hash_sample(read(spark, sf, "documents"), ["source"], "doc_id", 10, "42").select("doc_id", "source")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn FROM documents) SELECT doc_id, source, rn // 7 AS batch, rn % 7 AS place, printf('batch_%04d', (rn // 7)::INT) AS name FROM r")
def batch_numbering(spark, sf):
    d = select.batches(read(spark, sf, "documents"), ["source"], ["doc_id"], 7)
    return d.select("doc_id", "source", "batch", "place", F.format_string("batch_%04d", "batch").alias("name"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations) SELECT conv_id, turn FROM r WHERE rn % 3 = 0 AND rn // 3 < 50")
def stride_sample(spark, sf):
    return select.stride(read(spark, sf, "conversations"), ["conv_id"], ["turn"], 3, 50).select("conv_id", "turn")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def anti_unprocessed(spark, sf):
    return joins.unprocessed(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), ["doc_id"], failed="quality = 0")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 9 ELSE quality END AS quality FROM labels")
def upsert_results(spark, sf):
    """Reviewed labels (the toxic ones, graded 9) replace the earlier grades."""
    old = read(spark, sf, "labels")
    return joins.upsert(old.select("doc_id", "quality"), old.where("toxic = 1").select("doc_id", F.lit(9).alias("quality")), ["doc_id"])


@query("SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang")
def dedupe_first(spark, sf):
    return read(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h"), "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lang")


@query("""SELECT 'intersect' AS op, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
 UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'union_all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)""")
def set_operations(spark, sf):
    a, b = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id")
    n = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n("intersect", a.intersect(b)).unionByName(n("except", a.subtract(b))).unionByName(n("union", a.union(b).distinct())).unionByName(n("union_all", a.unionByName(b, allowMissingColumns=True)))


@query("SELECT batch, count(*) AS n FROM (SELECT conv_id % 10 AS batch, turn FROM conversations) GROUP BY batch, turn HAVING count(*) > 1")
def key_collisions(spark, sf):
    return read(spark, sf, "conversations").groupBy((F.col("conv_id") % 10).alias("batch"), "turn").agg(F.count("*").alias("n")).where("n > 1").select("batch", "n")


@query("SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def summary_rollup(spark, sf):
    d = read(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return d.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "chars")


@query("""WITH m AS (SELECT page_id, length(html) AS frames, nullif(page_id % 4, 0) AS fps FROM pages) SELECT page_id, coalesce(fps, 30)::DOUBLE AS fps, round(frames / coalesce(fps, 30), 6) AS duration_s, CASE WHEN page_id % 2 = 0 THEN 1280 ELSE 160 END AS width FROM m""")
def media_metadata(spark, sf):
    from tideline.sources.media import with_defaults

    i = F.col("page_id")
    m = read(spark, sf, "pages").select("page_id", F.length("html").alias("frames"), F.nullif(i % 4, F.lit(0)).cast("double").alias("fps"), F.when(i % 2 == 1, 160).alias("width"), F.lit(None).cast("double").alias("duration_s"))
    return with_defaults(m, fps=30.0, width=1280).select("page_id", "fps", r6("duration_s").alias("duration_s"), "width")


@query(f"""WITH {MERGED}, c AS (SELECT sp.k, sp.o, sp.ln, se.session, (sp.s - se.s) / 1000000.0 AS off, least(sp.e, se.e) - sp.s AS len FROM sp JOIN se ON sp.k = se.k AND sp.s >= se.s AND sp.s < se.e)
 SELECT o, ln, session, round(off, 6) AS offset_s, round(len / 1000000.0, 6) AS length_s FROM c""")
def clip_manifest(spark, sf):
    from tideline.sources.media import clip_plan

    s = order_sessions(spark, sf).select("k", "session", F.col("s").alias("vs"), F.col("e").alias("ve"))
    d = clip_plan(spans(spark, sf).select("k", "o", "ln", F.col("s").alias("cs"), F.col("e").alias("ce")), s, ["k"], 30 * DAY)
    return d.select("o", "ln", "session", r6("offset_s").alias("offset_s"), r6("length_s").alias("length_s"))
