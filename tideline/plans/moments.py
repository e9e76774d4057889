"""Catalogue: window features, key moments, clustering, models, providers and streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.config import DAY, HOUR, Segments
from tideline.functions import motion
from tideline.operators import clustering, density, density_tree, labels, models, providers, segments
from tideline.plans.registry import EV, events, query, r6, read
from tideline.plans.time import scored

#: Six axes from the readings of a user-day: values of five sensors, and k of the payload.
AX = "ax AS (SELECT user_id, t // 86400000000 AS day, event_id, t, value AS ax, value * (event_id % 7) AS ay, (event_id % 11)::DOUBLE AS az, (event_id % 5)::DOUBLE AS gx, value / 2 AS gy, (event_id % 3)::DOUBLE AS gz, (event_id % 13)::DOUBLE AS mx, value AS my, 1.0::DOUBLE AS mz FROM ev), am AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS am, sqrt(gx * gx + gy * gy + gz * gz) AS gm, atan2(az, sqrt(ax * ax + ay * ay)) AS tilt, atan2(my, mx) AS heading FROM ax)"


def axes(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    d = events(spark, sf).select("user_id", F.floor(F.col("t") / DAY).alias("day"), "event_id", "t", v.alias("ax"), (v * (i % 7)).alias("ay"), (i % 11).cast("double").alias("az"), (i % 5).cast("double").alias("gx"), (v / 2).alias("gy"), (i % 3).cast("double").alias("gz"), (i % 13).cast("double").alias("mx"), v.alias("my"), F.lit(1.0).alias("mz"))
    return d.withColumns({"am": motion.magnitude("ax", "ay", "az"), "gm": motion.magnitude("gx", "gy", "gz"), "tilt": motion.tilt("ax", "ay", "az"), "heading": F.atan2("my", "mx")})


@query(f"""WITH {EV}, {AX} SELECT user_id, round(avg(am), 5) AS mag_mean, round(stddev_pop(am), 5) AS mag_std, round(max(am), 5) AS mag_max, round(stddev_pop(ax), 5) AS x_std, round(stddev_pop(ay), 5) AS y_std, round(stddev_pop(az), 5) AS z_std,
 round(coalesce(covar_pop(ax, ay) / nullif(stddev_pop(ax) * stddev_pop(ay), 0), 0), 5) AS xy_corr, round(coalesce(covar_pop(ax, az) / nullif(stddev_pop(ax) * stddev_pop(az), 0), 0), 5) AS xz_corr, round(coalesce(covar_pop(ay, az) / nullif(stddev_pop(ay) * stddev_pop(az), 0), 0), 5) AS yz_corr,
 round(sum(abs(ax) + abs(ay) + abs(az)), 4) AS sma, round(avg(tilt), 5) AS tilt FROM am GROUP BY 1""")
def motion_basic(spark, sf):
    d = axes(spark, sf).groupBy("user_id").agg(*[F.round(c, 4 if k == "sma" else 5).alias(k) for k, c in motion.accelerometer().items()])
    return d


@query(f"""WITH {EV}, {AX} SELECT user_id, round(avg(gm), 5) AS gyro_mean, round(stddev_pop(gm), 5) AS gyro_std, round(max(gm), 5) AS gyro_max, round(stddev_pop(gx), 5) AS gx_std, round(stddev_pop(gy), 5) AS gy_std, round(stddev_pop(gz), 5) AS gz_std,
 round(coalesce(covar_pop(am, gm) / nullif(stddev_pop(am) * stddev_pop(gm), 0), 0), 5) AS am_gm_corr, round(sum(gm * gm) / (sum(am * am) + 1e-8), 5) AS energy_ratio, round(sqrt(avg(am * am) + avg(gm * gm)), 5) AS combined, round(avg(sqrt(mx * mx + my * my + mz * mz)), 5) AS field_mean, round(stddev_pop(sqrt(mx * mx + my * my + mz * mz)), 5) AS field_std FROM am GROUP BY 1""")
def motion_cross(spark, sf):
    parts = {**motion.gyroscope(), **motion.crossed(), **motion.magnetometer()}
    return axes(spark, sf).groupBy("user_id").agg(*[F.round(c, 5).alias(k) for k, c in parts.items()])


@query(f"""WITH {EV}, {AX}, l AS (SELECT *, lag(am, 5) OVER w AS l5, lag(am) OVER w AS p, lag(am, 2) OVER w AS q, abs(tilt - lag(tilt) OVER w) AS dt, abs(heading - lag(heading) OVER w) AS dh FROM am WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
 SELECT user_id, round(coalesce(corr(am, l5), 0), 4) AS autocorr, round(count(*) FILTER (sign(am) * sign(p) < 0) / count(*), 6) AS zero_cross_rate, round(-coalesce(sum((am - 2 * p + q) * (am - 2 * p + q)), 0), 2) AS smoothness, round(ln(1 + var_pop(am) + var_pop(gm)), 5) AS intensity,
 count(*) FILTER (dt > 0.2) AS tilt_changes, round(coalesce(avg(least(dh, 2 * pi() - dh)), 0), 5) AS heading_change FROM l GROUP BY 1""")
def motion_temporal(spark, sf):
    d = motion.ordered_features(axes(spark, sf), ["user_id"], ["t", "event_id"], 5)
    return d.select("user_id", F.round("autocorr", 4).alias("autocorr"), r6("zero_cross_rate").alias("zero_cross_rate"), F.round("smoothness", 2).alias("smoothness"), F.round("intensity", 5).alias("intensity"), "tilt_changes", F.round("heading_change", 5).alias("heading_change"))


@query()
def spectral_features(spark, sf):
    return motion.spectral_features(axes(spark, sf), ["user_id"], ["t", "event_id"], "am")


CL = """cl AS (SELECT user_id, event_type AS sensor, t AS window_end, floor(value / 10)::INT AS label, (85 + event_id % 20) / 100 AS confidence, event_id AS id FROM ev),
 ca AS (SELECT *, count(*) OVER (PARTITION BY user_id, sensor, label) AS n FROM cl WHERE confidence > 0.9), cb AS (SELECT *, row_number() OVER (PARTITION BY user_id, sensor ORDER BY window_end, label, id) AS rn FROM ca WHERE n > 1 AND n < 250),
 sp AS (SELECT user_id, sensor, rn, window_end AS last, id, true AS kept FROM cb WHERE rn = 1 UNION ALL SELECT cb.user_id, cb.sensor, cb.rn, CASE WHEN cb.window_end - sp.last > 21600000000 THEN cb.window_end ELSE sp.last END, cb.id, cb.window_end - sp.last > 21600000000 FROM sp JOIN cb ON cb.user_id = sp.user_id AND cb.sensor = sp.sensor AND cb.rn = sp.rn + 1),
 cp AS (SELECT cb.* FROM cb JOIN sp ON cb.id = sp.id WHERE kept QUALIFY row_number() OVER (PARTITION BY cb.user_id, cb.sensor, label ORDER BY md5('42:' || cb.id::VARCHAR), cb.id) <= 10),
 co AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sensor, window_end, label, id) AS o FROM cp),
 ac AS (SELECT user_id, o, [window_end] AS ts, [id] AS ids FROM co WHERE o = 1 UNION ALL SELECT co.user_id, co.o, CASE WHEN len(list_filter(ts, lambda y: abs(y - co.window_end) < 21600000000)) = 0 THEN list_append(ts, co.window_end) ELSE ts END, CASE WHEN len(list_filter(ts, lambda y: abs(y - co.window_end) < 21600000000)) = 0 THEN list_append(ids, co.id) ELSE ids END FROM ac JOIN co ON co.user_id = ac.user_id AND co.o = ac.o + 1),
 fin AS (SELECT unnest(ids) AS id FROM (SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY o DESC) = 1))"""


def event_segments(spark, sf):
    i = F.col("event_id")
    d = events(spark, sf).select("user_id", F.col("event_type").alias("sensor"), F.col("t").alias("window_end"), F.floor(F.col("value") / 10).cast("int").alias("label"), ((85 + i % 20) / 100).alias("confidence"), i.alias("id"))
    return segments.compile_segments(d, ["user_id"], Segments(window_us=6 * HOUR))


@query(f"WITH RECURSIVE {EV}, {CL} SELECT cl.user_id, cl.sensor, cl.window_end, cl.label, cl.id FROM cl JOIN fin ON cl.id = fin.id")
def key_moments_compile(spark, sf):
    return event_segments(spark, sf)


@query()
def segments_with_anomalies(spark, sf):
    from tideline.plans.time import key_moments

    a = key_moments(spark, sf).select("user_id", (F.col("window_end") - 1).alias("t"), F.lit("anomaly").alias("name"))
    d = segments.attach_anomalies(event_segments(spark, sf), a, ["user_id"], 6 * HOUR)
    return d.select("user_id", "window_end", F.array_join("labels", ",").alias("labels"))


@query()
def gmm_scores(spark, sf):
    d = scored(spark, sf).withColumn("v", F.array("mean", F.col("window_end") % DAY / DAY))
    return density.density_scores(d, ["user_id"], ["window_end"], "v").select("user_id", "block", r6("score").alias("score"), "low_row", "feature")


@query()
def gmm_score_only(spark, sf):
    """Mixtures of each user's readings before the 16th, and the log density of the later ones under them."""
    d = scored(spark, sf).withColumn("v", F.array("mean", F.col("window_end") % DAY / DAY))
    border = 1_705_276_800_000_000
    known = d.where(F.col("window_end") < border)
    enough = known.groupBy("user_id").count().where("count >= 20").select("user_id")
    m = density.fit_densities(known.join(enough, "user_id", "left_semi"), ["user_id"], ["window_end"], "v")
    return density.score_only(d.where(F.col("window_end") >= border), m, ["user_id"], "v").select("user_id", "window_end", r6("score").alias("score"))


@query()
def kmeans_clusters(spark, sf):
    d, _ = clustering.kmeans(read(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", [4, 8], dims=8)
    return d.select("vec_id", "cluster")


@query()
def kmeans_search(spark, sf):
    """The composite of every size of PCA and k."""
    d = read(spark, sf, "embeddings").select("vec_id", "embedding")
    _, tried = clustering.kmeans_search(d, "vec_id", "embedding", [0, 8], [4, 8])
    return tried


@query()
def hdbscan_clusters(spark, sf):
    """Density clusters of each class's vectors, under the best parameters of a search; a cluster is named by its smallest id."""
    d = read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("sensor"), F.col("embedding").alias("v"))
    return density_tree.density_search(d, "sensor", "vec_id", "v").select("sensor", "vec_id", "label", r6("confidence").alias("confidence"))


@query()
def model_predictions(spark, sf):
    """Three trainers fitted on four fifths of the embeddings; long probabilities of the others, majority vote of all."""
    d = read(spark, sf, "embeddings")
    kept, asked = d.where("vec_id % 5 <> 0"), d.where("vec_id % 5 = 0")
    long = None
    for name in ("random_forest", "logistic", "knn"):
        p = models.train(kept, "embedding", "label", name).predict(asked, ["vec_id"], "embedding").withColumn("trainer", F.lit(name))
        long = p if long is None else long.unionByName(p)
    return labels.majority_vote(long, ["vec_id"], ["trainer"], "label", "prob").select("vec_id", "prediction", "votes")


@query()
def scene_descriptions(spark, sf):
    d = read(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("frames"))
    return providers.describe(d, "conv_id", "frames", providers.Rules())


@query()
def label_embeddings(spark, sf):
    return providers.embed(read(spark, sf, "benchmark").select("item_id", "text"), "text", providers.Rules()).select("item_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def drained_windows(spark, sf, size):
    """A file stream drained in complete mode: equal to the batch result after the last file."""
    from tideline.streaming import streams

    s = spark.readStream.schema(streams.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.drain(streams.hop_windows(s, ["user_id"], size, "6 hours").drop("mean"), "windows", "complete")


@query("SELECT user_id, epoch_us(ts) // 21600000000 * 21600000000 + 21600000000 AS window_end, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumble_equals_batch(spark, sf):
    return drained_windows(spark, sf, "6 hours")


@query(f"""WITH {EV} SELECT user_id, e AS window_end, count(*) AS n FROM (SELECT *, unnest(generate_series((t // 21600000000 + 1) * 21600000000, (t // 21600000000 + 4) * 21600000000, 21600000000)) AS e FROM ev) GROUP BY 1, 2""")
def stream_hop_equals_batch(spark, sf):
    return drained_windows(spark, sf, "24 hours")


@query(f"""WITH {EV}, w AS (SELECT max(t) // 1000 * 1000 - 3600000000 AS mark FROM ev), c AS (SELECT user_id, value, unnest(generate_series((t // 21600000000 + 1) * 21600000000, (t // 21600000000 + 4) * 21600000000, 21600000000)) AS e FROM ev)
 SELECT user_id, e AS window_end, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(median(value), 6) AS median FROM c, w WHERE e < mark GROUP BY 1, 2""")
def stream_closed_windows(spark, sf):
    """Windows of a day, every six hours, each emitted once when the watermark (an hour behind the latest reading) has passed it, in append mode."""
    from tideline.streaming import closing, streams

    s = spark.readStream.schema(streams.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", "1 hour")
    s = s.withColumn("t", F.unix_micros("time")).where("value is not null")
    with closing.row_store(spark):
        d = streams.drain(closing.closing_windows(s, "user_id", "t", "value", "time", DAY, 6 * HOUR), "closed")
    return d.select("user_id", "window_end", "n", r6("mean").alias("mean"), "low", "high", r6("median").alias("median"))


@query()
def frame_estimates(spark, sf):
    """Poses, masks and depth of frames from the stand-in estimator, as numbers that tests can hold on to."""
    from tideline.plans.frames import series

    d = providers.estimate(series(spark, sf), ["t"], "frame", providers.Thresholds())
    return d.select("t", F.size("joints").alias("joints"), F.aggregate(F.flatten("mask"), F.lit(0), lambda a, x: a + x).alias("mask_area"), F.array_max(F.flatten("depth")).alias("depth_max"))


NAMES = "c AS (SELECT source AS place, lang || 'one ' || lang || 'two ' || CASE WHEN doc_id % 2 = 0 THEN 'talk' ELSE 'text' END AS name, count(*) AS n FROM documents GROUP BY 1, 2)"


@query(f"WITH {NAMES}, m AS (SELECT place, name, first_value(name) OVER (PARTITION BY place, split_part(name, ' ', 1) ORDER BY n DESC, name) AS merged, n FROM c) SELECT place, merged, sum(n)::BIGINT AS total, count(DISTINCT name) AS names FROM m GROUP BY 1, 2")
def merged_activities(spark, sf):
    """Names of each place merged by the provider (two of four words shared make one half) and their counts under the merged names."""
    i = F.when(F.col("doc_id") % 2 == 0, "talk").otherwise("text")
    c = read(spark, sf, "documents").groupBy(F.col("source").alias("place"), F.concat_ws(" ", F.concat("lang", F.lit("one")), F.concat("lang", F.lit("two")), i).alias("name")).agg(F.count("*").alias("n"))
    m = providers.merge_within(c, "place", "name", "n", providers.Rules(alike=0.5), 1)
    return providers.consolidated(c, m, ["place"], "name", "n")


@query("SELECT DISTINCT lang || ' ' || source AS label, lang || ' group' AS \"group\", lang AS reason FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def truth_label_groups(spark, sf):
    """Truth labels (language and source) as discovered groups (one for each language)."""
    d = read(spark, sf, "documents").where("lang is not null and source is not null")
    groups = sorted(x + " group" for x in providers.distinct_names(d, "lang"))
    return providers.truth_groups(d.select(F.concat_ws(" ", "lang", "source").alias("label")), "label", groups, providers.Rules())
