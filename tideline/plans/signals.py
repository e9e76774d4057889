"""Catalogue: models of ever more sessions, recursive filters and least-squares smoothing of readings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.config import DAY, HOUR
from tideline.functions import filters
from tideline.operators import expanding
from tideline.plans.registry import EV, events, query, r6, read

DAYS = f"{EV}, r AS (SELECT user_id, event_id, t // 86400000000 AS day, event_type AS label, value AS x, (t % 86400000000) / 3600000000 AS y FROM ev), s AS (SELECT DISTINCT user_id, day FROM r)"
UPTO = f"{DAYS}, m AS (SELECT s.user_id, s.day, r.label, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM s JOIN r ON r.user_id = s.user_id AND r.day <= s.day GROUP BY 1, 2, 3)"


def days(spark, sf):
    v = F.array("value", F.col("t") % DAY / HOUR)
    return events(spark, sf).select("user_id", "event_id", F.floor(F.col("t") / DAY).alias("day"), F.col("event_type").alias("label"), v.alias("v"))


@query(f"WITH {UPTO} SELECT user_id, day, label, n, round(mx, 6) AS mean_value, round(my, 6) AS mean_hour, round(sx, 6) AS sd_value, round(sy, 6) AS sd_hour FROM m")
def expanding_centroids(spark, sf):
    """Each user's class means and deviations at every day, of all days up to it."""
    m = expanding.expanding_classes(days(spark, sf), ["user_id"], "day", "label", "v")
    return m.select("user_id", "day", "label", "n", *[r6(F.get(c, F.lit(i))).alias(f"{c}_{x}") for c in ("mean", "sd") for i, x in enumerate(("value", "hour"))])


@query(f"""WITH {UPTO}, l AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS model FROM s)
 SELECT r.user_id, r.day, r.event_id, first(m.label ORDER BY (x - mx) * (x - mx) + (y - my) * (y - my), m.label) AS prediction FROM r JOIN l ON l.user_id = r.user_id AND l.day = r.day JOIN m ON m.user_id = r.user_id AND m.day = l.model GROUP BY 1, 2, 3""")
def expanding_predictions(spark, sf):
    """Each reading's class under the model of all its user's earlier days."""
    d = days(spark, sf)
    return expanding.predict_next(d, expanding.expanding_classes(d, ["user_id"], "day", "label", "v"), ["user_id"], "day", "event_id", "label", "v")


def _step_sql() -> str:
    """The sections of the filter, sample by sample, as a recursion over a user's readings."""
    inner, outs = "SELECT f.user_id, f.rn, f.event_id, f.u AS o0, p.* EXCLUDE (user_id, rn, event_id, y) FROM p JOIN f ON f.user_id = p.user_id AND f.rn = p.rn + 1", []
    for i, (b0, b1, b2, a1, a2) in enumerate(filters.band_sections(0.5, 3.0, 50.0).tolist(), 1):
        inner = f"SELECT *, {b0!r}::DOUBLE * o{i - 1} + z{i}1 AS o{i} FROM ({inner})"
        outs.append(f"{b1!r}::DOUBLE * o{i - 1} - {a1!r}::DOUBLE * o{i} + z{i}2 AS z{i}1, {b2!r}::DOUBLE * o{i - 1} - {a2!r}::DOUBLE * o{i} AS z{i}2")
    zero = ", ".join(f"0::DOUBLE AS z{i}1, 0::DOUBLE AS z{i}2" for i in range(1, 5))
    return f"""WITH RECURSIVE {EV}, f AS (SELECT user_id, event_id, value AS u, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev),
 p AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, {zero}, 0::DOUBLE AS y FROM f UNION ALL SELECT user_id, rn, event_id, {', '.join(outs)}, o4 AS y FROM ({inner}))
 SELECT user_id, event_id, round(y, 6) AS filtered FROM p WHERE rn > 0"""


@query(_step_sql())
def step_filter(spark, sf):
    """Each user's readings, taken as 50 a second, through the step band (0.5 to 3 Hz)."""
    d = filters.band_filtered(events(spark, sf).select("user_id", "t", "event_id", "value"), ["user_id"], ["t", "event_id"], "value", "filtered")
    return d.select("user_id", "event_id", r6("filtered").alias("filtered"))


def _smooth_sql() -> str:
    weights = filters.smoothing_weights(5, 2).tolist()
    at = lambda k: f"lag(value, {-k}) OVER w" if k < 0 else f"lead(value, {k}) OVER w" if k else "value"
    fit = lambda o: " + ".join(["0.0::DOUBLE", *(f"{weights[o + 2][k + 2]!r}::DOUBLE * {at(k - o)}" for k in range(-2, 3))])
    return f"""WITH {EV}, a AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n,
  {', '.join(f"{fit(o)} AS f{o + 2}" for o in range(-2, 3))} FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 s AS (SELECT *, CASE WHEN n <= 5 THEN value WHEN rn = 1 THEN f0 WHEN rn = 2 THEN f1 WHEN rn = n THEN f4 WHEN rn = n - 1 THEN f3 ELSE f2 END AS smooth FROM a)"""


@query(f"{_smooth_sql()} SELECT user_id, event_id, round(smooth, 6) AS smooth FROM s")
def savitzky_golay(spark, sf):
    d = filters.smoothed(events(spark, sf).select("user_id", "t", "event_id", "value"), ["user_id"], ["t", "event_id"], "value", "smooth")
    return d.select("user_id", "event_id", r6("smooth").alias("smooth"))


@query(f"{_smooth_sql()}, d AS (SELECT *, smooth - lag(smooth) OVER w < 0 AS down FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), e AS (SELECT *, down <> lag(down) OVER w AS turn FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, count(*) FILTER (turn) AS turns FROM e GROUP BY 1")
def smoothed_turns(spark, sf):
    """How often each user's smoothed readings turn."""
    return filters.turns(events(spark, sf).select("user_id", "t", "event_id", "value"), ["user_id"], ["t", "event_id"], "value")


@query()
def thermal_inpainted(spark, sf):
    """Thermal frames whose cells below zero are missing, filled: their least and mean value, and how many were filled."""
    from tideline.functions.inpaint import inpainted
    from tideline.plans.frames import series

    d = series(spark, sf, 120.0, 5.0)
    cells = F.flatten("frame")
    d = d.select("w", "t", F.size(F.filter(cells, lambda v: v < 0)).alias("missing"), F.flatten(inpainted(F.col("frame"))).alias("v"))
    return d.select("w", "t", "missing", F.round(F.array_min("v"), 5).alias("low"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), 5).alias("mean"))


@query("""WITH f AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) AS frame, embedding AS e FROM embeddings WHERE len(embedding) = 64), c AS (SELECT frame, unnest(e)::DOUBLE AS v, generate_subscripts(e, 1) - 1 AS p FROM f WHERE frame % 4 = 0 AND frame >= 20)
 SELECT frame, round(frame / 8.0, 6) AS t, count(*) AS cells, round(sum(v), 5) AS total FROM c WHERE p % 8 < 4 GROUP BY 1""")
def raw_frame_scan(spark, sf):
    """Left halves of every fourth frame from the twentieth on, of a raw file that executors write from the vectors, taken as 8 frames a second."""
    import uuid

    from tideline.session import shared_folder
    from tideline.sources.frames import RawFrames

    spark.dataSource.register(RawFrames)
    path = f"{shared_folder(spark)}/frames/{uuid.uuid4().hex}"
    d = read(spark, sf, "embeddings").where("size(embedding) = 64").orderBy("vec_id").select("vec_id", "embedding")
    d = d.withColumn("place", F.monotonically_increasing_id())

    def write(frames):
        import numpy as np
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root)
        for f in frames:
            if len(f):
                # names in the order of the ids
                with fs.open_output_stream(f"{root}/{f['place'].iloc[0]:020d}.raw") as out:
                    out.write(np.stack(f["embedding"]).astype("float32").tobytes())
        return iter([])

    d.mapInPandas(write, "n long").collect()
    # frames are numbered through all files by what came before
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:", "").alias("file"), (F.col("length") / 256).cast("long").alias("n"))
    starts = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"))
    f = spark.read.format("raw_frames").options(height=8, width=8, dtype="float32", fps=8, crop="0:4").load(path).join(starts, "file")
    f = f.withColumn("frame", F.col("frame") + F.col("start")).where("frame % 4 = 0 and frame >= 20")
    v = F.flatten("pixels")
    return f.select("frame", F.round(F.col("frame") / 8, 6).alias("t"), F.size(v).cast("long").alias("cells"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
