"""Catalogue: features of frame series. Frames of eight by eight cells, and poses, are taken from the vectors of the embeddings."""

from pyspark.sql import functions as F

from tideline.functions import frames
from tideline.plans.registry import query, read

CELLS = """ce AS (SELECT label AS w, vec_id AS t, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, v FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""
THERMAL = f"{CELLS}, th AS (SELECT w, t, y, x, 25 + 120 * v AS v FROM ce)"
BAND = {"human": (30, 40), "hot": (45, 150), "cold": (-5, 15), "ambient": (16, 29)}


def series(spark, sf, scale: float = 1.0, shift: float = 0.0):
    """w (the window), t, frame."""
    row = lambda y: F.transform(F.slice("embedding", y * 8 + 1, 8), lambda v: v.cast("double") * scale + shift)
    return read(spark, sf, "embeddings").select(F.col("label").alias("w"), F.col("vec_id").alias("t"), F.transform(F.sequence(F.lit(0), F.lit(7)), row).alias("frame"))


def rounded(df, keys, digits=4):
    kinds = dict(df.dtypes)
    return df.select(*keys, *[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys])


@query(f"""WITH {CELLS}, r AS (SELECT w, t, y, max(v) AS v FROM ce GROUP BY 1, 2, 3), rc AS (SELECT w, y, greatest(0, v - avg(v) OVER (PARTITION BY w, y)) AS v FROM r), rs AS (SELECT w, y AS pos, sum(v) AS v FROM rc GROUP BY 1, 2),
 q AS (SELECT w, t, x, avg(v) AS m, stddev_pop(v) AS s FROM ce GROUP BY 1, 2, 3), qs AS (SELECT w, x, sum(m) AS m, sum(s) AS s FROM q GROUP BY 1, 2)
 SELECT w, 'range' AS part, pos, round(v, 4) AS v FROM rs UNION ALL SELECT w, 'velocity', x, round(m, 4) FROM qs UNION ALL SELECT w, 'velocity', x + 8, round(s, 4) FROM qs""")
def doppler_profile(spark, sf):
    d = frames.doppler_features(series(spark, sf), ["w"], "t", "frame")
    each = lambda part: d.select("w", F.lit(part).alias("part"), F.posexplode(f"{part}_profile").alias("pos", "v"))
    return each("range").unionByName(each("velocity")).select("w", "part", "pos", F.round("v", 4).alias("v"))


BANDS_SQL = ", ".join(f"count(*) FILTER (v BETWEEN {a} AND {b}) AS {n}_n, coalesce(max(v) FILTER (v BETWEEN {a} AND {b}), {a}) AS {n}_max, avg(x) FILTER (v BETWEEN {a} AND {b}) AS {n}_x, avg(y) FILTER (v BETWEEN {a} AND {b}) AS {n}_y" for n, (a, b) in BAND.items())


def far_sql(other: str) -> str:
    return f"coalesce(sqrt(pow(human_x - {other}_x, 2) + pow(human_y - {other}_y, 2)) / sqrt(128), 1)"


@query(f"""WITH {THERMAL}, f AS (SELECT w, t, max(v) - min(v) AS spread, {BANDS_SQL} FROM th GROUP BY 1, 2),
 g AS (SELECT *, {far_sql('hot')} AS nh, {far_sql('cold')} AS nc, abs(spread - lag(spread) OVER o) AS jump, row_number() OVER o AS i, last_value(human_x IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING) AS hx, last_value(human_y IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING) AS hy FROM f WINDOW o AS (PARTITION BY w ORDER BY t)),
 h AS (SELECT *, sqrt(pow(hx - lag(hx) OVER o, 2) + pow(hy - lag(hy) OVER o, 2)) AS step FROM g WINDOW o AS (PARTITION BY w ORDER BY t))
 SELECT w, {", ".join(f"round(avg({n}_n) / 64, 4) AS {n}_area, round(max({n}_max), 4) AS {n}_max" for n in BAND)}, round(min(nh), 4) AS near_hot, round(min(nc), 4) AS near_cold, min(nh) < 0.1 AS touch_hot, min(nc) < 0.1 AS touch_cold,
 round(coalesce(regr_slope(spread, i), 0), 4) AS trend, round(max(spread), 4) AS spread_max, round(avg(spread), 4) AS spread_mean, round(coalesce(max(jump), 0), 4) AS jump_max, round(coalesce(sum(step), 0) / count(*), 4) AS movement,
 round(CASE WHEN avg(human_n) > 0 THEN 1 - stddev_pop(human_n) / avg(human_n) ELSE 0 END, 4) AS stability FROM h GROUP BY 1""")
def thermal_window_features(spark, sf):
    return rounded(frames.thermal_features(series(spark, sf, 120.0, 25.0), ["w"], "t", "frame"), ["w"])


@query(f"""WITH {THERMAL}, b AS (SELECT w, t, coalesce(count(*) FILTER (v BETWEEN 45 AND 150) / ((max(y) FILTER (v BETWEEN 45 AND 150) - min(y) FILTER (v BETWEEN 45 AND 150) + 1) * (max(x) FILTER (v BETWEEN 45 AND 150) - min(x) FILTER (v BETWEEN 45 AND 150) + 1)), 0) AS c FROM th GROUP BY 1, 2)
 SELECT w, round(avg(c), 5) AS compactness FROM b GROUP BY 1""")
def thermal_compactness(spark, sf):
    d = frames.compactness(series(spark, sf, 120.0, 25.0), ["w", "t"], "frame")
    return d.groupBy("w").agg(F.round(F.avg("compactness"), 5).alias("compactness"))


@query(f"""WITH RECURSIVE {THERMAL}, hot AS (SELECT t, y * 8 + x AS i, y, x FROM th WHERE v BETWEEN 45 AND 150), ed AS (SELECT a.t, a.i, b.i AS j FROM hot a JOIN hot b ON a.t = b.t AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
 re AS (SELECT t, i, i AS j FROM hot UNION SELECT re.t, re.i, ed.j FROM re JOIN ed ON re.t = ed.t AND re.j = ed.i), ro AS (SELECT t, i, min(j) AS r FROM re GROUP BY 1, 2)
 SELECT vec_id AS t, count(DISTINCT r)::INT AS regions FROM embeddings LEFT JOIN ro ON vec_id = t GROUP BY 1""")
def thermal_hot_regions(spark, sf):
    return series(spark, sf, 120.0, 25.0).select("t", frames.hot_regions(F.col("frame")).alias("regions"))


@query(f"""WITH {CELLS}, dm AS (SELECT w, t, y, x, CASE WHEN (y + x) % 3 > 0 THEN v ELSE 0 END AS v FROM ce), tp AS (SELECT w, y, x, max(v) AS top FROM dm GROUP BY 1, 2, 3),
 sh AS (SELECT w, count(*) AS area, avg(top) AS dme, max(top) AS dma, var_pop(top) AS dva, (max(y) - min(y) + 1) / (max(x) - min(x) + 1) AS asp, avg(x) AS cx, avg(y) AS cy, log2(count(*)) AS ent FROM tp WHERE top > 0.05 GROUP BY 1),
 gy AS (SELECT tp.w, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS gyr FROM tp JOIN sh ON tp.w = sh.w WHERE top > 0.05 GROUP BY 1),
 mv AS (SELECT w, y, x, avg(d) AS d, max(v) AS top FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY w, y, x ORDER BY t)) AS d FROM dm) GROUP BY 1, 2, 3),
 ms AS (SELECT w, count(*) FILTER (d > 0.1 AND top > 0.05) AS active, coalesce(avg(d) FILTER (d > 0.1 AND top > 0.05), 0) AS motion FROM mv GROUP BY 1),
 cn AS (SELECT w, t, avg(x) AS cx, avg(y) AS cy FROM dm WHERE v > 0.05 GROUP BY 1, 2), st AS (SELECT *, cx - lag(cx) OVER o AS dx, cy - lag(cy) OVER o AS dy FROM cn WINDOW o AS (PARTITION BY w ORDER BY t)),
 sa AS (SELECT *, sqrt(dx * dx + dy * dy) AS step, CASE WHEN dx IS NOT NULL THEN atan2(dy, dx) END AS angle FROM st), sl AS (SELECT *, abs(angle - lag(angle) OVER (PARTITION BY w ORDER BY t)) AS tn FROM sa),
 ss AS (SELECT w, coalesce(sum(step), 0) AS displacement, coalesce(avg(step), 0) AS velocity, count(*) FILTER (step > 0.5 AND least(tn, 2 * pi() - tn) > pi() / 4) AS turns, coalesce(sum(abs(dy)) / (sum(abs(dx)) + 1e-6), 0) AS vertical FROM sl GROUP BY 1)
 SELECT sh.w, area, round(dme, 4) AS depth_mean, round(dma, 4) AS depth_max, round(dva, 4) AS depth_var, round(asp, 4) AS aspect, round(ent, 4) AS entropy, round(gyr, 4) AS gyration, active, round(motion, 4) AS motion, round(displacement, 4) AS displacement, round(velocity, 4) AS velocity, turns, round(vertical, 4) AS vertical
 FROM sh LEFT JOIN gy ON sh.w = gy.w LEFT JOIN ms ON sh.w = ms.w LEFT JOIN ss ON sh.w = ss.w""")
def person_depth_features(spark, sf):
    """Depth frames where a mask (two of three diagonals) is set."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: ((y + x) % 3 > 0).cast("int")))
    d = series(spark, sf).withColumn("frame", frames.person_depth(F.col("frame"), mask))
    return rounded(frames.depth_features(d, ["w"], "t", "frame"), ["w"])


@query(f"WITH {CELLS} SELECT w, round(quantile_cont(v, 0.01), 5) AS p01, round(quantile_cont(v, 0.99), 5) AS p99, round(quantile_cont(v, 0.99) - quantile_cont(v, 0.01), 5) AS range FROM ce WHERE v > 0 GROUP BY 1")
def depth_range(spark, sf):
    return rounded(frames.depth_percentiles(series(spark, sf), ["w"], "frame"), ["w"], 5)


def poses(spark, sf):
    """w, t, joints: 17 joints from the first 51 numbers of a vector."""
    e = lambda i: F.get("embedding", i).cast("double")
    one = lambda j: F.struct((100 + 300 * e(j)).alias("x"), (100 + 20 * j + 200 * e(j + 17)).alias("y"), F.least(F.lit(1.0), 5 * F.abs(e(j + 34))).alias("conf"))
    return read(spark, sf, "embeddings").select(F.col("label").alias("w"), F.col("vec_id").alias("t"), F.transform(F.sequence(F.lit(0), F.lit(16)), one).alias("joints"))


#: One row for each frame: a column for each coordinate of a joint that is sure.
J = {n: i for i, n in enumerate(frames.JOINTS)}
POSE = "po AS (SELECT label AS w, vec_id AS t, " + ", ".join(
    f"CASE WHEN c{i} > 0.3 THEN 100 + 300 * e[{i + 1}] END AS x{i}, CASE WHEN c{i} > 0.3 THEN {100 + 20 * i} + 200 * e[{i + 18}] END AS y{i}, c{i}, 100 + 300 * e[{i + 1}] AS rx{i}, {100 + 20 * i} + 200 * e[{i + 18}] AS ry{i}" for i in range(17)
) + " FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e, " + ", ".join(f"least(1, 5 * abs(embedding[{i + 35}]::DOUBLE)) AS c{i}" for i in range(17)) + " FROM embeddings))"
VEL = "ve AS (SELECT *, " + ", ".join(f"sqrt(pow(x{i} - lag(x{i}) OVER o, 2) + pow(y{i} - lag(y{i}) OVER o, 2)) AS v{i}" for i in range(17)) + " FROM po WINDOW o AS (PARTITION BY w ORDER BY t))"
STEP = "(" + " + ".join(f"coalesce(v{i}, 0)" for i in range(17)) + ") / nullif(" + " + ".join(f"(v{i} IS NOT NULL)::INT" for i in range(17)) + ", 0)"
SEEN = "(" + " + ".join(f"CASE WHEN x{J[n]} IS NOT NULL THEN {m} ELSE 0.0 END" for n, m in frames.MASS.items()) + ")"


def centre_sql(p: str) -> str:
    return f"CASE WHEN {SEEN} > 0.6 THEN (" + " + ".join(f"coalesce({p}{J[n]} * {m}, 0)" for n, m in frames.MASS.items()) + f") / {SEEN} END"


LS, RS, LW, RW, LH, RH, LE, RE = (J[n] for n in ("left_shoulder", "right_shoulder", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_elbow", "right_elbow"))
HIP = f"((y{LH} + y{RH}) / 2)"
TORSO = f"({HIP} - y0)"


def rise_sql(w: int) -> str:
    """Spark's greatest skips nulls, as DuckDB's does."""
    return f"greatest(0.0, ({HIP} - y{w}) / CASE WHEN {TORSO} >= 10 THEN {TORSO} END)"


def pair_sql(a: int, b: int) -> str:
    return f"0.5 * (1 / (1 + abs(y{a} - y{b}) / 100) + 1 / (1 + abs(x{a} - x{b}) / 100))"


ARMS = "(" + " + ".join(f"coalesce(v{J[n]}, 0)" for n in ("left_wrist", "right_wrist", "left_elbow", "right_elbow")) + ") / 4"
SHAPE = f"""sp AS (SELECT *, {STEP} AS step, {centre_sql('x')} AS cx, {centre_sql('y')} AS cy, sqrt(pow(x{LS} - x{RS}, 2) + pow(y{LS} - y{RS}, 2)) AS sw, sqrt(pow(x{LW} - x{RW}, 2) + pow(y{LW} - y{RW}, 2)) AS hands, {rise_sql(LW)} AS lh, {rise_sql(RW)} AS rh,
 ({pair_sql(LS, RS)} + {pair_sql(LE, RE)} + {pair_sql(LW, RW)} + {pair_sql(LH, RH)}) / 4 AS sym, sqrt(pow(x{LS} - x{LE}, 2) + pow(y{LS} - y{LE}, 2)) AS arm, {ARMS} AS arms FROM ve), ac AS (SELECT *, step - lag(step) OVER (PARTITION BY w ORDER BY t) AS sv FROM sp)"""
POSE_OUT = ["speed", "speed_max", "acceleration", "static_share", "com_x", "com_y", "com_x_std", "com_y_std", "hand_separation", "symmetry", "left_hand_mean_height", "right_hand_max_height", "left_low", "left_mid", "left_high", "left_upper_arm", "arms_speed"]


@query(f"""WITH {POSE}, {VEL}, {SHAPE} SELECT w, round(avg(step), 3) AS speed, round(max(step), 3) AS speed_max, round(avg(abs(sv)), 3) AS acceleration, round(avg((coalesce(step, 0) <= 2)::INT), 3) AS static_share, round(avg(cx), 3) AS com_x, round(avg(cy), 3) AS com_y,
 round(stddev_pop(cx), 3) AS com_x_std, round(stddev_pop(cy), 3) AS com_y_std, round(avg(hands / sw) FILTER (sw > 5), 3) AS hand_separation, round(avg(sym), 3) AS symmetry, round(avg(lh), 3) AS left_hand_mean_height, round(max(rh), 3) AS right_hand_max_height,
 round(count(*) FILTER (lh >= 0 AND lh < 0.3) / count(*), 3) AS left_low, round(count(*) FILTER (lh >= 0.3 AND lh < 0.8) / count(*), 3) AS left_mid, round(count(*) FILTER (lh >= 0.8 AND lh < 1.5) / count(*), 3) AS left_high, round(avg(arm / sw) FILTER (sw > 5), 3) AS left_upper_arm, round(avg(arms), 3) AS arms_speed FROM ac GROUP BY 1""")
def pose_window_features(spark, sf):
    """Temporal, spatial, zone and symmetry features of pose windows (those that the SQL repeats)."""
    return rounded(frames.pose_features(poses(spark, sf), ["w"], "t").select("w", *POSE_OUT), ["w"], 3)


@query()
def pose_all_features(spark, sf):
    """Every pose output of a window."""
    return rounded(frames.pose_features(poses(spark, sf), ["w"], "t"), ["w"], 6)


PM = lambda ids: f"coalesce(({' + '.join(f'CASE WHEN c{i} > 0.5 THEN c{i} ELSE 0.0 END' for i in ids)}) / nullif({' + '.join(f'(c{i} > 0.5)::INT' for i in ids)}, 0), 0)"
ALL4 = " AND ".join(f"c{i} > 0.5" for i in (LS, RS, LH, RH))


@query(f"""WITH {POSE} SELECT t, round({PM(range(17))}, 5) AS overall_confidence, round({PM(range(5))}, 5) AS face_confidence, round({PM(range(5, 11))}, 5) AS upper_body_confidence, round({PM(range(11, 17))}, 5) AS lower_body_confidence,
 round(CASE WHEN {ALL4} THEN degrees(atan2((rx{LS} + rx{RS}) / 2 - (rx{LH} + rx{RH}) / 2, (ry{LH} + ry{RH}) / 2 - (ry{LS} + ry{RS}) / 2)) END, 4) AS body_angle FROM po""")
def pose_frame_metrics(spark, sf):
    m = frames.pose_metrics()
    return poses(spark, sf).select("t", *[F.round(c, 4 if n == "body_angle" else 5).alias(n) for n, c in m.items()])


@query("""WITH s AS (SELECT o_orderkey AS frame, l_discount * 10 AS conf, l_quantity AS area FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
 SELECT frame, round(avg(conf), 5) AS avg_confidence, round(max(conf), 5) AS max_confidence, round(min(conf), 5) AS min_confidence, count(*) FILTER (round(conf, 6) > 0.8) AS high_conf_count, count(*) FILTER (round(conf, 6) > 0.5 AND round(conf, 6) <= 0.8) AS med_conf_count, count(*) FILTER (round(conf, 6) <= 0.5) AS low_conf_count,
 count(*) AS total_segments, round(avg(area), 5) AS avg_mask_area, max(area) AS max_mask_area, min(area) AS min_mask_area FROM s GROUP BY 1""")
def segmentation_metrics(spark, sf):
    """Segments of a frame: an order's lines, a discount as confidence and a quantity as mask area."""
    s = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), F.round(F.col("l_discount") * 10, 6).alias("conf"), F.col("l_quantity").alias("area"))
    s = s.join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("frame")), "frame")
    return rounded(frames.segment_metrics(s, ["frame"], "conf", "area"), ["frame"], 5)


@query("""WITH c AS (SELECT label AS w, vec_id AS t, unnest(range(0, 34)) AS pos, embedding::DOUBLE[] AS e FROM embeddings), v AS (SELECT w, t, pos, CASE WHEN pos % 2 = 0 THEN 100 + 300 * e[pos // 2 + 1] ELSE 100 + 20 * (pos // 2) + 200 * e[pos // 2 + 18] END AS v FROM c),
 m AS (SELECT *, max(v) OVER (PARTITION BY w, pos ORDER BY t ROWS 19 PRECEDING) AS m, row_number() OVER (PARTITION BY w, pos ORDER BY t) AS i, count(*) OVER (PARTITION BY w, pos) AS n FROM v)
 SELECT w, pos::INT AS pos, round(sum(CASE WHEN n < 20 THEN v WHEN i >= 20 THEN m END), 3) AS v FROM m GROUP BY 1, 2""")
def pose_raw_vector(spark, sf):
    d = frames.pose_vector(poses(spark, sf), ["w"], "t")
    return d.select("w", F.posexplode("v").alias("pos", "v")).select("w", "pos", F.round("v", 3).alias("v"))
