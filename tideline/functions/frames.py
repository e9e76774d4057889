"""Features of frame series: radar, thermal, person depth and pose. A frame is an array column; cells are exploded once and
aggregated by window, so that a feature is a built-in aggregate wherever it can be one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import correlation

#: Temperature bands in degrees.
BANDS = {"human": (30.0, 40.0), "hot": (45.0, 150.0), "cold": (-5.0, 15.0), "ambient": (16.0, 29.0)}
#: Joints of a pose, and weights of its centre of mass.
JOINTS = ["nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle"]
MASS = {"left_shoulder": 0.1, "right_shoulder": 0.1, "left_elbow": 0.05, "right_elbow": 0.05, "left_hip": 0.25, "right_hip": 0.25, "nose": 0.2}
SURE = 0.3


def cells(frames: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """keys, y, x, v of every cell of a two-dimensional frame."""
    rows = frames.select(*keys, F.posexplode(frame).alias("y", "_row"))
    return rows.select(*keys, "y", F.posexplode("_row").alias("x", "v")).withColumn("v", F.col("v").cast("double"))


def doppler_features(frames: DataFrame, window: list[str], t: str, det: str) -> DataFrame:
    """window, range_profile, velocity_profile: clutter-free range energy, and per velocity its mean and deviation over range, summed over time."""
    c = cells(frames, [*window, t], det)  # y: range, x: velocity
    r = c.groupBy(*window, t, "y").agg(F.max("v").alias("v"))
    clear = F.greatest(F.lit(0.0), F.col("v") - F.avg("v").over(Window.partitionBy(*window, "y")))
    r = r.withColumn("v", clear).groupBy(*window, "y").agg(F.sum("v").alias("v"))
    v = c.groupBy(*window, t, "x").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    v = v.groupBy(*window, "x").agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
    in_order = lambda i, *cs: F.array_sort(F.collect_list(F.struct(i, *cs)))
    r = r.groupBy(*window).agg(F.transform(in_order("y", "v"), lambda e: e["v"]).alias("range_profile"))
    v = v.groupBy(*window).agg(in_order("x", "m", "s").alias("_v"))
    v = v.select(*window, F.concat(F.transform("_v", lambda e: e["m"]), F.transform("_v", lambda e: e["s"])).alias("velocity_profile"))
    return r.join(v, window)


def thermal_frames(frames: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Per frame: area share, hottest value and centroid of each band; negative readings are missing but in the cold band's range."""
    c = cells(frames, keys, frame)
    aggs = [F.count("*").alias("size"), F.max("x").alias("_w"), F.max("y").alias("_h"), (F.max("v") - F.min("v")).alias("spread")]
    for name, (lo, hi) in BANDS.items():
        inside = F.col("v").between(lo, hi)
        aggs += [F.count_if(inside).alias(f"{name}_n"), F.coalesce(F.max(F.when(inside, F.col("v"))), F.lit(lo)).alias(f"{name}_max"), F.avg(F.when(inside, F.col("x"))).alias(f"{name}_x"), F.avg(F.when(inside, F.col("y"))).alias(f"{name}_y")]
    d = c.groupBy(*keys).agg(*aggs)
    return d.withColumn("diagonal", F.sqrt((F.col("_w") + 1) ** 2 + (F.col("_h") + 1) ** 2)).drop("_w", "_h")


def thermal_features(frames: DataFrame, window: list[str], t: str, frame: str) -> DataFrame:
    """Signatures, proximity, dynamics and motion of a window's thermal frames."""
    f = thermal_frames(frames, [*window, t], frame)
    w = Window.partitionBy(*window).orderBy(t)
    far = lambda a, b: F.sqrt((F.col(f"{a}_x") - F.col(f"{b}_x")) ** 2 + (F.col(f"{a}_y") - F.col(f"{b}_y")) ** 2) / F.col("diagonal")
    last = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    f = f.withColumns({"near_hot": F.coalesce(far("human", "hot"), F.lit(1.0)), "near_cold": F.coalesce(far("human", "cold"), F.lit(1.0)), "_hx": last("human_x"), "_hy": last("human_y")})
    f = f.withColumns({"_step": F.sqrt((F.col("_hx") - F.lag("_hx").over(w)) ** 2 + (F.col("_hy") - F.lag("_hy").over(w)) ** 2), "_jump": F.abs(F.col("spread") - F.lag("spread").over(w)), "_i": F.row_number().over(w)})
    mean, sd = F.avg("human_n"), F.stddev_pop("human_n")
    return f.groupBy(*window).agg(
        *[(F.avg(f"{b}_n") / F.first("size")).alias(f"{b}_area") for b in BANDS], *[F.max(f"{b}_max").alias(f"{b}_max") for b in BANDS],
        F.min("near_hot").alias("near_hot"), F.min("near_cold").alias("near_cold"), (F.min("near_hot") < 0.1).alias("touch_hot"), (F.min("near_cold") < 0.1).alias("touch_cold"),
        F.coalesce(F.regr_slope("spread", "_i"), F.lit(0.0)).alias("trend"), F.max("spread").alias("spread_max"), F.avg("spread").alias("spread_mean"), F.coalesce(F.max("_jump"), F.lit(0.0)).alias("jump_max"),
        (F.coalesce(F.sum("_step"), F.lit(0.0)) / F.count("*")).alias("movement"), F.when(mean > 0, 1 - sd / mean).otherwise(0.0).alias("stability"),
    )


def components(mask: np.ndarray) -> int:
    """Four-connected regions of a mask."""
    left, n = mask.copy(), 0
    for y, x in zip(*np.nonzero(mask)):
        if not left[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        left[y, x] = False
        while todo:
            a, b = todo.pop()
            for i, j in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and left[i, j]:
                    left[i, j] = False
                    todo.append((i, j))
    return n


def hot_regions(frame: Column, lo: float = BANDS["hot"][0], hi: float = BANDS["hot"][1]) -> Column:
    """Number of connected hot regions of a frame; the one thermal feature that has no aggregate form."""

    def count(frames: pd.Series) -> pd.Series:
        out = []
        for f in frames:
            a = np.array([np.asarray(r, float) for r in f]) if f is not None and len(f) else np.zeros((0, 0))
            out.append(components((a >= lo) & (a <= hi)) if a.size else 0)
        return pd.Series(out)

    return F.pandas_udf(count, "int")(frame)


def compactness(frames: DataFrame, keys: list[str], frame: str, band: str = "hot") -> DataFrame:
    """keys, compactness: the share of its bounding box that a frame's band fills; 0 where there is none of it."""
    lo, hi = BANDS[band]
    c = cells(frames, keys, frame).withColumn("_in", F.col("v").between(lo, hi))
    y, x = F.when(F.col("_in"), F.col("y")), F.when(F.col("_in"), F.col("x"))
    return c.groupBy(*keys).agg(F.coalesce(F.count_if("_in") / ((F.max(y) - F.min(y) + 1) * (F.max(x) - F.min(x) + 1)), F.lit(0.0)).alias("compactness"))


def person_depth(depth: Column, mask: Column) -> Column:
    """The depth frame where the person's mask is set, else 0."""
    return F.zip_with(depth, mask, lambda r, m: F.zip_with(r, m, lambda v, b: F.when(b > 0, v.cast("double")).otherwise(0.0)))


def depth_features(frames: DataFrame, window: list[str], t: str, frame: str) -> DataFrame:
    """Shape and motion of a person's depth frames in a window: area, depths, aspect, motion, displacement, turns, spread, entropy."""
    c = cells(frames, [*window, t], frame)
    top = c.groupBy(*window, "y", "x").agg(F.max("v").alias("top"))
    shape = top.where("top > 0.05").groupBy(*window).agg(
        F.count("*").alias("area"), F.avg("top").alias("depth_mean"), F.max("top").alias("depth_max"), F.var_pop("top").alias("depth_var"),
        ((F.max("y") - F.min("y") + 1) / (F.max("x") - F.min("x") + 1)).alias("aspect"), F.avg("x").alias("_cx"), F.avg("y").alias("_cy"), F.log2(F.count("*")).alias("entropy"),
    )
    spread = top.where("top > 0.05").join(shape.select(*window, "_cx", "_cy"), window).groupBy(*window).agg(F.avg(F.sqrt((F.col("x") - F.col("_cx")) ** 2 + (F.col("y") - F.col("_cy")) ** 2)).alias("gyration"))
    wc = Window.partitionBy(*window, "y", "x").orderBy(t)
    moved = c.withColumn("_d", F.abs(F.col("v") - F.lag("v").over(wc))).groupBy(*window, "y", "x").agg(F.avg("_d").alias("d"), F.max("v").alias("top"))
    moved = moved.groupBy(*window).agg(F.count_if((F.col("d") > 0.1) & (F.col("top") > 0.05)).alias("active"), F.coalesce(F.avg(F.when((F.col("d") > 0.1) & (F.col("top") > 0.05), F.col("d"))), F.lit(0.0)).alias("motion"))
    centre = c.where("v > 0.05").groupBy(*window, t).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    w = Window.partitionBy(*window).orderBy(t)
    s = centre.withColumns({"dx": F.col("cx") - F.lag("cx").over(w), "dy": F.col("cy") - F.lag("cy").over(w)}).withColumn("step", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).withColumn("angle", F.atan2("dy", "dx"))
    turn = F.abs(F.col("angle") - F.lag("angle").over(w))
    s = s.withColumn("turn", F.least(turn, 2 * np.pi - turn))
    s = s.groupBy(*window).agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("displacement"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("velocity"), F.count_if((F.col("step") > 0.5) & (F.col("turn") > np.pi / 4)).alias("turns"),
        F.coalesce(F.sum(F.abs("dy")) / (F.sum(F.abs("dx")) + 1e-6), F.lit(0.0)).alias("vertical"),
    )
    return shape.drop("_cx", "_cy").join(spread, window, "left").join(moved, window, "left").join(s, window, "left")


def depth_percentiles(frames: DataFrame, window: list[str], frame: str) -> DataFrame:
    c = cells(frames, window, frame).where("v > 0")
    p = lambda q: F.percentile("v", F.lit(q))
    return c.groupBy(*window).agg(p(0.01).alias("p01"), p(0.99).alias("p99"), (p(0.99) - p(0.01)).alias("range"))


def joint(name: str, part: str, joints: str = "joints") -> Column:
    """A coordinate of a joint, null unless its confidence is over 0.3."""
    j = F.get(F.col(joints), F.lit(JOINTS.index(name)))
    return F.when(j["conf"] > SURE, j[part])


def pose_features(frames: DataFrame, window: list[str], t: str, joints: str = "joints") -> DataFrame:
    """Temporal, spatial, zone and symmetry features of a window's poses (first person of a frame)."""
    xy = lambda n: (joint(n, "x", joints), joint(n, "y", joints))
    w = Window.partitionBy(*window).orderBy(t)
    d = frames
    for n in JOINTS:
        x, y = xy(n)
        d = d.withColumns({f"{n}_x": x, f"{n}_y": y})
    d = d.withColumns({f"{n}_v": F.sqrt((F.col(f"{n}_x") - F.lag(f"{n}_x").over(w)) ** 2 + (F.col(f"{n}_y") - F.lag(f"{n}_y").over(w)) ** 2) for n in JOINTS})
    some = [F.col(f"{n}_v") for n in JOINTS]
    count = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in some), F.lit(0))
    step = sum((F.coalesce(v, F.lit(0.0)) for v in some), F.lit(0.0)) / F.nullif(count, F.lit(0))
    seen = sum((F.when(F.col(f"{n}_x").isNotNull(), F.lit(m)).otherwise(0.0) for n, m in MASS.items()), F.lit(0.0))
    centre = lambda p: F.when(F.round(seen, 9) > 0.6, sum((F.coalesce(F.col(f"{n}_{p}") * m, F.lit(0.0)) for n, m in MASS.items()), F.lit(0.0)) / seen)
    mid = lambda a, b, p: (F.col(f"{a}_{p}") + F.col(f"{b}_{p}")) / 2
    shoulders = F.sqrt((F.col("left_shoulder_x") - F.col("right_shoulder_x")) ** 2 + (F.col("left_shoulder_y") - F.col("right_shoulder_y")) ** 2)
    hip = mid("left_hip", "right_hip", "y")
    torso = hip - F.col("nose_y")
    height = lambda side: F.greatest(F.lit(0.0), (hip - F.col(f"{side}_wrist_y")) / F.when(torso >= 10, torso))
    pair = lambda n: 0.5 * (1 / (1 + F.abs(F.col(f"left_{n}_y") - F.col(f"right_{n}_y")) / 100) + 1 / (1 + F.abs(F.col(f"left_{n}_x") - F.col(f"right_{n}_x")) / 100))
    hands = F.sqrt((F.col("left_wrist_x") - F.col("right_wrist_x")) ** 2 + (F.col("left_wrist_y") - F.col("right_wrist_y")) ** 2)
    d = d.withColumns({"_step": step, "com_x": centre("x"), "com_y": centre("y"), "_sw": shoulders, "_lh": height("left"), "_rh": height("right"), "_hands": hands,
        "_sym": (pair("shoulder") + pair("elbow") + pair("wrist") + pair("hip")) / 4, "_lean": F.atan2(mid("left_shoulder", "right_shoulder", "x") - mid("left_hip", "right_hip", "x"), hip - mid("left_shoulder", "right_shoulder", "y"))})
    length = lambda a, b: F.sqrt((F.col(f"{a}_x") - F.col(f"{b}_x")) ** 2 + (F.col(f"{a}_y") - F.col(f"{b}_y")) ** 2)

    def bend(a: str, b: str, c: str) -> Column:
        """The angle at b in degrees."""
        along = (F.col(f"{a}_x") - F.col(f"{b}_x")) * (F.col(f"{c}_x") - F.col(f"{b}_x")) + (F.col(f"{a}_y") - F.col(f"{b}_y")) * (F.col(f"{c}_y") - F.col(f"{b}_y"))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(along, length(a, b) * length(b, c))))))

    limbs = {}
    for side in ("left", "right"):
        sh, el, wr, hi, kn, an = (f"{side}_{n}" for n in ("shoulder", "elbow", "wrist", "hip", "knee", "ankle"))
        wide = F.when(F.col("_sw") > 5, F.col("_sw"))
        limbs |= {
            f"{side}_upper_arm": length(sh, el) / wide, f"{side}_forearm": length(el, wr) / wide, f"{side}_thigh": length(hi, kn) / wide, f"{side}_shin": length(kn, an) / wide,
            f"{side}_reach": F.abs(F.col(f"{wr}_x") - F.col(f"{sh}_x")) / wide, f"{side}_elbow_angle": bend(sh, el, wr), f"{side}_knee_angle": bend(hi, kn, an), f"{side}_shoulder_angle": bend(hi, sh, el),
        }
    d = d.withColumns(limbs)
    d = d.withColumns({"_still": (F.coalesce(F.col("_step"), F.lit(0.0)) <= 2.0).cast("int"), "_sv": F.col("_step") - F.lag("_step").over(w)})
    zone = lambda h, lo, hi: F.count_if((F.col(h) >= lo) & (F.col(h) < hi)) / F.count("*")
    out = [F.avg("_step").alias("speed"), F.max("_step").alias("speed_max"), F.avg(F.abs("_sv")).alias("acceleration"), F.avg("_still").alias("static_share"),
        F.avg("com_x").alias("com_x"), F.avg("com_y").alias("com_y"), F.stddev_pop("com_x").alias("com_x_std"), F.stddev_pop("com_y").alias("com_y_std"),
        F.avg(F.when(F.col("_sw") > 5, F.col("_hands") / F.col("_sw"))).alias("hand_separation"), F.avg("_sym").alias("symmetry"), F.avg("_lean").alias("lean"), correlation("left_wrist_v", "right_wrist_v").alias("bilateral")]
    out += [F.avg(n).alias(n) for n in limbs] + [F.stddev_pop(n).alias(f"{n}_std") for n in limbs if n.endswith("_angle")]
    for side, h in (("left", "_lh"), ("right", "_rh")):
        out += [F.avg(h).alias(f"{side}_hand_mean_height"), F.max(h).alias(f"{side}_hand_max_height"), zone(h, 0.0, 0.3).alias(f"{side}_low"), zone(h, 0.3, 0.8).alias(f"{side}_mid"), zone(h, 0.8, 1.5).alias(f"{side}_high"), F.count_if(F.col(h) > 1.1).alias(f"{side}_overhead")]
    for g, ns in {"arms": ("left_wrist", "right_wrist", "left_elbow", "right_elbow"), "legs": ("left_knee", "right_knee", "left_ankle", "right_ankle"), "head": ("nose", "left_ear", "right_ear")}.items():
        out.append(F.avg(sum((F.coalesce(F.col(f"{n}_v"), F.lit(0.0)) for n in ns), F.lit(0.0)) / len(ns)).alias(f"{g}_speed"))
    return d.groupBy(*window).agg(*out)


#: Joints of the parts whose confidence is told, and from where a joint counts.
PARTS = {"face": range(5), "upper_body": range(5, 11), "lower_body": range(11, 17)}
SEEN = 0.5


def pose_metrics(joints: str = "joints") -> dict[str, Column]:
    """Of one frame's first person: mean confidence of the joints that are seen, of all and by part (0 without any), and the body's angle from the vertical in degrees."""

    def sure(which: Column) -> Column:
        seen = F.filter(F.transform(which, lambda j: j["conf"].cast("double")), lambda c: c > SEEN)
        return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, c: a + c) / F.size(seen)).otherwise(0.0)

    at = lambda n, p: F.when(F.get(F.col(joints), F.lit(JOINTS.index(n)))["conf"] > SEEN, F.get(F.col(joints), F.lit(JOINTS.index(n)))[p].cast("double"))
    mid = lambda part, p: (at(f"left_{part}", p) + at(f"right_{part}", p)) / 2
    angle = F.degrees(F.atan2(mid("shoulder", "x") - mid("hip", "x"), mid("hip", "y") - mid("shoulder", "y")))
    parts = {f"{name}_confidence": sure(F.slice(joints, at_.start + 1, len(at_))) for name, at_ in PARTS.items()}
    return {"overall_confidence": sure(F.col(joints)), **parts, "body_angle": angle}


def segment_metrics(found: DataFrame, keys: list[str], confidence: str, area: str) -> DataFrame:
    """keys and what a frame's segments are like: their confidences, how many are sure (over .8), fair (over .5) or not, and their mask areas."""
    c, a = F.col(confidence), F.col(area)
    return found.groupBy(*keys).agg(
        F.avg(c).alias("avg_confidence"), F.max(c).alias("max_confidence"), F.min(c).alias("min_confidence"), F.count_if(c > 0.8).alias("high_conf_count"),
        F.count_if((c > 0.5) & (c <= 0.8)).alias("med_conf_count"), F.count_if(c <= 0.5).alias("low_conf_count"), F.count("*").alias("total_segments"),
        F.avg(a).alias("avg_mask_area"), F.max(a).alias("max_mask_area"), F.min(a).alias("min_mask_area"),
    )


def pose_vector(frames: DataFrame, window: list[str], t: str, k: int = 20, joints: str = "joints") -> DataFrame:
    """window, v: the largest value of every coordinate over runs of k frames, summed (all frames if there are fewer)."""
    flat = frames.select(*window, t, F.posexplode(F.flatten(F.transform(joints, lambda j: F.array(j["x"], j["y"])))).alias("pos", "v"))
    w = Window.partitionBy(*window, "pos").orderBy(t)
    d = flat.withColumns({"_m": F.max("v").over(w.rowsBetween(-(k - 1), 0)), "_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*window, "pos"))})
    d = d.groupBy(*window, "pos").agg(F.sum(F.when(F.col("_n") < k, F.col("v")).when(F.col("_i") >= k, F.col("_m"))).alias("v"))
    return d.groupBy(*window).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("v"))
