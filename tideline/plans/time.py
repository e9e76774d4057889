"""Catalogue: windows, sessions, gaps, grids and series in event time."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.config import DAY, HOUR, Density
from tideline.functions.scalar import correlation, micros
from tideline.operators import joins, select, timeops
from tideline.plans.registry import EV, events, query, r6, read

HOP = """hop AS (SELECT user_id, e AS window_end, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS low, max(value) AS high, sum(value) AS total
  FROM (SELECT *, unnest(generate_series((t // 21600000000 + 1) * 21600000000, (t // 21600000000 + 4) * 21600000000, 21600000000)) AS e FROM ev) GROUP BY 1, 2)"""


@query(f"WITH {EV}, {HOP} SELECT user_id, window_end, n, round(mean, 6) AS mean, round(sd, 4) AS sd, low, high, round(total, 6) AS total FROM hop")
def hop_window_stats(spark, sf):
    d = timeops.hop_stats(events(spark, sf), ["user_id"], "t", "value", DAY, 6 * HOUR)
    return d.select("user_id", "window_end", "n", r6("mean").alias("mean"), F.round("sd", 4).alias("sd"), "low", "high", r6("total").alias("total"))


@query(f"""WITH {EV}, a AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS a FROM ev),
 w AS (SELECT *, unnest(generate_series(greatest(0, (t - a) // 21600000000 - 3), (t - a) // 21600000000)) AS k FROM a)
 SELECT user_id, a + k * 21600000000 + 86400000000 AS window_end, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM w GROUP BY user_id, a, k""")
def hop_window_anchored(spark, sf):
    d = events(spark, sf)
    # a least time for each user, which is combined before it is shuffled; readings themselves are panes before they move
    d = d.join(d.groupBy("user_id").agg(F.min("t").alias("a")), "user_id")
    d = timeops.hop_stats(d, ["user_id"], "t", "value", DAY, 6 * HOUR, anchor="a")
    return d.select("user_id", "window_end", "n", r6("mean").alias("mean"), "low", "high")


@query(f"""WITH {EV}, b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) // 10 AS block FROM ev)
 SELECT user_id, block, count(*) AS n, count(*) = 10 AS is_full, round(avg(value), 6) AS mean, min(t) AS first_t, max(t) AS last_t FROM b GROUP BY 1, 2""")
def tumbling_blocks(spark, sf):
    d = timeops.tumbling_blocks(events(spark, sf), ["user_id"], ["t", "event_id"], 10)
    return d.groupBy("user_id", "block").agg(F.count("*").alias("n"), (F.count("*") == 10).alias("is_full"), r6(F.avg("value")).alias("mean"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""WITH {EV}, f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM f)
 SELECT user_id, session::BIGINT AS session, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM s GROUP BY user_id, session""")
def session_gap_sessions(spark, sf):
    d = timeops.sessionize(events(spark, sf), ["user_id"], "t", 6 * HOUR, ["event_id"])
    return d.groupBy("user_id", "session").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"))


SPAN = "sp AS (SELECT o_custkey AS k, o_orderkey AS o, l_linenumber AS ln, epoch_us(o_orderdate) AS s, epoch_us(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
MERGED = f"""{SPAN}, m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, o, ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp),
 i AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e, o, ln ROWS UNBOUNDED PRECEDING) AS session FROM m),
 se AS (SELECT k, session::BIGINT AS session, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY 1, 2)"""


def spans(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("s"))
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", micros(F.col("l_shipdate")).alias("e"))
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), "s", "e")


def order_sessions(spark, sf):
    return timeops.merge_intervals(spans(spark, sf), ["k"], "s", "e", also=["o", "ln"])


@query(f"WITH {MERGED} SELECT k, session, s, e, n FROM se")
def interval_merge_sessions(spark, sf):
    return order_sessions(spark, sf).select("k", "session", "s", "e", "n")


@query(f"""WITH {MERGED} SELECT k, printf('c%d-%02d-%d_%d', k, (row_number() OVER (PARTITION BY k ORDER BY s) - 1)::INT, s, e) AS session_key, round((e - s) / 1000000.0, 6) AS duration_s
 FROM se WHERE e - s BETWEEN 86400000000 AND 10000000000000""")
def session_duration_filter(spark, sf):
    d = order_sessions(spark, sf).where((F.col("e") - F.col("s")).between(DAY, 10_000_000_000_000))
    d = timeops.ordered(d, ["k"], ["s"])
    key = F.format_string("c%d-%02d-%d_%d", F.col("k"), (F.col("rn") - 1).cast("int"), F.col("s"), F.col("e"))
    return d.select("k", key.alias("session_key"), F.round((F.col("e") - F.col("s")) / 1e6, 6).alias("duration_s"))


@query(f"""WITH {SPAN}, b AS (SELECT k, min(s) - 864000000000 AS lo, max(e) + 864000000000 AS hi FROM sp GROUP BY 1),
 c AS (SELECT sp.k, greatest(s, lo) AS s, least(e, hi) AS e, lo, hi, o, ln FROM sp JOIN b ON sp.k = b.k WHERE greatest(s, lo) < least(e, hi)),
 w AS (SELECT *, coalesce(max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS r, lead(s) OVER (PARTITION BY k ORDER BY s, e) AS nx FROM c)
 SELECT k, 'clip' AS kind, greatest(s, r) AS "start", e AS "end" FROM w WHERE greatest(s, r) < e
 UNION ALL SELECT k, 'gap', r, s FROM w WHERE s - r > 86400000000
 UNION ALL SELECT k, 'gap', greatest(r, e), hi FROM w WHERE nx IS NULL AND hi - greatest(r, e) > 86400000000""")
def gap_plan(spark, sf):
    d = spans(spark, sf)
    w = Window.partitionBy("k")
    d = d.withColumn("lo", F.min("s").over(w) - 10 * DAY).withColumn("hi", F.max("e").over(w) + 10 * DAY)
    return timeops.gap_plan(d, ["k"], "s", "e", DAY, "lo", "hi")


GRID = f"{EV}, h AS (SELECT user_id, t // 21600000000 * 21600000000 AS g, avg(value) AS v FROM ev GROUP BY 1, 2), b AS (SELECT user_id, min(g) AS lo, max(g) AS hi FROM h GROUP BY 1), gr AS (SELECT user_id, unnest(generate_series(lo - 21600000000, hi + 21600000000, 21600000000)) AS g FROM b)"
LERP = """j AS (SELECT gr.user_id, gr.g, h.v FROM gr LEFT JOIN h ON gr.user_id = h.user_id AND gr.g = h.g),
 n AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN v IS NOT NULL THEN g END IGNORE NULLS) OVER a AS g0, first_value(v IGNORE NULLS) OVER z AS v1, first_value(CASE WHEN v IS NOT NULL THEN g END IGNORE NULLS) OVER z AS g1 FROM j
  WINDOW a AS (PARTITION BY user_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def on_grid(spark, sf):
    h = events(spark, sf).groupBy("user_id", (F.floor(F.col("t") / (6 * HOUR)) * 6 * HOUR).alias("g")).agg(F.avg("value").alias("v"))
    b = h.groupBy("user_id").agg((F.min("g") - 6 * HOUR).alias("lo"), (F.max("g") + 6 * HOUR).alias("hi"))
    return timeops.grid(b, "lo", "hi", 6 * HOUR, "g").select("user_id", "g").join(h, ["user_id", "g"], "left")


@query(f"WITH {GRID}, {LERP} SELECT user_id, g, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (g - g0) / (g1 - g0) END, 6) AS v FROM n")
def grid_interpolate(spark, sf):
    return timeops.interpolate(on_grid(spark, sf), ["user_id"], "g", "v", "x").select("user_id", "g", r6("x").alias("v"))


@query(f"WITH {GRID}, {LERP} SELECT user_id, g, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (g - g0) / (g1 - g0) END, 6) AS v FROM n")
def grid_interpolate_clamped(spark, sf):
    return timeops.interpolate(on_grid(spark, sf), ["user_id"], "g", "v", "x", edge="clamp").select("user_id", "g", r6("x").alias("v"))


@query(f"WITH {EV} SELECT event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 6) AS filled FROM ev")
def forward_fill(spark, sf):
    d = events(spark, sf).withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return timeops.forward_fill(d, ["user_id"], ["t", "event_id"], "p", "filled").select("event_id", r6("filled").alias("filled"))


@query(f"WITH {EV} SELECT a.event_id, b.value AS last_error FROM ev a ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.t > b.t")
def asof_last_value(spark, sf):
    return joins.asof(events(spark, sf), ["user_id"], ["t", "event_id"], "value", "event_type = 'error'", "last_error").select("event_id", "last_error")


@query(f"""WITH {EV}, d AS (SELECT *, value - lag(value) OVER w AS d1, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d2, lag(value) OVER w AS p FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
 SELECT event_id, round(d1, 6) AS velocity, round(d2, 6) AS jerk FROM d""")
def diff_jerk(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    v = F.col("value")
    return events(spark, sf).select("event_id", r6(v - F.lag(v).over(w)).alias("velocity"), r6(v - 2 * F.lag(v).over(w) + F.lag(v, 2).over(w)).alias("jerk"))


@query(f"""WITH {EV}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS c FROM ev), s AS (SELECT *, sign(round(c, 9)) AS s, lag(sign(round(c, 9))) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM c)
 SELECT user_id, count(*) FILTER (s * p < 0) AS crossings, round(count(*) FILTER (s * p < 0) / count(*), 6) AS rate FROM s GROUP BY 1""")
def zero_crossings(spark, sf):
    d = events(spark, sf).withColumn("s", F.signum(F.round(F.col("value") - F.avg("value").over(Window.partitionBy("user_id")), 9)))
    d = d.withColumn("p", F.lag("s").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    n = F.count_if(F.col("s") * F.col("p") < 0)
    return d.groupBy("user_id").agg(n.alias("crossings"), r6(n / F.count("*")).alias("rate"))


@query(f"""WITH {EV}, f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM f), r AS (SELECT user_id, event_type, run, count(*) AS length FROM g GROUP BY 1, 2, 3)
 SELECT user_id, event_type, max(length) AS longest, count(*) AS runs FROM r GROUP BY 1, 2""")
def state_runs(spark, sf):
    d = timeops.runs(events(spark, sf), ["user_id"], ["t", "event_id"], "event_type")
    return d.groupBy("user_id", "event_type").agg(F.max("length").alias("longest"), F.count("*").alias("runs"))


@query(f"""WITH {EV}, s AS (SELECT *, (value > 20)::INT AS a, lag((value > 20)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM ev)
 SELECT user_id, coalesce(sum(abs(a - b)), 0)::BIGINT AS transitions, sum(a)::BIGINT AS active FROM s GROUP BY 1""")
def state_transitions(spark, sf):
    d = events(spark, sf).withColumn("a", (F.col("value") > 20).cast("int"))
    d = d.withColumn("b", F.lag("a").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    return d.groupBy("user_id").agg(F.coalesce(F.sum(F.abs(F.col("a") - F.col("b"))), F.lit(0)).cast("bigint").alias("transitions"), F.sum("a").alias("active"))


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS c, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS 19 PRECEDING) AS m FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
 SELECT event_id, m AS rolling_max FROM r WHERE rn >= 20""")
def rolling_max(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    d = timeops.ordered(events(spark, sf), ["user_id"], ["t", "event_id"]).withColumn("rolling_max", F.max("value").over(w.rowsBetween(-19, 0)))
    return d.where("rn >= 20").select("event_id", "rolling_max")


@query(f"WITH {EV} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS 29 PRECEDING), 6) AS average FROM ev")
def moving_average(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(-29, 0)
    return events(spark, sf).select("event_id", r6(F.avg("value").over(w)).alias("average"))


@query(f"WITH {EV}, l AS (SELECT user_id, value AS x, lag(value, 5) OVER (PARTITION BY user_id ORDER BY t, event_id) AS y FROM ev) SELECT user_id, round(coalesce(CASE WHEN isnan(corr(x, y)) THEN NULL ELSE corr(x, y) END, 0), 5) AS r FROM l GROUP BY 1 HAVING count(y) > 5")
def autocorrelation(spark, sf):
    d = events(spark, sf).select("user_id", F.col("value").alias("x"), F.lag("value", 5).over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("y"))
    return d.groupBy("user_id").agg(F.round(correlation("x", "y"), 5).alias("r"), F.count("y").alias("n")).where("n > 5").drop("n")


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM ev)
 SELECT user_id, (rn - 1) // greatest(1, c // 4) AS segment, count(*) AS n, round(avg(value), 6) AS mean FROM r GROUP BY 1, 2""")
def temporal_segments(spark, sf):
    d = timeops.segments(events(spark, sf), ["user_id"], ["t", "event_id"], 4)
    return d.groupBy("user_id", "segment").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(f"""WITH {EV}, e AS (SELECT user_id, (t // 3600000000 + 1) * 3600000000 AS e, event_type AS label FROM ev), s AS (SELECT *, unnest(range(1, 11)) AS i FROM e)
 SELECT user_id, e - i * 3600000000 AS window_end, arg_max(label, (e, label)) AS label FROM s GROUP BY 1, 2""")
def label_backprojection(spark, sf):
    d = events(spark, sf).select("user_id", ((F.floor(F.col("t") / HOUR) + 1) * HOUR).alias("e"), F.col("event_type").alias("label"))
    return timeops.back_project(d, ["user_id"], "e", "label", HOUR, 10)


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev),
 f AS (SELECT user_id, rn, value AS m FROM r WHERE rn = 1 UNION ALL SELECT r.user_id, r.rn, 0.9 * f.m + 0.1 * r.value FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
 SELECT user_id, round(m, 6) AS m FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1""")
def decayed_mean(spark, sf):
    return timeops.decayed_mean(events(spark, sf), ["user_id"], ["t", "event_id"], "value", 0.9, "m").select("user_id", r6("m").alias("m"))


@query(f"""WITH RECURSIVE {EV}, g AS (SELECT user_id, min(t) AS t FROM ev GROUP BY 1 UNION ALL
 SELECT user_id, nt FROM (SELECT g.user_id, (SELECT min(ev.t) FROM ev WHERE ev.user_id = g.user_id AND ev.t > g.t + 86400000000) AS nt FROM g) WHERE nt IS NOT NULL) SELECT user_id, t FROM g""")
def greedy_spacing(spark, sf):
    return select.greedy_spacing(events(spark, sf), ["user_id"], "t", DAY)


TOPK = """k AS (SELECT user_id, event_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn FROM ev),
 g AS (SELECT user_id, 1 AS rn, [t] AS ts, [event_id] AS ids FROM k WHERE rn = 1 UNION ALL
  SELECT k.user_id, k.rn, CASE WHEN len(ts) < 5 AND len(list_filter(ts, lambda y: abs(y - k.t) <= 172800000000)) = 0 THEN list_append(ts, k.t) ELSE ts END,
   CASE WHEN len(ts) < 5 AND len(list_filter(ts, lambda y: abs(y - k.t) <= 172800000000)) = 0 THEN list_append(ids, k.event_id) ELSE ids END FROM g JOIN k ON k.user_id = g.user_id AND k.rn = g.rn + 1),
 z AS (SELECT user_id, ids FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)"""


@query(f"WITH RECURSIVE {EV}, {TOPK} SELECT z.user_id, ev.event_id, ev.t, ev.value FROM (SELECT user_id, unnest(ids) AS event_id FROM z) z JOIN ev ON ev.event_id = z.event_id")
def greedy_topk_spaced(spark, sf):
    return select.greedy_topk(events(spark, sf), ["user_id"], "t", "value", "event_id", 5, 2 * DAY)


@query("""WITH m AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) AS s, epoch_us(max(l_shipdate)) AS e, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
 f AS (SELECT *, unnest(range(0, n)) AS frame FROM m) SELECT k, frame, s + (frame * (e - s)) // n AS frame_t FROM f""")
def frame_timestamps(spark, sf):
    d = spans(spark, sf).groupBy(F.col("o").alias("k"), "s").agg(F.max("e").alias("e"), F.count("*").alias("n"))
    return timeops.frame_times(d, "s", "e", "n").select("k", "frame", "frame_t")


THRESHOLD = """th AS (SELECT user_id, quantile_cont(mean, 0.25) - (quantile_cont(mean, 0.75) - quantile_cont(mean, 0.25)) AS a, avg(mean) - 1.5 * stddev_pop(mean) AS b, quantile_cont(mean, 0.2) AS c FROM hop GROUP BY 1),
 md AS (SELECT user_id, list_sort([a, b, c])[2] AS m FROM th),
 kk AS (SELECT hop.user_id, round(any_value(m), 6) AS threshold, greatest(1, least(count(*) FILTER (round(mean, 9) < round(m, 9)), 20)) AS k FROM hop JOIN md ON hop.user_id = md.user_id GROUP BY 1)"""


def scored(spark, sf):
    return timeops.hop_stats(events(spark, sf), ["user_id"], "t", "value", DAY, 6 * HOUR).select("user_id", "window_end", "mean")


def with_thresholds(d, keys, score, most=Density.most):
    """Adds m, the median of three low-score limits of a row's key, and k, how many scores of the key lie under it, from 1 to `most`.

    Ranks come from one sort by key that spills, and nothing of a key is buffered; the scores are dealt once.
    """
    all_ = Window.partitionBy(*keys)
    d = d.withColumns({"_rn": F.row_number().over(all_.orderBy(score)) - 1, "_n": F.count("*").over(all_)})

    def at(p):
        """The value at the rank (n - 1) * p, between the two nearest ones, as percentile() has it."""
        r = (F.col("_n") - 1) * p
        low, high = (F.max(F.when(F.col("_rn") == f(r), F.col(score))).over(all_) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(r) - r) * low + (r - F.floor(r)) * high)

    d = d.withColumns({"_a": at(0.25), "_b": at(0.75), "_c": at(0.2), "_mean": F.avg(score).over(all_), "_sd": F.stddev_pop(score).over(all_)})
    three = F.array(F.col("_a") - (F.col("_b") - F.col("_a")), F.col("_mean") - 1.5 * F.col("_sd"), F.col("_c"))
    d = d.withColumn("m", F.element_at(F.array_sort(three), 2))
    under = F.count_if(F.round(score, 9) < F.round("m", 9)).over(all_)
    return d.withColumn("k", F.greatest(F.lit(1), F.least(under, F.lit(most)))).drop("_rn", "_n", "_a", "_b", "_c", "_mean", "_sd")


def thresholds(d, keys, score, most=Density.most):
    """keys, m, k of every key with a score."""
    return with_thresholds(d, keys, score, most).groupBy(*keys).agg(F.max("m").alias("m"), F.max("k").alias("k"))


@query(f"WITH {EV}, {HOP}, {THRESHOLD} SELECT user_id, threshold, k FROM kk")
def robust_thresholds(spark, sf):
    return thresholds(scored(spark, sf).where("mean is not null"), ["user_id"], "mean").select("user_id", r6("m").alias("threshold"), "k")


@query(f"""WITH RECURSIVE {EV}, {HOP}, {THRESHOLD}, k AS (SELECT hop.user_id, window_end AS t, round(mean, 6) AS v, k, row_number() OVER (PARTITION BY hop.user_id ORDER BY round(mean, 6), window_end) AS rn FROM hop JOIN kk ON hop.user_id = kk.user_id),
 g AS (SELECT user_id, 1 AS rn, [t] AS ts FROM k WHERE rn = 1 UNION ALL
  SELECT k.user_id, k.rn, CASE WHEN len(ts) < k.k AND len(list_filter(ts, lambda y: abs(y - k.t) <= 86400000000)) = 0 THEN list_append(ts, k.t) ELSE ts END FROM g JOIN k ON k.user_id = g.user_id AND k.rn = g.rn + 1),
 z AS (SELECT user_id, unnest(ts) AS t FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1))
 SELECT z.user_id, z.t AS window_end, k.v AS score FROM z JOIN k ON z.user_id = k.user_id AND z.t = k.t""")
def key_moments(spark, sf):
    """Anomalies: hop-window scores, robust threshold, data-driven k, greedy choice in ascending score with spacing."""
    d = with_thresholds(scored(spark, sf).where("mean is not null"), ["user_id"], "mean")
    d = d.select("user_id", "window_end", r6("mean").alias("score"), "k", F.col("window_end").alias("i"))
    return select.greedy_topk(d, ["user_id"], "window_end", "score", "i", F.col("k"), DAY).select("user_id", "window_end", "score")
