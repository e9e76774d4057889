"""Catalogue: labels, votes, similarity, evaluation, vectors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.scalar import cosine
from tideline.operators import evaluate, joins, labels, neighbours, quantiles, timeops
from tideline.plans.registry import EV, events, query, r6, read

SOFT = f"{EV}, w AS (SELECT user_id, t // 86400000000 AS day, event_type AS label, value FROM ev), m AS (SELECT user_id, day, label, max(value) AS c FROM w GROUP BY 1, 2, 3)"


def daily(spark, sf):
    return events(spark, sf).select("user_id", F.floor(F.col("t") / 86_400_000_000).alias("day"), F.col("event_type").alias("label"), "value", "event_id", "t")


@query(f"WITH {SOFT} SELECT user_id, day, label, round(coalesce(c / nullif(sum(c) OVER (PARTITION BY user_id, day), 0), 0), 6) AS p FROM m")
def soft_labels(spark, sf):
    d = labels.soft_labels(daily(spark, sf), ["user_id", "day"], "label", "value")
    return d.select("user_id", "day", "label", r6("p").alias("p"))


VOTE = f"""{EV}, q AS (SELECT user_id, event_id % 5 AS model, event_type AS label, sum(value) AS v FROM ev GROUP BY 1, 2, 3), p AS (SELECT *, round(v / sum(v) OVER (PARTITION BY user_id, model), 9) AS prob FROM q)"""


def model_probabilities(spark, sf):
    q = read(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 5).alias("model"), F.col("event_type").alias("label")).agg(F.sum("value").alias("v"))
    return q.withColumn("prob", F.round(F.col("v") / F.sum("v").over(Window.partitionBy("user_id", "model")), 9))


@query(f"""WITH {VOTE}, o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id, model ORDER BY prob DESC, label) = 1), c AS (SELECT user_id, label, count(*) AS votes, avg(prob) AS conf FROM o GROUP BY 1, 2)
 SELECT user_id, label AS prediction, votes, round(conf, 6) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, label) = 1""")
def majority_vote(spark, sf):
    d = labels.majority_vote(model_probabilities(spark, sf), ["user_id"], ["model"], "label", "prob")
    return d.select("user_id", "prediction", "votes", r6("confidence").alias("confidence"))


@query(f"""WITH {VOTE}, s AS (SELECT user_id, label, sum(prob) AS s FROM p GROUP BY 1, 2), n AS (SELECT *, s / sum(s) OVER (PARTITION BY user_id) AS m FROM s)
 SELECT user_id, label AS prediction, round(m, 6) AS confidence FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(m, 12) DESC, label) = 1""")
def mean_prob_ensemble(spark, sf):
    d = labels.mean_vote(model_probabilities(spark, sf), ["user_id"], "label", "prob")
    return d.select("user_id", "prediction", r6("confidence").alias("confidence"))


KNN = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
 d AS (SELECT q.vec_id AS q, q.label AS truth, v.vec_id AS n, v.label, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM q JOIN v ON q.vec_id <> v.vec_id),
 r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, n) <= 5),
 k AS (SELECT q, truth, label AS prediction, count(*) AS votes FROM r GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) = 1)"""


def knn(spark, sf, k=5):
    """k nearest neighbours by cosine of every query vector (id divisible by 50) among all rows, and their vote."""
    v = read(spark, sf, "embeddings")
    near = neighbours.nearest_in_table(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", k)
    named = near.join(v.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q").join(v.select(F.col("vec_id").alias("n"), "label"), "n")
    votes = named.groupBy("q", "truth", "label").agg(F.count("*").alias("votes"))
    return joins.first_match(votes, ["q"], [F.desc("votes"), "label"]).select("q", "truth", F.col("label").alias("prediction"), "votes")


@query(f"WITH {KNN} SELECT q, truth, prediction, votes FROM k")
def knn_vote(spark, sf):
    return knn(spark, sf)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, sf):
    return evaluate.confusion(read(spark, sf, "labels"), "quality", "toxic")


EVAL = "p AS (SELECT source AS truth, CASE WHEN doc_id % 4 = 0 THEN 'src' || (doc_id % 20) ELSE source END AS pred FROM documents)"
PRF = f"""{EVAL}, l AS (SELECT truth AS label FROM p UNION SELECT pred FROM p),
 s AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label AND pred = label) AS tp, (SELECT count(*) FROM p WHERE truth <> label AND pred = label) AS fp, (SELECT count(*) FROM p WHERE truth = label AND pred <> label) AS fn FROM l),
 m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM s)"""


def guessed(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(F.col("source").alias("truth"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))).otherwise(F.col("source")).alias("pred"))


@query(f"WITH {PRF} SELECT label, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM m")
def prf_metrics(spark, sf):
    d = evaluate.per_label(guessed(spark, sf), "truth", "pred")
    return d.select("label", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query(f"WITH {PRF} SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, sum(tp + fn)::BIGINT AS n FROM m")
def macro_metrics(spark, sf):
    d = evaluate.summary(guessed(spark, sf), "truth", "pred")
    return d.select(*[r6(c).alias(c) for c in d.columns if c != "n"], "n")


NORM = """g AS (SELECT doc_id, lang AS truth, source AS pred, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 2 = 0 THEN ['src1', source] ELSE ['src2', 'src3'] END AS mapped FROM documents)"""


@query(f"WITH {NORM} SELECT doc_id, CASE WHEN len(mapped) = 0 THEN truth WHEN list_contains(mapped, pred) THEN pred ELSE mapped[1] END AS truth, list_contains(mapped, pred) AS overlap FROM g")
def normalized_eval(spark, sf):
    i = F.col("doc_id")
    mapped = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 2 == 0, F.array(F.lit("src1"), F.col("source"))).otherwise(F.array(F.lit("src2"), F.lit("src3")))
    d = read(spark, sf, "documents").withColumn("mapped", mapped)
    return d.select("doc_id", labels.normalize_truth(F.col("lang"), F.col("mapped"), F.col("source")).alias("truth"), F.array_contains("mapped", F.col("source")).alias("overlap"))


@query(f"""WITH {EV}, f AS (SELECT *, user_id % 5 AS p, CASE WHEN t - lag(t) OVER w <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id % 5 ORDER BY t, event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY p ORDER BY t, event_id) AS ord FROM f), m AS (SELECT p, ord, arg_max(event_type, (t, event_id)) AS model FROM s GROUP BY 1, 2), g AS (SELECT p, ord FROM s GROUP BY 1, 2 HAVING count(*) > 20)
 SELECT m.p AS participant, m.ord::BIGINT AS session, count(*) AS n, round(avg((s.event_type = m.model)::INT), 6) AS accuracy FROM m JOIN g ON m.p = g.p AND g.ord > m.ord JOIN s ON s.p = g.p AND s.ord = g.ord GROUP BY 1, 2""")
def forward_eval(spark, sf):
    """A model of each session (its last label) judged on all later sessions of over 20 rows."""
    from tideline.operators import pairing

    d = events(spark, sf).withColumn("participant", F.col("user_id") % 5)
    s = timeops.sessionize(d, ["participant"], "t", 3_600_000_000, ["event_id"])
    m = s.groupBy("participant", "session").agg(F.max_by("event_type", F.struct("t", "event_id")).alias("model"))
    d = pairing.forward_scores(s, ["participant"], "session", "event_type", m, 20)
    return d.select("participant", "session", "n", r6(F.col("correct") / F.col("n")).alias("accuracy"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY pos) AS e FROM m GROUP BY 1)
 SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.e, b.e), 5) AS sim FROM c a JOIN c b ON a.label < b.label""")
def cosine_pairs(spark, sf):
    """Similarity of all pairs of the label vocabulary: cosines of the labels' mean vectors."""
    x = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    m = x.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    c = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("e"))
    a, b = c.toDF("a", "ea"), c.toDF("b", "eb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("ea"), F.col("eb")), 5).alias("sim"))


COMP = """n AS (SELECT n_nationkey AS i, n_regionkey AS r, n_name AS nm FROM nation),
 c AS (SELECT a.i AS a, b.i AS b, (left(a.nm, 1) = left(b.nm, 1))::INT AS verb, (a.r = b.r)::INT AS target, (length(a.nm) = length(b.nm))::INT AS instruments, (a.i % 2 = b.i % 2)::INT AS intent, (a.i % 3 = b.i % 3)::INT AS transfer, (a.i % 5 = b.i % 5)::INT AS workflow, a.i % 4 = 0 OR b.i % 4 = 0 AS generic FROM n a JOIN n b ON a.i < b.i),
 s AS (SELECT a, b, round(CASE WHEN generic THEN 0.1 * verb + 0.4 * target ELSE 0.2 * verb + 0.3 * target END + 0.1 * instruments + 0.15 * intent + 0.15 * transfer + 0.1 * workflow, 6) AS sim FROM c)"""


@query(f"WITH {COMP} SELECT a, b, sim::DOUBLE AS sim FROM s UNION ALL SELECT b, a, sim::DOUBLE FROM s UNION ALL SELECT i, i, 1.0::DOUBLE FROM n")
def composite_similarity(spark, sf):
    """The similarity matrix of a label vocabulary (25 names), as a long table."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("r"), F.col("n_name").alias("nm"))
    a, b = n.toDF("a", "ra", "na"), n.toDF("b", "rb", "nb")
    d = a.join(b, F.col("a") < F.col("b"))
    eq = lambda x, y: (x == y).cast("int").cast("double")
    i, j = F.col("a"), F.col("b")
    parts = {
        "verb": eq(F.substring("na", 1, 1), F.substring("nb", 1, 1)), "target": eq(F.col("ra"), F.col("rb")), "instruments": eq(F.length("na"), F.length("nb")),
        "intent": eq(i % 2, j % 2), "transfer": eq(i % 3, j % 3), "workflow": eq(i % 5, j % 5),
    }
    d = d.select("a", "b", r6(labels.composite_similarity(parts, (i % 4 == 0) | (j % 4 == 0))).alias("sim"))
    return labels.mirrored(d, "a", "b", "sim", n.select("i"))


@query(f"WITH {COMP}, f AS (SELECT a, b, sim::DOUBLE AS sim FROM s UNION ALL SELECT b, a, sim::DOUBLE FROM s UNION ALL SELECT i, i, 1.0::DOUBLE FROM n), p AS (SELECT s_suppkey, s_nationkey AS a, s_suppkey % 25 AS b FROM supplier) SELECT round(avg(sim), 6) AS accuracy, min(sim) AS low, max(sim) AS high, count(*) AS n FROM p JOIN f ON p.a = f.a AND p.b = f.b")
def semantic_accuracy(spark, sf):
    p = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 25).alias("b"))
    d = p.join(composite_similarity(spark, sf), ["a", "b"])
    return d.agg(r6(F.avg("sim")).alias("accuracy"), F.min("sim").alias("low"), F.max("sim").alias("high"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
 SELECT pos, round(var_pop(v), 5) AS var, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 5) AS iqr, var_pop(v) > 1e-6 AND quantile_cont(v, 0.75) - quantile_cont(v, 0.25) > 1e-6 AS stable FROM x GROUP BY 1""")
def stable_dimensions(spark, sf):
    x = read(spark, sf, "embeddings").select(F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    q = quantiles.quantiles(x, ["pos"], "v", {"q1": 0.25, "q3": 0.75})
    d = x.groupBy("pos").agg(F.var_pop("v").alias("var")).join(q, "pos").withColumn("iqr", F.col("q3") - F.col("q1"))
    return d.select("pos", F.round("var", 5).alias("var"), F.round("iqr", 5).alias("iqr"), F.expr("var > 1e-6 and iqr > 1e-6").alias("stable"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), s AS (SELECT pos, median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS q FROM x GROUP BY 1)
 SELECT vec_id, round(sum(abs((v - m) / nullif(q, 0))), 4) AS size FROM x JOIN s ON x.pos = s.pos GROUP BY 1""")
def robust_scale(spark, sf):
    x = read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    s = quantiles.quantiles(x, ["pos"], "v", {"m": 0.5, "q1": 0.25, "q3": 0.75}).withColumn("q", F.col("q3") - F.col("q1"))
    return x.join(s, "pos").groupBy("vec_id").agg(F.round(F.sum(F.abs((F.col("v") - F.col("m")) / F.nullif("q", F.lit(0.0)))), 4).alias("size"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE label <> 9) SELECT label, pos, round(avg(v), 5) AS mean FROM x GROUP BY 1, 2""")
def centroids(spark, sf):
    """Mean vectors of the clusters; label 9 stands for noise, which has none."""
    x = read(spark, sf, "embeddings").where("label <> 9").select("label", F.posexplode("embedding").alias("pos", "v"))
    return x.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


QUALITY = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label <> 9), c AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1, 2),
 d AS (SELECT x.vec_id, x.label, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN c ON x.label = c.label AND x.pos = c.pos GROUP BY 1, 2),
 g AS (SELECT label, count(*) AS n, avg(d) AS d FROM d GROUP BY 1), z AS (SELECT count(*) FILTER (label = 9) / count(*) AS noise FROM embeddings)"""


@query(f"""WITH {QUALITY}, s AS (SELECT count(*) AS k, avg(CASE WHEN n < 5 THEN 0 ELSE least(1, n / 10.0) END) AS size, avg(exp(-d)) AS tight FROM g)
 SELECT k, round(0.3 * CASE WHEN k < 5 THEN k / 5.0 WHEN k > 40 THEN 1 - (k - 40) / 40.0 ELSE 1 END + 0.2 * size + 0.2 * tight + 0.2 * CASE WHEN noise <= 0.3 THEN 1 ELSE greatest(0, 1 - (noise - 0.3) / 0.2) END + 0.1 * 1.0, 5) AS quality FROM s, z""")
def cluster_quality(spark, sf):
    """Composite quality of a clustering: label 9 stands for noise, confidence is 1."""
    from tideline.operators.clustering import quality

    d = read(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("label"), F.lit(1.0).alias("confidence"), "embedding")
    return quality(d, "vec_id", "label", "confidence", "embedding", most_noise=0.3).select("k", F.round("quality", 5).alias("quality"))


CB = """n AS (SELECT n_nationkey AS i, n_regionkey AS r, n_nationkey + 1 AS w FROM nation), k AS (SELECT unnest(range(2, 6)) AS k), m AS (SELECT i, k, r % k AS c, w FROM n, k),
 pr AS (SELECT a.k, a.c, avg(1.0 / (1 + abs(a.i - b.i))) AS s FROM m a JOIN m b ON a.k = b.k AND a.c = b.c AND a.i < b.i GROUP BY 1, 2), sz AS (SELECT k, c, sum(w) AS w, count(*) AS n FROM m GROUP BY 1, 2),
 co AS (SELECT sz.k, coalesce(sum(s * w) FILTER (n > 1) / sum(w) FILTER (n > 1), 0) AS cohesion FROM sz LEFT JOIN pr ON sz.k = pr.k AND sz.c = pr.c GROUP BY 1),
 ba AS (SELECT k, -sum(p * log2(p)) AS balance FROM (SELECT k, w / sum(w) OVER (PARTITION BY k) AS p FROM sz) GROUP BY 1), cb AS (SELECT co.k, cohesion, balance FROM co JOIN ba ON co.k = ba.k)"""


@query(f"""WITH {CB}, s AS (SELECT k, 0.5 * (cohesion - min(cohesion) OVER ()) / (max(cohesion) OVER () - min(cohesion) OVER ()) + 0.5 * (balance - min(balance) OVER ()) / (max(balance) OVER () - min(balance) OVER ()) AS score FROM cb)
 SELECT k, round(score, 6) AS score FROM s QUALIFY row_number() OVER (ORDER BY round(score, 12) DESC, k) = 1""")
def cohesion_balance_score(spark, sf):
    """Number of groups for a label vocabulary: weighted cohesion against balance of sizes."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("r"), (F.col("n_nationkey") + 1).alias("w"))
    m = n.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(5)))).withColumn("c", F.col("r") % F.col("k"))
    pairs = m.select("k", "c", "i").join(m.select("k", "c", F.col("i").alias("j")), ["k", "c"]).where("i < j")
    sim = pairs.groupBy("k", "c").agg(F.avg(1 / (1 + F.abs(F.col("i") - F.col("j")))).alias("s"))
    size = m.groupBy("k", "c").agg(F.sum("w").alias("w"), F.count("*").alias("n")).join(sim, ["k", "c"], "left")
    many = F.when(F.col("n") > 1, F.col("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("k"))
    d = size.withColumn("p", share).groupBy("k").agg(F.coalesce(F.sum(F.col("s") * many) / F.sum(many), F.lit(0.0)).alias("cohesion"), (-F.sum(F.col("p") * F.log2("p"))).alias("balance"))
    d = labels.choose_k(d.withColumn("all", F.lit(1)), ["all"], "k", "cohesion", "balance", 0.5)
    return d.select("k", r6("score").alias("score"))
