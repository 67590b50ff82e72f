"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import similarity as sim
from textloom.queries.base import query
from textloom.sources.views import vectors, with_views

DOT = "list_dot_product({}.v, {}.v)"


def _parts(spark, d):
    v = vectors(spark, d).withColumnRenamed("vec_id", "id")
    return v.where("NOT is_ref").select("id", "class_label", "v"), v.where("is_ref").select("id", "class_label", "v")


SIMS = """c AS (SELECT * FROM vectors WHERE NOT is_ref), r AS (SELECT * FROM vectors WHERE is_ref),
s AS (SELECT c.vec_id, c.class_label, c.class_label = r.class_label AS own, list_dot_product(c.v, r.v) AS sim FROM c, r),
a AS (SELECT vec_id, class_label, max(sim) FILTER (own) AS best, avg(sim) FILTER (own) AS mean_own, avg(sim) FILTER (NOT own) AS mean_other,
  max(sim) FILTER (NOT own) AS best_other FROM s GROUP BY 1, 2)"""


@query(with_views("vectors", f", {SIMS} SELECT vec_id, class_label, round(best, 6) AS sim FROM a QUALIFY row_number() OVER (PARTITION BY class_label ORDER BY round(best, 9) DESC, vec_id) <= 50"))
def nn_reference_topk(spark, d):
    c, r = _parts(spark, d)
    scored = sim.reference_similarity(c, r)
    return sim.top_scored(scored, ["class_label"], "sim", 50).select(F.col("id").alias("vec_id"), "class_label", F.round("sim", 6).alias("sim"))


@query(with_views("vectors", f", {SIMS} SELECT vec_id, class_label, round(mean_own - mean_other, 6) AS gap FROM a QUALIFY row_number() OVER (PARTITION BY class_label ORDER BY round(mean_own - mean_other, 9) DESC, vec_id) <= 50"))
def gap_topk_mean(spark, d):
    c, r = _parts(spark, d)
    scored = sim.class_gap(c, r, "mean")
    return sim.top_scored(scored, ["class_label"], "gap", 50).select(F.col("id").alias("vec_id"), "class_label", F.round("gap", 6).alias("gap"))


@query(with_views("vectors", f", {SIMS} SELECT vec_id, class_label, round(best - 0.5 * best_other, 6) AS gap FROM a QUALIFY row_number() OVER (PARTITION BY class_label ORDER BY round(best - 0.5 * best_other, 9) DESC, vec_id) <= 50"))
def gap_topk_max(spark, d):
    c, r = _parts(spark, d)
    scored = sim.class_gap(c, r, "max", 0.5)
    return sim.top_scored(scored, ["class_label"], "gap", 50).select(F.col("id").alias("vec_id"), "class_label", F.round("gap", 6).alias("gap"))


@query(with_views("vectors", """SELECT a.class_label, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_sim FROM vectors a JOIN vectors b ON a.class_label = b.class_label AND a.vec_id <> b.vec_id GROUP BY 1"""))
def pairwise_mean_sim(spark, d):
    c = sim.centroids(vectors(spark, d), ["class_label"])
    return c.select("class_label", F.round(sim.pair_mean(F.col("mean"), F.col("n"), F.col("squares")), 6).alias("mean_sim"))


@query(with_views("vectors", """SELECT a.class_label AS a, a.is_ref AS a_ref, b.class_label AS b, b.is_ref AS b_ref, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_sim
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4"""))
def class_similarity_4way(spark, d):
    c = sim.centroids(vectors(spark, d), ["class_label", "is_ref"])
    a, b = c.toDF("a", "a_ref", "na", "qa", "ma"), c.toDF("b", "b_ref", "nb", "qb", "mb")
    same = (F.col("a") == F.col("b")) & (F.col("a_ref") == F.col("b_ref"))
    both = a.crossJoin(F.broadcast(b))  # four rows each
    value = F.when(same, sim.pair_mean(F.col("ma"), F.col("na"), F.col("qa"))).otherwise(sim.dot(F.col("ma"), F.col("mb")))
    return both.select("a", "a_ref", "b", "b_ref", F.round(value, 6).alias("mean_sim"))


@query(with_views("vectors", "SELECT a.label AS a, b.label AS b, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_sim FROM vectors a, vectors b GROUP BY 1, 2"))
def label_sim_matrix(spark, d):
    c = sim.centroids(vectors(spark, d), ["label"]).select("label", "mean")
    both = c.toDF("a", "ma").crossJoin(F.broadcast(c.toDF("b", "mb")))  # one row for each label
    return both.select("a", "b", F.round(sim.dot(F.col("ma"), F.col("mb")), 6).alias("mean_sim"))


@query(with_views("vectors", """, p AS (SELECT a.class_label, a.vec_id AS a, b.vec_id AS b, round(1 - list_dot_product(a.v, b.v), 9) AS distance FROM vectors a JOIN vectors b ON a.class_label = b.class_label AND a.vec_id < b.vec_id)
  SELECT class_label, a, b, round(distance, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY class_label ORDER BY distance DESC, a, b) = 1"""))
def farthest_pair(spark, d):
    """The two most distant of all vectors of a class (X17)."""
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), "class_label", "v")
    return sim.farthest_pair(v, ["class_label"]).withColumn("distance", F.round("distance", 6))


@query(with_views("vectors", """, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(1 - list_dot_product(a.v, b.v), 9) AS distance FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id < b.vec_id)
  SELECT label, a, b, round(distance, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance DESC, a, b) = 1"""))
def farthest_pair_all(spark, d):
    """The two most distant of all vectors of each label."""
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), "label", "v")
    return sim.farthest_pair(v, ["label"]).withColumn("distance", F.round("distance", 6))


KNN = """n AS (SELECT q.vec_id, q.class_label, o.class_label AS other FROM vectors q JOIN vectors o ON q.vec_id <> o.vec_id WHERE q.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, o.v), 9) DESC, o.vec_id) <= 15),
o AS (SELECT vec_id, class_label, avg(CAST(other <> class_label AS INT)) AS score FROM n GROUP BY 1, 2)"""


def _overlap(spark, d):
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), "class_label", "v")
    return sim.overlap_scores(v, v.where("id % 100 = 0"), 15)


@query(with_views("vectors", f", {KNN} SELECT vec_id, class_label, round(score, 6) AS score FROM o"))
def knn_overlap(spark, d):
    return _overlap(spark, d).select(F.col("id").alias("vec_id"), "class_label", F.round("score", 6).alias("score"))


def _every_overlap(label: str) -> str:
    return f""", n AS (SELECT q.vec_id, q.{label}, o.{label} AS other FROM vectors q JOIN vectors o ON q.vec_id <> o.vec_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, o.v), 9) DESC, o.vec_id) <= 15),
  o AS (SELECT vec_id, {label}, avg(CAST(other <> {label} AS INT)) AS score FROM n GROUP BY 1, 2)
  SELECT vec_id, {label} FROM (SELECT *, count(*) OVER (PARTITION BY {label}) AS n, row_number() OVER (PARTITION BY {label} ORDER BY round(score, 9), vec_id) AS low FROM o) WHERE low > round_even(n * CAST(0.3 AS DOUBLE), 0)"""


@query(with_views("vectors", _every_overlap("class_label")))
def overlap_filter(spark, d):
    """Every row is scored against all others, in blocks, and the least overlapping of each class are left out (X12)."""
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), "class_label", "v")
    return sim.drop_lowest(sim.overlap_scores(v, v, 15), 0.3).select(F.col("id").alias("vec_id"), "class_label")


@query(with_views("vectors", """, x AS (SELECT label, class_label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM vectors),
  d AS (SELECT label, i, stddev_pop(x) AS sd, avg(x) AS m FROM x GROUP BY 1, 2)
  SELECT label, round(avg(sd), 6) AS spread, round(sum(m * m), 6) AS mean_sim FROM d GROUP BY 1"""))
def seq_covariates(spark, d):
    x = vectors(spark, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.stddev_pop("x").alias("sd"), F.avg("x").alias("m"))
    return x.groupBy("label").agg(F.round(F.avg("sd"), 6).alias("spread"), F.round(F.sum(F.col("m") * F.col("m")), 6).alias("mean_sim"))


@query(with_views("vectors", """, c AS (SELECT vec_id, v FROM vectors WHERE class_label = 'Yes' AND NOT is_ref),
  g AS (SELECT 1 AS place, (SELECT min(vec_id) FROM c) AS vec_id, [(SELECT min(vec_id) FROM c)] AS chosen
    UNION ALL SELECT place + 1, nxt, list_append(chosen, nxt) FROM (SELECT g.place, g.chosen, (
      SELECT c.vec_id FROM c JOIN c k ON list_contains(g.chosen, k.vec_id) WHERE NOT list_contains(g.chosen, c.vec_id)
      GROUP BY c.vec_id ORDER BY round(least(1.0, min(1 - list_dot_product(c.v, k.v))), 9) DESC, c.vec_id LIMIT 1) AS nxt FROM g WHERE g.place < 6))
  SELECT CAST(place AS INT) AS place, vec_id FROM g"""))
def maximin_select(spark, d):
    c = _parts(spark, d)[0].where("class_label = 'Yes'")
    return sim.diverse(c, ["class_label"], 6).select("place", F.col("id").alias("vec_id"))


def _greedy(keep: int, score: str, mid: str) -> str:
    """The mid rows of each class of the greatest score, then keep of them: the smallest id, then always the farthest from all chosen."""
    return f""", {SIMS}, h AS (SELECT vec_id, class_label, row_number() OVER (PARTITION BY class_label ORDER BY round({score}, 9) DESC NULLS LAST, vec_id) AS place, count(*) OVER (PARTITION BY class_label) AS n FROM a),
  x AS MATERIALIZED (SELECT vec_id, h.class_label, v, count(*) OVER (PARTITION BY h.class_label) AS n, row_number() OVER (PARTITION BY h.class_label ORDER BY vec_id) AS nth FROM h JOIN vectors USING (vec_id) WHERE h.place <= {mid}),
  g AS (SELECT class_label, 1 AS place, min(vec_id) AS vec_id, [min(vec_id)] AS chosen FROM x WHERE n > {keep} GROUP BY 1
    UNION ALL SELECT class_label, place + 1, nxt, list_append(chosen, nxt) FROM (SELECT g.class_label, g.place, g.chosen, (
      SELECT o.vec_id FROM x o JOIN x k ON k.class_label = o.class_label AND list_contains(g.chosen, k.vec_id) WHERE o.class_label = g.class_label AND NOT list_contains(g.chosen, o.vec_id)
      GROUP BY o.vec_id ORDER BY round(least(1.0, min(1 - list_dot_product(o.v, k.v))), 9) DESC, o.vec_id LIMIT 1) AS nxt FROM g WHERE g.place < {keep}))
  SELECT class_label, vec_id, CAST(place AS INT) AS place FROM g UNION ALL SELECT class_label, vec_id, CAST(nth AS INT) FROM x WHERE n <= {keep}"""


@query(with_views("vectors", _greedy(40, "best", "least(n, 40 + floor((n - 40) / 2))")))
def filter_pipeline(spark, d):
    return sim.filter_pipeline(*_parts(spark, d), target=40).select("class_label", F.col("id").alias("vec_id"), "place")


@query(with_views("vectors", """, p AS (SELECT a.label = b.label AS own, list_dot_product(a.v, b.v) AS s FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id)
  SELECT round(avg(s) FILTER (own), 6) AS same, round(avg(s) FILTER (NOT own), 6) AS other, round(avg(s) FILTER (own) - avg(s) FILTER (NOT own), 6) AS gap FROM p"""))
def contrastive_metrics(spark, d):
    return sim.contrast(vectors(spark, d), "label").select(*[F.round(c, 6).alias(c) for c in ("same", "other", "gap")])


@query(with_views("vectors", """, p AS (SELECT a.class_label AS c, b.class_label AS r, avg(list_dot_product(a.v, b.v)) AS s FROM vectors a, vectors b WHERE NOT a.is_ref AND b.is_ref GROUP BY 1, 2),
  g AS (SELECT max(s) FILTER (c = 'Yes' AND r = 'Yes') AS sp_rp, max(s) FILTER (c = 'Yes' AND r = 'No') AS sp_rn, max(s) FILTER (c = 'No' AND r = 'No') AS sn_rn, max(s) FILTER (c = 'No' AND r = 'Yes') AS sn_rp FROM p)
  SELECT round(sp_rp, 6) AS sp_rp, round(sp_rn, 6) AS sp_rn, round(sn_rn, 6) AS sn_rn, round(sn_rp, 6) AS sn_rp, round(sp_rp - sp_rn, 6) AS pos_gap, round(sn_rn - sn_rp, 6) AS neg_gap FROM g"""))
def gap_report(spark, d):
    c = sim.centroids(vectors(spark, d), ["class_label", "is_ref"])
    s, r = c.where("NOT is_ref").select(F.col("class_label").alias("c"), F.col("mean").alias("ms")), c.where("is_ref").select(F.col("class_label").alias("r"), F.col("mean").alias("mr"))
    p = s.crossJoin(F.broadcast(r)).select("c", "r", sim.dot(F.col("ms"), F.col("mr")).alias("s"))  # two rows each
    of = {n: F.max(F.when((F.col("c") == x) & (F.col("r") == y), F.col("s"))) for n, x, y in (("sp_rp", "Yes", "Yes"), ("sp_rn", "Yes", "No"), ("sn_rn", "No", "No"), ("sn_rp", "No", "Yes"))}
    one = p.agg(*[v.alias(n) for n, v in of.items()]).withColumns({"pos_gap": F.col("sp_rp") - F.col("sp_rn"), "neg_gap": F.col("sn_rn") - F.col("sn_rp")})
    return one.select(*[F.round(n, 6).alias(n) for n in one.columns])


@query(with_views("vectors", """SELECT a.class_label, round(sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_dot_product(a.v, b.v) END) / count(*), 6) AS mean_sim FROM vectors a JOIN vectors b ON a.class_label = b.class_label GROUP BY 1"""))
def diversity_report(spark, d):
    """The mean similarity over all n * n pairs with a zeroed diagonal, unlike pairwise_mean_sim."""
    c = sim.centroids(vectors(spark, d), ["class_label"])
    n, m = F.col("n"), F.col("mean")
    return c.select("class_label", F.round((n * n * sim.dot(m, m) - F.col("squares")) / (n * n), 6).alias("mean_sim"))


@query(with_views("vectors", """, s AS (SELECT a.label, b.vec_id, max(list_dot_product(a.v, b.v)) AS best FROM vectors b, vectors a WHERE b.is_ref AND NOT a.is_ref GROUP BY 1, 2)
  SELECT label, round(avg(best), 6) AS overlap FROM s GROUP BY 1"""))
def holdout_overlap(spark, d):
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("label").alias("class_label"), "v", "is_ref")
    best = sim.best_in_groups(v.where("NOT is_ref"), v.where("is_ref"))
    return best.groupBy(F.col("class_label").alias("label")).agg(F.round(F.avg("sim"), 6).alias("overlap"))


@query(with_views("vectors", _every_overlap("label")))
def overlap_filter_all(spark, d):
    """Like overlap_filter, with each label as a class of its own."""
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("class_label"), "v")
    return sim.drop_lowest(sim.overlap_scores(v, v, 15), 0.3).select(F.col("id").alias("vec_id"), F.col("class_label").cast("int").alias("label"))


@query(with_views("vectors", f""", {SIMS}, k AS (SELECT class_label, count(*) AS n FROM a GROUP BY 1),
  h AS (SELECT a.vec_id, a.class_label, row_number() OVER (PARTITION BY a.class_label ORDER BY round(mean_own - mean_other, 9) DESC, vec_id) AS place, n FROM a JOIN k USING (class_label)) SELECT class_label, vec_id FROM h WHERE place <= 40 + floor((n - 40) / 2)"""))
def gap_midpoint(spark, d):
    """The first step of the gap pipeline: the candidates of the greatest gap, halfway down to 40."""
    c, r = _parts(spark, d)
    keep = c.groupBy("class_label").agg((F.lit(40) + F.floor((F.count("*") - 40) / 2)).alias("mid"))
    scored = sim.class_gap(c, r).withColumnRenamed("gap", "sim").join(F.broadcast(keep), "class_label")  # one row a class
    return sim.nearest_half(scored).select("class_label", F.col("id").alias("vec_id"))


@query(with_views("vectors", _greedy(40, "mean_own - mean_other", "40 + floor((n - 40) / 2)")))
def gap_pipeline(spark, d):
    """The whole gap pipeline."""
    return sim.gap_pipeline(*_parts(spark, d), target=40).select("class_label", F.col("id").alias("vec_id"), "place")


@query(with_views("vectors", """, p AS (SELECT c.vec_id % 5 AS run, c.class_label AS c, r.class_label AS r, avg(list_dot_product(c.v, r.v)) AS s FROM vectors c, vectors r WHERE NOT c.is_ref AND r.is_ref GROUP BY 1, 2, 3),
  g AS (SELECT run, max(s) FILTER (c = 'Yes' AND r = 'Yes') - max(s) FILTER (c = 'Yes' AND r = 'No') AS pos_gap, max(s) FILTER (c = 'No' AND r = 'No') - max(s) FILTER (c = 'No' AND r = 'Yes') AS neg_gap FROM p GROUP BY 1)
  SELECT count(*) AS n, round(avg(pos_gap), 6) AS pos_gap, round(stddev_samp(pos_gap) / sqrt(count(*)), 6) AS pos_se, round(avg(neg_gap), 6) AS neg_gap, round(stddev_samp(neg_gap) / sqrt(count(*)), 6) AS neg_se FROM g"""))
def gap_report_runs(spark, d):
    """The gaps of five pools, mean and standard error."""
    v = vectors(spark, d)
    c = sim.centroids(v.where("NOT is_ref").withColumn("run", F.pmod("vec_id", F.lit(5))), ["run", "class_label"]).select("run", F.col("class_label").alias("c"), F.col("mean").alias("mc"))
    r = sim.centroids(v.where("is_ref"), ["class_label"]).select(F.col("class_label").alias("r"), F.col("mean").alias("mr"))
    p = c.crossJoin(F.broadcast(r)).withColumn("s", sim.dot(F.col("mc"), F.col("mr")))  # two rows
    own, other = F.max(F.when(F.col("c") == F.col("r"), F.col("s"))), F.max(F.when(F.col("c") != F.col("r"), F.col("s")))
    g = p.groupBy("run", "c").agg((own - other).alias("gap")).groupBy("run").agg(*[F.max(F.when(F.col("c") == x, F.col("gap"))).alias(n) for n, x in (("pos_gap", "Yes"), ("neg_gap", "No"))])
    se = {n: F.stddev_samp(n) / F.sqrt(F.count("*")) for n in ("pos_gap", "neg_gap")}
    return g.agg(F.count("*").alias("n"), *[F.round(x, 6).alias(a) for a, x in (("pos_gap", F.avg("pos_gap")), ("pos_se", se["pos_gap"]), ("neg_gap", F.avg("neg_gap")), ("neg_se", se["neg_gap"]))])


@query(with_views("vectors", f", {SIMS} SELECT class_label, count(*) AS n, round(avg(best), 6) AS nearest_real FROM a GROUP BY 1 HAVING count(*) > 1"))
def nearest_real(spark, d):
    """Mean similarity of the candidates of each class to their nearest reference."""
    s = sim.reference_similarity(*_parts(spark, d)).groupBy("class_label").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("nearest_real"))
    return s.where("n > 1")


@query(with_views("vectors", """, p AS (SELECT a.label, avg(list_dot_product(a.v, b.v)) FILTER (a.vec_id <> b.vec_id AND a.vec_id % 2 = b.vec_id % 2) AS same, avg(list_dot_product(a.v, b.v)) FILTER (a.vec_id % 2 <> b.vec_id % 2) AS other FROM vectors a JOIN vectors b ON a.label = b.label GROUP BY 1)
  SELECT label, round(same, 6) AS same, round(other, 6) AS other, round(same - other, 6) AS separability FROM p"""))
def class_separability(spark, d):
    """Mean similarity within and between the two groups of each label, over all ordered pairs, and the difference."""
    c = sim.centroids(vectors(spark, d).withColumn("side", F.pmod("vec_id", F.lit(2))), ["label", "side"])
    n, m, q = F.col("n"), F.col("mean"), F.col("squares")
    within = c.groupBy("label").agg(F.try_divide(F.sum(n * n * sim.dot(m, m) - q), F.sum(n * (n - 1))).alias("same"))
    a, b = c.where("side = 0").select("label", F.col("mean").alias("ma")), c.where("side = 1").select("label", F.col("mean").alias("mb"))
    x = within.join(a, "label", "left").join(b, "label", "left").withColumn("other", sim.dot(F.col("ma"), F.col("mb")))
    return x.select("label", F.round("same", 6).alias("same"), F.round("other", 6).alias("other"), F.round(F.col("same") - F.col("other"), 6).alias("separability"))


@query(with_views("vectors", """, p AS (SELECT a.vec_id // 32 AS batch, a.vec_id AS i, a.label = b.label AS own, list_dot_product(a.v, b.v) / 0.1 AS s FROM vectors a JOIN vectors b ON a.vec_id // 32 = b.vec_id // 32 AND a.vec_id <> b.vec_id),
  r AS (SELECT batch, i, ln(sum(exp(s))) AS a, avg(s) FILTER (own) AS m FROM p GROUP BY 1, 2) SELECT batch, round(avg(a - m), 6) AS loss FROM r WHERE m IS NOT NULL GROUP BY 1"""))
def contrastive_loss(spark, d):
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), "label", "v", F.floor(F.col("vec_id") / 32).alias("batch"))
    return sim.contrastive_loss(v, "batch", "label", 0.1).withColumn("loss", F.round("loss", 6))


@query(with_views("vectors", """, p AS (SELECT a.class_label, list_dot_product(a.v, b.v) AS s FROM vectors a JOIN vectors b ON a.class_label = b.class_label AND a.vec_id <> b.vec_id)
  SELECT class_label, round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(s), 6) AS mean FROM p GROUP BY 1"""))
def pair_sim_range(spark, d):
    """Least, greatest and mean similarity of the pairs of each class, all compared in blocks (A18)."""
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), "class_label", "v")
    x = sim.similarity_range(v, v)
    return x.select("class_label", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean")])


SIM_MATRIX = """m AS (SELECT a.label AS a, b.label AS b, avg(list_dot_product(a.v, b.v)) AS s FROM vectors a, vectors b GROUP BY 1, 2)"""


def _matrix(spark, d):
    c = sim.centroids(vectors(spark, d), ["label"]).select("label", "mean")
    both = c.toDF("a", "ma").crossJoin(F.broadcast(c.toDF("b", "mb")))  # one row for each label
    return both.select("a", "b", sim.dot(F.col("ma"), F.col("mb")).alias("s"))


@query(with_views("vectors", f", {SIM_MATRIX} SELECT b AS label, round(max(s) FILTER (a = b) - avg(s), 6) AS above_mean, max(s) FILTER (a = b) < max(s) AS below_another FROM m GROUP BY 1"))
def diagonal_gain(spark, d):
    """How far each label is more like itself than labels are on average like it, and whether another is more like it."""
    own = F.max(F.when(F.col("a") == F.col("b"), F.col("s")))
    return _matrix(spark, d).groupBy(F.col("b").alias("label")).agg(F.round(own - F.avg("s"), 6).alias("above_mean"), (own < F.max("s")).alias("below_another"))


@query(with_views("vectors", f""", {SIM_MATRIX} SELECT x.a AS base, y.a AS augment, x.b AS target, round(y.s - x.s, 6) AS closer FROM m x JOIN m y ON x.b = y.b AND x.a <> y.a WHERE x.a <> x.b AND y.a <> x.b AND y.s > x.s"""))
def topic_triplets(spark, d):
    """Base, augmenting and target label, all different, where the augmenting one is more like the target than the base."""
    m = _matrix(spark, d).where("a <> b")
    x, y = m.select(F.col("a").alias("base"), F.col("b").alias("target"), F.col("s").alias("sx")), m.select(F.col("a").alias("augment"), F.col("b").alias("target"), F.col("s").alias("sy"))
    t = x.join(y, "target").where("base <> augment AND sy > sx")  # labels are few
    return t.select("base", "augment", "target", F.round(F.col("sy") - F.col("sx"), 6).alias("closer"))


@query(with_views("vectors predictions", f""", {SIM_MATRIX}, c AS (SELECT dense_rank() OVER (ORDER BY aug) - 1 AS t, seq, coalesce(2 * count_if(score >= 0.5 AND label = 1) / nullif(count_if(score >= 0.5) + count_if(label = 1), 0), 0) AS f1 FROM predictions GROUP BY aug, seq),
  p AS (SELECT fb.t AS base, fa.t AS augment, fa.seq AS target, fa.f1 - fb.f1 AS gain, y.s - x.s AS closer FROM c fa JOIN c fb ON fa.seq = fb.seq AND fa.t <> fb.t JOIN m x ON x.a = fb.t AND x.b = fa.seq JOIN m y ON y.a = fa.t AND y.b = fa.seq WHERE fa.t <> fa.seq AND fb.t <> fa.seq)
  SELECT count(*) AS n, count_if(closer > 0 AND gain > 0) AS n_better, round(corr(gain, closer), 6) AS r FROM p"""))
def gain_closeness_corr(spark, d):
    """Over triplets, the correlation of the gain of one topic over another in a target with how much closer it is to it;
    the methods stand for the topics they are numbered with."""
    from pyspark.sql import Window

    from textloom.operators import evaluation as ev
    from textloom.sources.views import predictions

    f = ev.scores_of(ev.confusion(predictions(spark, d), ["aug", "seq"])).select("aug", "seq", "f1")
    f = f.withColumn("t", F.dense_rank().over(Window.orderBy("aug")) - 1)  # a row for each method and sequence
    m = _matrix(spark, d)
    x = f.select(F.col("t").alias("base"), F.col("seq").alias("target"), F.col("f1").alias("fb")).join(m.select(F.col("a").alias("base"), F.col("b").alias("target"), F.col("s").alias("sb")), ["base", "target"])
    y = f.select(F.col("t").alias("augment"), F.col("seq").alias("target"), F.col("f1").alias("fa")).join(m.select(F.col("a").alias("augment"), F.col("b").alias("target"), F.col("s").alias("sa")), ["augment", "target"])
    p = x.join(y, "target").where("base <> augment AND base <> target AND augment <> target").select((F.col("fa") - F.col("fb")).alias("gain"), (F.col("sa") - F.col("sb")).alias("closer"))
    return p.agg(F.count("*").alias("n"), F.count_if((F.col("closer") > 0) & (F.col("gain") > 0)).alias("n_better"), F.round(F.corr("gain", "closer"), 6).alias("r"))


@query(with_views("templates", r""", x AS (SELECT row_id, gen_num, list_filter(regexp_extract_all(lower(Text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1) AS w FROM templates WHERE Text IS NOT NULL),
  e AS (SELECT row_id, gen_num, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM x),
  k AS (SELECT term FROM (SELECT term, count(*) AS n FROM e WHERE gen_num = 0 GROUP BY 1 ORDER BY n DESC, term LIMIT 3000)), tf AS (SELECT row_id, gen_num, term, 1 + ln(count(*)) AS tf FROM e WHERE term IN (SELECT term FROM k) GROUP BY 1, 2, 3),
  n AS (SELECT count(*) AS n FROM x WHERE gen_num = 0), idf AS (SELECT term, ln((1 + n) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf, n WHERE gen_num = 0 GROUP BY term, n),
  v AS (SELECT row_id, gen_num, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY row_id)) AS w FROM tf JOIN idf USING (term)),
  s AS (SELECT a.row_id, b.row_id AS r, sum(a.w * b.w) AS s FROM v a JOIN v b USING (term) WHERE a.gen_num > 0 AND b.gen_num = 0 GROUP BY 1, 2), m AS (SELECT row_id, max(s) AS sim FROM s GROUP BY 1)
  SELECT x.row_id, round(coalesce(sim, 0), 5) AS sim FROM x LEFT JOIN m USING (row_id) WHERE gen_num > 0"""))
def tfidf_backend(spark, d):
    """The greatest TF-IDF similarity of every generated text to a real one, over the 3,000 most frequent terms of the real texts."""
    from textloom.operators.backends import TfIdf
    from textloom.sources.views import templates

    t = templates(spark, d).where("Text IS NOT NULL").select(F.col("row_id").alias("id"), "gen_num", F.col("Text").alias("text"))
    real = t.where("gen_num = 0")
    got = TfIdf(3000).fit(real).nearest(t.where("gen_num > 0"), real)
    return got.select(F.col("id").alias("row_id"), F.round("sim", 5).alias("sim"))
