"""Queries that score predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import evaluation as ev
from textloom.operators.sampling import resampled
from textloom.plans.lineage import table
from textloom.queries.base import query
from textloom.sources.views import predictions, with_views

RUN = ["aug", "seq", "seed"]


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


CONFUSION = """c AS (SELECT aug, seq, seed, count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label = 0) AS fp,
  count_if(score < 0.5 AND label = 1) AS fn, count_if(score < 0.5 AND label = 0) AS tn FROM predictions GROUP BY 1, 2, 3)"""
CURVE = """pts AS (SELECT aug, seq, seed, score, sum(label) AS p, sum(1 - label) AS n FROM predictions GROUP BY 1, 2, 3, 4),
c AS (SELECT aug, seq, seed, score, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER w AS pos, sum(n) OVER w AS neg FROM pts
  WINDOW w AS (PARTITION BY aug, seq, seed), d AS (PARTITION BY aug, seq, seed ORDER BY score DESC)),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(pos, 0), 0) AS rec, coalesce(fp / nullif(neg, 0), 0) AS fpr FROM c)"""
RUN_METRICS = CURVE + """,
ap AS (SELECT aug, seq, seed, sum((rec - before) * prec) AS ap FROM (SELECT *, coalesce(lag(rec) OVER (PARTITION BY aug, seq, seed ORDER BY score DESC), 0) AS before FROM pr) GROUP BY 1, 2, 3),
best AS (SELECT aug, seq, seed, f1, score AS threshold FROM (SELECT *, round(2 * tp / (tp + fp + pos), 12) AS f1 FROM pr)
  QUALIFY row_number() OVER (PARTITION BY aug, seq, seed ORDER BY f1 DESC, score) = 1)"""


def run_metrics(spark, d):
    """(aug, seq, seed, ap, f1, threshold) of each run."""
    c = ev.curve(predictions(spark, d), RUN)
    return ev.average_precision(c, RUN).join(ev.best_f1(c, RUN), RUN)


@query(with_views("predictions", f", {CONFUSION} SELECT * FROM c"))
def confusion(spark, d):
    return ev.confusion(predictions(spark, d), RUN)


@query(with_views("predictions", f""", {CONFUSION} SELECT aug, seq, seed, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c"""))
def prf_accuracy(spark, d):
    return _round(ev.scores_of(ev.confusion(predictions(spark, d), RUN)), "precision", "recall", "f1", "accuracy").drop("tp", "fp", "fn", "tn")


@query(with_views("predictions", f""", {CONFUSION} SELECT aug, seq, seed, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS "precision", round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall,
  round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1 FROM c"""))
def inverted_metrics(spark, d):
    return _round(ev.scores_of(ev.confusion(predictions(spark, d), RUN), inverted=True), "precision", "recall", "f1").select(*RUN, "precision", "recall", "f1")


@query(with_views("predictions", f", {CONFUSION} SELECT aug, round_even(avg(tp), 2) AS tp, round_even(avg(fp), 2) AS fp, round_even(avg(fn), 2) AS fn, round_even(avg(tn), 2) AS tn FROM c GROUP BY 1"))
def mean_confusion(spark, d):
    return ev.confusion(predictions(spark, d), RUN).groupBy("aug").agg(*[F.bround(F.avg(c), 2).alias(c) for c in ("tp", "fp", "fn", "tn")])


@query(with_views("predictions", """SELECT aug, seq, seed, t.threshold, round(coalesce(2 * count_if(score >= t.threshold AND label = 1) / nullif(count_if(score >= t.threshold AND label = 1) + count_if(score >= t.threshold) + count_if(label = 1) - count_if(score >= t.threshold AND label = 1), 0), 0), 6) AS f1
  FROM predictions, (VALUES (CAST(0.2 AS DOUBLE)), (0.35), (0.5), (0.65)) t(threshold) GROUP BY 1, 2, 3, 4"""))
def f1_at_thresholds(spark, d):
    return _round(ev.f1_at(predictions(spark, d), RUN, [0.2, 0.35, 0.5, 0.65]), "f1")


@query(with_views("predictions", f""", {CURVE} SELECT aug, seq, seed, score, round(prec, 6) AS "precision", round(rec, 6) AS recall FROM pr"""))
def pr_curve(spark, d):
    return _round(ev.curve(predictions(spark, d), RUN), "precision", "recall").select(*RUN, "score", "precision", "recall")


@query(with_views("predictions", f", {CURVE} SELECT aug, seq, seed, score, round(rec, 6) AS tpr, round(fpr, 6) AS fpr FROM pr"))
def roc_points(spark, d):
    return _round(ev.curve(predictions(spark, d), RUN), "recall", "fpr").select(*RUN, "score", F.col("recall").alias("tpr"), "fpr")


@query(with_views("predictions", f", {RUN_METRICS} SELECT aug, seq, seed, round(ap, 6) AS ap FROM ap"))
def average_precision(spark, d):
    return _round(ev.average_precision(ev.curve(predictions(spark, d), RUN), RUN), "ap")


@query(with_views("predictions", f", {RUN_METRICS} SELECT aug, seq, seed, round(f1, 6) AS f1, threshold FROM best"))
def optimal_f1(spark, d):
    return _round(ev.best_f1(ev.curve(predictions(spark, d), RUN), RUN), "f1")


POOLED = CURVE.replace("aug, seq, seed", "aug").replace("GROUP BY 1, 2, 3, 4", "GROUP BY 1, 2")


@query(with_views("predictions", f""", {POOLED}, ap AS (SELECT aug, sum((rec - before) * prec) AS ap FROM (SELECT *, coalesce(lag(rec) OVER (PARTITION BY aug ORDER BY score DESC), 0) AS before FROM pr) GROUP BY 1)
  SELECT aug, round(ap, 6) AS ap, (SELECT count(*) FROM predictions p WHERE p.aug = ap.aug) AS n, round((SELECT avg(label) FROM predictions p WHERE p.aug = ap.aug), 6) AS pos_rate FROM ap"""))
def pooled_metrics(spark, d):
    p = predictions(spark, d)
    ap = ev.average_precision(ev.curve(p, ["aug"]), ["aug"])
    return _round(ap.join(p.groupBy("aug").agg(F.count("*").alias("n"), F.avg("label").alias("pos_rate")), "aug"), "ap", "pos_rate")


GRID = CURVE + """,
dist AS (SELECT aug, seq, seed, rec, max(prec) AS prec FROM pr GROUP BY 1, 2, 3, 4),
env AS (SELECT *, max(prec) OVER (PARTITION BY aug, seq, seed ORDER BY rec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM dist),
grid AS (SELECT k, CAST(k AS DOUBLE) / 20 AS r FROM range(0, 21) t(k)),
seg AS (SELECT *, coalesce(lag(rec) OVER w, 0) AS r0, coalesce(lag(env) OVER w, 1) AS e0 FROM env WINDOW w AS (PARTITION BY aug, seq, seed ORDER BY rec)),
g AS (SELECT aug, seq, seed, r, e0 + (env - e0) * (r - r0) / (rec - r0) AS p FROM seg, grid WHERE rec > r0 AND r <= rec + 5e-11 AND (r > r0 + 5e-11 OR (r0 = 0 AND r = 0))
  )"""


@query(with_views("predictions", f""", {GRID} SELECT aug, seq, seed, round(r, 4) AS r, round(p, 6) AS "precision" FROM g"""))
def pr_envelope_grid(spark, d):
    return _round(ev.envelope_on_grid(ev.curve(predictions(spark, d), RUN), RUN, 20), "precision").withColumn("r", F.round("r", 4))


@query(with_views("predictions", f""", {GRID}, s AS (SELECT aug, round(r, 4) AS r, seq, avg(p) AS p FROM g GROUP BY 1, 2, 3)
  SELECT aug, r, round(avg(p), 6) AS mean, round(stddev_samp(p) / sqrt(count(*)), 6) AS se FROM s GROUP BY 1, 2"""))
def mean_pr_curve(spark, d):
    g = ev.envelope_on_grid(ev.curve(predictions(spark, d), RUN), RUN, 20).withColumn("r", F.round("r", 4))
    each = g.groupBy("aug", "r", "seq").agg(F.avg("precision").alias("p"))
    return _round(each.groupBy("aug", "r").agg(F.avg("p").alias("mean"), (F.stddev_samp("p") / F.sqrt(F.count("p"))).alias("se")), "mean", "se")


@query(with_views("predictions", """, r AS (SELECT *, row_number() OVER (PARTITION BY aug, seq, seed, label ORDER BY md5('42:' || row_id), row_id) AS rn,
    sum(label) OVER w AS pos, sum(1 - label) OVER w AS neg FROM predictions WINDOW w AS (PARTITION BY aug, seq, seed)),
  rates AS (SELECT * FROM (VALUES (CAST(0.13 AS DOUBLE)), (0.25), (0.5)) t(rate)),
  q AS (SELECT *, greatest(1, CAST(round_even(pos * (1 - rate) / rate, 0) AS BIGINT)) AS want FROM r, rates),
  t AS (SELECT *, CASE WHEN label = 1 OR pos = 0 THEN 1 ELSE floor((want - rn) / neg) + 1 END AS times FROM q),
  f AS (SELECT aug, seq, seed, rate, coalesce(2 * sum(times * label) FILTER (score >= 0.5) / nullif(sum(times) FILTER (score >= 0.5) + sum(times * label), 0), 0) AS f1 FROM t WHERE times > 0 GROUP BY 1, 2, 3, 4),
  s AS (SELECT aug, rate, seq, avg(f1) AS f1 FROM f GROUP BY 1, 2, 3)
  SELECT aug, rate, round(avg(f1), 6) AS mean, round(stddev_samp(f1) / sqrt(count(*)), 6) AS se FROM s GROUP BY 1, 2"""))
def f1_vs_base_rate(spark, d):
    r = resampled(predictions(spark, d), RUN, "label", [0.13, 0.25, 0.5], "row_id")
    f = ev.scores_of(ev.confusion(r, [*RUN, "rate"])).groupBy("aug", "rate", "seq").agg(F.avg("f1").alias("f1"))
    return _round(f.groupBy("aug", "rate").agg(F.avg("f1").alias("mean"), (F.stddev_samp("f1") / F.sqrt(F.count("*"))).alias("se")), "mean", "se")


@query(with_views("predictions", """, s AS (SELECT * FROM (VALUES (1), (2), (3)) t(draw)), r AS (SELECT *, row_number() OVER (PARTITION BY aug, seq, seed, draw, label ORDER BY md5(draw || ':' || row_id), row_id) AS rn FROM predictions, s),
  w AS (SELECT aug, seq, seed, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY 1, 2, 3),
  q AS (SELECT r.*, pos, neg, t.rate, greatest(1, CAST(round_even(pos * (1 - t.rate) / t.rate, 0) AS BIGINT)) AS want FROM r JOIN w USING (aug, seq, seed), (VALUES (CAST(0.13 AS DOUBLE)), (0.5)) t(rate)),
  t AS (SELECT *, CASE WHEN label = 1 OR pos = 0 THEN 1 ELSE floor((want - rn) / neg) + 1 END AS times FROM q),
  pts AS (SELECT aug, seq, seed, draw, rate, score, sum(times * label) AS p, sum(times * (1 - label)) AS n FROM t WHERE times > 0 GROUP BY 1, 2, 3, 4, 5, 6),
  c AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY aug, seq, seed, draw, rate) AS allpos FROM pts WINDOW d AS (PARTITION BY aug, seq, seed, draw, rate ORDER BY score DESC)),
  f AS (SELECT aug, seq, seed, draw, rate, max(coalesce(2 * tp / nullif(tp + fp + allpos, 0), 0)) AS f1 FROM c GROUP BY 1, 2, 3, 4, 5), m AS (SELECT aug, rate, seq, avg(f1) AS f1 FROM f GROUP BY 1, 2, 3)
  SELECT aug, rate, round(avg(f1), 6) AS mean, round(stddev_samp(f1) / sqrt(count(*)), 6) AS se FROM m GROUP BY 1, 2"""))
def optimal_f1_vs_base_rate(spark, d):
    """The best F1 of each run at two rates, over three draws."""
    runs = [*RUN, "draw", "rate"]
    r = resampled(predictions(spark, d), RUN, "label", [0.13, 0.5], "row_id", [1, 2, 3])
    f = ev.best_f1(ev.curve(r, runs), runs).groupBy("aug", "rate", "seq").agg(F.avg("f1").alias("f1"))
    return _round(f.groupBy("aug", "rate").agg(F.avg("f1").alias("mean"), (F.stddev_samp("f1") / F.sqrt(F.count("*"))).alias("se")), "mean", "se")


@query(with_views("predictions", f""", {CURVE} SELECT aug, seq, seed, score, round(prec, 6) AS "precision", round(rec, 6) AS recall FROM pr UNION ALL SELECT DISTINCT aug, seq, seed, NULL, 1.0, 0.0 FROM pr"""))
def pr_curve_closed(spark, d):
    """The curve of each run with its end at precision 1 and recall 0."""
    return _round(ev.with_end(ev.curve(predictions(spark, d), RUN), RUN), "precision", "recall")


F1_AT = """round(coalesce(2 * count_if(score >= {0} AND label = 1) / nullif(count_if(score >= {0}) + count_if(label = 1), 0), 0), 6)"""


@query(with_views("predictions", f""", {RUN_METRICS}, f AS (SELECT aug, seq, seed, count(*) AS n, round(avg(label), 6) AS pos_rate, {F1_AT.format("0.35")} AS f1_35, {F1_AT.format("0.5")} AS f1_50, {F1_AT.format("0.65")} AS f1_65 FROM predictions GROUP BY 1, 2, 3)
  SELECT f.*, round(ap.ap, 6) AS ap, round(best.f1, 6) AS best_f1, best.threshold FROM f JOIN ap USING (aug, seq, seed) JOIN best USING (aug, seq, seed)"""))
def run_metric_table(spark, d):
    """One row for each run with all its measures."""
    p = predictions(spark, d)
    c = ev.curve(p, RUN)
    at = ev.f1_at(p, RUN, [0.35, 0.5, 0.65]).groupBy(*RUN).agg(*[F.max(F.when(F.col("threshold") == t, F.col("f1"))).alias(f"f1_{round(t * 100)}") for t in (0.35, 0.5, 0.65)])
    size = p.groupBy(*RUN).agg(F.count("*").alias("n"), F.avg("label").alias("pos_rate"))
    whole = size.join(at, RUN).join(ev.average_precision(c, RUN), RUN).join(ev.best_f1(c, RUN).withColumnRenamed("f1", "best_f1"), RUN)
    return _round(whole, "pos_rate", "f1_35", "f1_50", "f1_65", "ap", "best_f1")


@query(with_views("predictions", f""", {POOLED}, ap AS (SELECT aug, sum((rec - before) * prec) AS ap FROM (SELECT *, coalesce(lag(rec) OVER (PARTITION BY aug ORDER BY score DESC), 0) AS before FROM pr) GROUP BY 1),
  best AS (SELECT aug, max(round(2 * tp / (tp + fp + pos), 12)) AS f1 FROM pr GROUP BY 1), f AS (SELECT aug, count(*) AS n, round(avg(label), 6) AS pos_rate, {F1_AT.format("0.5")} AS f1_50 FROM predictions GROUP BY 1)
  SELECT f.*, round(ap, 6) AS ap, round(best.f1, 6) AS best_f1, rank() OVER (ORDER BY round(ap, 6) DESC) AS rank FROM f JOIN ap USING (aug) JOIN best USING (aug)"""))
def pooled_table(spark, d):
    """The measures of each method over all its runs together, and its rank."""
    from textloom.operators.experiments import ranks

    p = predictions(spark, d)
    c = ev.curve(p, ["aug"])
    size = p.groupBy("aug").agg(F.count("*").alias("n"), F.avg("label").alias("pos_rate"))
    whole = size.join(ev.f1_at(p, ["aug"], [0.5]).select("aug", F.col("f1").alias("f1_50")), "aug").join(ev.average_precision(c, ["aug"]), "aug").join(ev.best_f1(c, ["aug"]).select("aug", F.col("f1").alias("best_f1")), "aug")
    rounded = _round(whole, "pos_rate", "f1_50", "ap", "best_f1").withColumn("_all", F.lit(0))
    return ranks(rounded, ["_all"], "ap").drop("_all").withColumn("rank", F.col("rank").cast("bigint"))


@query(with_views("predictions", f""", x AS (SELECT aug, seq, seed, t.threshold, coalesce(2 * count_if(score >= t.threshold AND label = 1) / nullif(count_if(score >= t.threshold) + count_if(label = 1), 0), 0) AS f1 FROM predictions, (VALUES (CAST(0.35 AS DOUBLE)), (0.5), (0.65)) t(threshold) GROUP BY 1, 2, 3, 4),
  m AS (SELECT threshold, aug, round(avg(f1), 9) AS f1 FROM (SELECT threshold, aug, seq, avg(f1) AS f1 FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY threshold ORDER BY f1 DESC) AS r FROM m)
  SELECT threshold, string_agg(aug, ' > ' ORDER BY r, aug) AS methods FROM r GROUP BY 1"""))
def rank_per_threshold(spark, d):
    """The methods in the order of their mean F1 at each threshold."""
    from textloom.operators.experiments import ranks

    f = ev.f1_at(predictions(spark, d), RUN, [0.35, 0.5, 0.65]).groupBy("threshold", "aug", "seq").agg(F.avg("f1").alias("f1"))
    r = ranks(f.groupBy("threshold", "aug").agg(F.round(F.avg("f1"), 9).alias("f1")), ["threshold"], "f1")
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "aug"))), lambda x: x["aug"]), " > ")
    return r.groupBy("threshold").agg(order.alias("methods"))  # a row for each method


@query(with_views("predictions", f""", {CONFUSION}, f AS (SELECT aug, seq, avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS p, avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS r, avg((tp + tn) / (tp + tn + fp + fn)) AS a FROM c GROUP BY 1, 2)
  SELECT aug, count(*) AS n, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(a), 6) AS accuracy FROM f WHERE seq IN (SELECT seq FROM f WHERE aug = 'view') GROUP BY 1"""))
def summary_metrics(spark, d):
    """Mean precision, recall and accuracy of each method over the sequences that the baseline has, too."""
    from textloom.operators.experiments import on_common

    values = ["precision", "recall", "accuracy"]
    m = ev.scores_of(ev.confusion(predictions(spark, d), RUN)).groupBy("aug", "seq").agg(*[F.avg(v).alias(v) for v in values])
    return _round(on_common(m, "view", values), *values)


@query(with_views("claims", """, s AS (SELECT Sentence_id, class_label, topic, style, source, CAST(length(Text) > 300 AS INT) AS predicted FROM claims WHERE Text IS NOT NULL AND class_label IS NOT NULL),
  w AS (SELECT unnest([{'dim': 'topic', 'x': topic}, {'dim': 'style', 'x': style}, {'dim': 'source', 'x': source}, {'dim': 'label', 'x': class_label}], recursive := true), CAST((class_label = 'Yes') <> (predicted = 1) AS INT) AS wrong FROM s)
  SELECT dim, x AS value, count(*) AS n, CAST(sum(wrong) AS BIGINT) AS wrong FROM w GROUP BY 1, 2"""))
def error_dimensions(spark, d):
    """The errors of a rule that takes long texts for Yes, by topic, style, source and label."""
    from textloom.sources.views import claims

    c = claims(spark, d).where("Text IS NOT NULL AND class_label IS NOT NULL")
    wrong = ((F.col("class_label") == "Yes") != (F.length("Text") > 300)).cast("int")
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), F.col(x).alias("value")) for n, x in (("topic", "topic"), ("style", "style"), ("source", "source"), ("label", "class_label"))])
    return c.select(F.inline(dims), wrong.alias("wrong")).groupBy("dim", "value").agg(F.count("*").alias("n"), F.sum("wrong").alias("wrong"))


@query("""WITH b AS (SELECT user_id, list(DISTINCT event_type) FILTER (event_id % 2 = 0) AS a, list(DISTINCT event_type) FILTER (event_id % 2 = 1) AS p FROM events GROUP BY 1)
  SELECT CAST(sum(len(list_intersect(coalesce(a, []), coalesce(p, [])))) AS BIGINT) AS tp, CAST(sum(len(coalesce(a, []))) AS BIGINT) AS n_labels, CAST(sum(len(coalesce(p, []))) AS BIGINT) AS n_predicted,
    round(2 * sum(len(list_intersect(coalesce(a, []), coalesce(p, [])))) / (sum(len(coalesce(a, []))) + sum(len(coalesce(p, [])))), 6) AS f1 FROM b""")
def multilabel_f1(spark, d):
    """Micro F1 of the kinds of a user's odd events as a prediction of those of the even ones."""
    kind = F.col("event_id") % 2
    by = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(kind == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(kind == 1, F.col("event_type"))).alias("p"))
    return _round(ev.micro_f1(by, F.col("a"), F.col("p")), "f1")


@query(with_views("predictions", "SELECT row_id, label, CAST(score >= 0.5 AS INT) AS predicted FROM predictions WHERE label <> CAST(score >= 0.5 AS INT)"))
def misclassified(spark, d):
    p = predictions(spark, d).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return p.where("label != predicted").select("row_id", "label", "predicted")


@query(with_views("predictions", """SELECT aug, seq, count(*) AS n, count_if(label <> CAST(score >= 0.5 AS INT)) AS wrong, round(count_if(label <> CAST(score >= 0.5 AS INT)) / count(*), 6) AS share FROM predictions GROUP BY 1, 2"""))
def error_profile(spark, d):
    wrong = F.count_if(F.col("label") != (F.col("score") >= 0.5).cast("int"))
    return predictions(spark, d).groupBy("aug", "seq").agg(F.count("*").alias("n"), wrong.alias("wrong"), F.round(wrong / F.count("*"), 6).alias("share"))


MATRIX = """m AS (SELECT aug, seq, coalesce(2 * count_if(score >= 0.5 AND label = 1) / nullif(count_if(score >= 0.5) + count_if(label = 1), 0), 0) AS f1 FROM predictions GROUP BY 1, 2)"""


@query(with_views("predictions", f", {MATRIX} SELECT aug, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, round(min(f1), 6) AS least, arg_min(seq, (round(f1, 9), seq)) AS worst FROM m GROUP BY 1"))
def topic_metric_matrix(spark, d):
    m = ev.scores_of(ev.confusion(predictions(spark, d), ["aug", "seq"])).select("aug", "seq", "f1")
    agg = m.groupBy("aug").agg(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"), F.min("f1").alias("least"), F.min_by("seq", F.struct(F.round("f1", 9), "seq")).alias("worst"))
    return _round(agg, "mean", "std", "least")


@query(with_views("predictions", f""", {MATRIX} SELECT b.aug AS base, a.aug AS augment, a.seq AS target, round(a.f1 - b.f1, 6) AS gain FROM m a JOIN m b ON a.seq = b.seq AND a.aug <> b.aug WHERE a.f1 - b.f1 > 1e-6"""))
def cross_topic_gain(spark, d):
    m = ev.scores_of(ev.confusion(predictions(spark, d), ["aug", "seq"])).select("aug", "seq", "f1")
    a, b = m.toDF("augment", "target", "fa"), m.toDF("base", "target", "fb")
    pairs = a.join(b, "target").where("augment != base AND fa - fb > 1e-6")
    return pairs.select("base", "augment", "target", F.round(F.col("fa") - F.col("fb"), 6).alias("gain"))


@query("""SELECT event_id, round(1 / (1 + exp(-ln(value / 50))), 6) AS p FROM events""")
def softmax_scores(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(ev.positive_probability(F.lit(0.0), F.log(F.col("value") / 50)), 6).alias("p"))


@query(with_views("predictions", "SELECT aug, seq, seed, round(avg((score - label) * (score - label)), 6) AS mse FROM predictions GROUP BY 1, 2, 3"))
def mean_squared_error(spark, d):
    e = F.col("score") - F.col("label")
    return predictions(spark, d).groupBy(*RUN).agg(F.round(F.avg(e * e), 6).alias("mse"))


@query(with_views("predictions", f""", {CONFUSION}, f AS (SELECT aug, seq, seed, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
  SELECT aug, seed AS step, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std FROM f GROUP BY 1, 2"""))
def size_curve(spark, d):
    f = ev.scores_of(ev.confusion(predictions(spark, d), RUN))
    return _round(f.groupBy("aug", F.col("seed").alias("step")).agg(F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("std")), "mean", "std")
