"""Queries that compare methods over runs; the baseline is the method 'view', the value is the average precision."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import experiments as ex
from textloom.queries.base import query
from textloom.operators import evaluation as ev
from textloom.plans.lineage import cut
from textloom.queries.evaluations import RUN, RUN_METRICS
from textloom.sources.views import predictions, with_views

BASE = "view"
METHODS = ["click", "error", "purchase", "signup", "view"]
MEANS = RUN_METRICS + """,
m AS (SELECT aug, seq, avg(ap) AS v FROM ap GROUP BY 1, 2),
g AS (SELECT a.aug, a.seq, a.v, b.v AS base, a.v - b.v AS diff FROM m a JOIN m b ON a.seq = b.seq AND b.aug = 'view' WHERE a.aug <> 'view')"""
TESTS = MEANS + """,
t AS (SELECT aug, count(*) AS n, avg(diff) AS mean_diff, stddev_samp(diff) AS sd, var_samp(v) AS va, var_samp(base) AS vb FROM g GROUP BY 1)"""


def _runs(spark, d):
    """The runs with their average precision, a few hundred rows, written once as the comparisons read them several times."""
    p = predictions(spark, d)
    return cut(ev.average_precision(ev.curve(p, RUN), RUN).select(*RUN, F.col("ap").alias("value")))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(with_views("predictions", f", {MEANS} SELECT aug, seq, round(v, 6) AS v FROM m"))
def seq_means(spark, d):
    return _round(ex.seq_means(_runs(spark, d)), "v")


@query(with_views("predictions", f", {MEANS} SELECT aug, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS se FROM m GROUP BY 1"))
def mean_se(spark, d):
    m = ex.seq_means(_runs(spark, d)).groupBy("aug").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se"))
    return _round(m, "mean", "se")


@query(with_views("predictions", f""", {MEANS} SELECT m.aug, count(*) AS n_seq, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
  (SELECT round(avg(diff), 6) FROM g WHERE g.aug = m.aug) AS diff FROM m GROUP BY 1"""))
def summary_vs_baseline(spark, d):
    return _round(ex.summary(ex.seq_means(_runs(spark, d)), BASE), "mean", "std", "diff")


@query(with_views("predictions", f""", {MEANS} SELECT seq, {", ".join(f"round(avg(v) FILTER (aug = '{a}'), 6) AS {a}" for a in METHODS)} FROM m GROUP BY GROUPING SETS ((seq), ())"""))
def seq_aug_pivot_margin(spark, d):
    return _round(ex.pivot_with_margin(ex.seq_means(_runs(spark, d)), METHODS), *METHODS)


@query(with_views("predictions", f""", {MEANS} SELECT aug, count_if(diff > 1e-6) AS wins, count_if(abs(diff) <= 1e-6) AS ties, count_if(diff < -1e-6) AS losses, round(count_if(diff > 1e-6) / count(*), 6) AS rate FROM g GROUP BY 1"""))
def win_rate(spark, d):
    return _round(ex.win_rates(ex.seq_means(_runs(spark, d)), BASE), "rate")


@query(with_views("predictions", f""", {MEANS} SELECT m.seq, m.aug, round(m.v - b.v, 6) AS gain FROM m LEFT JOIN m b ON b.seq = m.seq AND b.aug = 'view'
  QUALIFY row_number() OVER (PARTITION BY m.seq ORDER BY round(m.v, 9) DESC, m.aug) = 1"""))
def best_aug(spark, d):
    return _round(ex.best_method(ex.seq_means(_runs(spark, d)), BASE), "gain")


@query(with_views("predictions", """, r AS (SELECT aug, seq, seed FROM predictions GROUP BY 1, 2, 3 HAVING count(*) >= 40),
  n AS (SELECT aug, seq, count(*) AS n FROM r GROUP BY 1, 2)
  SELECT a.aug, s.seq, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT aug FROM r) a CROSS JOIN (SELECT DISTINCT seq FROM r) s
  LEFT JOIN n ON n.aug = a.aug AND n.seq = s.seq WHERE coalesce(n.n, 0) < 3"""))
def completeness(spark, d):
    large = predictions(spark, d).groupBy("aug", "seq", "seed").agg(F.count("*").alias("n")).where("n >= 40").drop("n")
    return ex.incomplete(large, 3)


@query(with_views("predictions", f", {RUN_METRICS} SELECT aug, seq, count(*) AS n, round(stddev_samp(ap), 6) AS std FROM ap GROUP BY 1, 2 HAVING count(*) > 1"))
def seed_variance(spark, d):
    return _round(ex.seed_variance(_runs(spark, d)), "std")


@query(with_views("predictions", f""", {TESTS} SELECT aug, n, round(mean_diff / (sd / sqrt(n)), 5) AS t, round(mean_diff, 6) AS mean_diff,
  round(mean_diff / sqrt((va + vb) / 2) * (1 - CAST(3 AS DOUBLE) / (4 * (2 * n - 2) - 1)), 5) AS hedges_g FROM t"""))
def paired_t_stat(spark, d):
    return ex.paired_tests(ex.seq_means(_runs(spark, d)), BASE).select("aug", "n", F.round("t", 5).alias("t"), F.round("mean_diff", 6).alias("mean_diff"), F.round("hedges_g", 5).alias("hedges_g"))


def t_p(t: str, n: str) -> str:
    """Two-sided p of t with n degrees of freedom in SQL, by Simpson's rule over 4,000 steps."""
    c = f"exp(lgamma(({n} + 1) / 2.0) - lgamma({n} / 2.0)) / sqrt({n} * pi())"
    return f"""(1 - 2 * {c} * abs({t}) / 12000 * (SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow({t} * i / 4000, 2) / {n}, -({n} + 1) / 2.0)) FROM range(0, 4001) s(i)))"""


def f_p(f: str, n: str, m: str) -> str:
    """Upper p of F with n and m degrees of freedom in SQL, by Simpson's rule over 20,000 steps; n is 2 at least."""
    c = f"exp(lgamma(({n} + {m}) / 2.0) - lgamma({n} / 2.0) - lgamma({m} / 2.0)) * pow({n} / CAST({m} AS DOUBLE), {n} / 2.0)"
    return f"""(1 - {c} * {f} / 60000 * (SELECT sum((CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow({f} * i / 20000, {n} / 2.0 - 1) * pow(1 + {n} * ({f} * i / 20000) / {m}, -({n} + {m}) / 2.0)) FROM range(0, 20001) s(i)))"""


HOLM = "s AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, aug) + 1) AS s FROM p), h AS (SELECT *, least(1.0, max(s) OVER (ORDER BY p, aug ROWS UNBOUNDED PRECEDING)) AS p_holm FROM s)"


@query(with_views("predictions", f""", {TESTS}, q AS (SELECT aug, n, mean_diff, mean_diff / (sd / sqrt(n)) AS t, mean_diff / sqrt((va + vb) / 2) * (1 - CAST(3 AS DOUBLE) / (4 * (2 * n - 2) - 1)) AS g FROM t), p AS (SELECT *, {t_p("t", "(n - 1)")} AS p FROM q), {HOLM}
  SELECT aug, n, round(t, 5) AS t, round(p, 6) AS p, round(p_holm, 6) AS p_holm, round(mean_diff, 6) AS mean_diff, round(g, 5) AS hedges_g FROM h"""))
def paired_p_values(spark, d):
    return _round(ex.paired_tests(ex.seq_means(_runs(spark, d)), BASE).withColumns({"t": F.round("t", 5), "hedges_g": F.round("hedges_g", 5)}), "p", "p_holm", "mean_diff")


PAIRS = """y AS (SELECT a.aug AS a, b.aug AS b, count(*) AS n, avg(a.v - b.v) AS md, stddev_samp(a.v - b.v) AS sd, var_samp(a.v) AS va, var_samp(b.v) AS vb FROM m a JOIN m b ON a.seq = b.seq AND a.aug < b.aug GROUP BY 1, 2 HAVING count(*) >= 2),
z AS (SELECT CASE WHEN b = 'view' THEN b ELSE a END AS a, CASE WHEN b = 'view' THEN a ELSE b END AS b, n, md / (sd / sqrt(n)) AS t, md / sqrt((va + vb) / 2) * (1 - CAST(3 AS DOUBLE) / (4 * (2 * n - 2) - 1)) AS g FROM y)"""


@query(with_views("predictions", f""", {MEANS}, {PAIRS}, x AS (SELECT *, {t_p("t", "(n - 1)")} AS p FROM z), p AS (SELECT b AS aug, a, n, t, p, g FROM x WHERE a = 'view'), {HOLM}
  SELECT a, aug AS b, n, round(t, 5) AS t, round(p, 6) AS p, round(p_holm, 6) AS p_holm, round(g, 5) AS hedges_g, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM h
  UNION ALL SELECT a, b, n, round(t, 5), round(p, 6), NULL, round(g, 5), CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END FROM x WHERE a <> 'view'"""))
def all_pairs_tests(spark, d):
    """Paired tests of all pairs of methods with marks of significance."""
    x = ex.all_pairs(ex.seq_means(_runs(spark, d)), BASE).withColumn("stars", ex.stars(F.col("p")))
    return _round(x.withColumns({"t": F.round("t", 5), "hedges_g": F.round("hedges_g", 5)}), "p", "p_holm")


@query(with_views("predictions", f""", {MEANS}, p AS (SELECT aug, round(abs(avg(diff)) * 20, 6) AS p FROM g GROUP BY 1),
  s AS (SELECT aug, p, p * (count(*) OVER () - row_number() OVER (ORDER BY p, aug) + 1) AS s FROM p)
  SELECT aug, p, round(least(1.0, max(s) OVER (ORDER BY p, aug ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM s"""))
def holm_adjust(spark, d):
    p = ex.against(ex.seq_means(_runs(spark, d)), BASE).groupBy("aug").agg(F.round(F.abs(F.avg("diff")) * 20, 6).alias("p"))
    return _round(ex.holm(p, "p"), "p_holm")


@query(with_views("predictions", f""", {MEANS} SELECT count(*) AS n, round(corr(base, diff), 6) AS r, round(regr_slope(diff, base), 6) AS slope, round(regr_intercept(diff, base), 6) AS intercept FROM g"""))
def gain_baseline_corr(spark, d):
    return _round(ex.correlation(ex.against(ex.seq_means(_runs(spark, d)), BASE), "base", "diff"), "r", "slope", "intercept").select("n", "r", "slope", "intercept")


@query(with_views("predictions", f""", {MEANS}, k AS (SELECT count(DISTINCT aug) AS k FROM m), f AS (SELECT * FROM m WHERE seq IN (SELECT seq FROM m GROUP BY 1 HAVING count(*) = (SELECT k FROM k))),
  a AS (SELECT sum((x - (SELECT avg(v) FROM f)) ** 2) AS sa FROM (SELECT avg(v) AS x FROM f GROUP BY aug)),
  s AS (SELECT sum((x - (SELECT avg(v) FROM f)) ** 2) AS ss FROM (SELECT avg(v) AS x FROM f GROUP BY seq)),
  z AS (SELECT sa * (SELECT count(DISTINCT seq) FROM f) AS ss_method, ss * (SELECT k FROM k) AS ss_seq, (SELECT var_pop(v) * count(*) FROM f) AS total, (SELECT k FROM k) AS k, (SELECT count(DISTINCT seq) FROM f) AS n FROM a, s)
  SELECT round(ss_method, 6) AS ss_method, round(ss_seq, 6) AS ss_seq, round(total - ss_method - ss_seq, 6) AS ss_error, k - 1 AS df_method, (k - 1) * (n - 1) AS df_error,
    round((ss_method / (k - 1)) / ((total - ss_method - ss_seq) / ((k - 1) * (n - 1))), 5) AS f, round(ss_method / total, 6) AS eta_g FROM z"""))
def rm_anova_ss(spark, d):
    return _round(ex.repeated_measures(ex.seq_means(_runs(spark, d))).withColumn("f", F.round("f", 5)).drop("p"), "ss_method", "ss_seq", "ss_error", "eta_g")


RM = """k AS (SELECT count(DISTINCT aug) AS k FROM m), f AS (SELECT * FROM m WHERE seq IN (SELECT seq FROM m GROUP BY 1 HAVING count(*) = (SELECT k FROM k))),
  a AS (SELECT sum((x - (SELECT avg(v) FROM f)) ** 2) AS sa FROM (SELECT avg(v) AS x FROM f GROUP BY aug)), s AS (SELECT sum((x - (SELECT avg(v) FROM f)) ** 2) AS ss FROM (SELECT avg(v) AS x FROM f GROUP BY seq)),
  z AS (SELECT sa * (SELECT count(DISTINCT seq) FROM f) AS ss_method, ss * (SELECT k FROM k) AS ss_seq, (SELECT var_pop(v) * count(*) FROM f) AS total, (SELECT k FROM k) AS k, (SELECT count(DISTINCT seq) FROM f) AS n FROM a, s),
  w AS (SELECT *, total - ss_method - ss_seq AS ss_error, k - 1 AS df_method, (k - 1) * (n - 1) AS df_error, (ss_method / (k - 1)) / ((total - ss_method - ss_seq) / ((k - 1) * (n - 1))) AS f FROM z)"""


@query(with_views("predictions", f""", {MEANS}, {RM} SELECT df_method, df_error, round(f, 5) AS f, round({f_p("f", "df_method", "df_error")}, 6) AS p, round(ss_method / total, 6) AS eta_g FROM w"""))
def rm_anova_p(spark, d):
    return _round(ex.repeated_measures(ex.seq_means(_runs(spark, d))).withColumn("f", F.round("f", 5)).select("df_method", "df_error", "f", "p", "eta_g"), "p", "eta_g")


@query(with_views("predictions", f""", {MEANS}, {RM}, cv AS (SELECT x.aug AS a, y.aug AS b, covar_samp(x.v, y.v) AS c, count(*) AS n FROM f x JOIN f y USING (seq) GROUP BY 1, 2),
  e AS (SELECT a, b, n, c - avg(c) OVER (PARTITION BY a) - avg(c) OVER (PARTITION BY b) + avg(c) OVER () AS d FROM cv)
  SELECT CAST(count(DISTINCT a) AS INT) AS k, max(n) AS n, round(pow(sum(d) FILTER (a = b), 2) / ((count(DISTINCT a) - 1) * sum(d * d)), 6) AS eps FROM e"""))
def rm_anova_epsilon(spark, d):
    """Greenhouse and Geisser's epsilon."""
    return _round(ex.sphericity(ex.seq_means(_runs(spark, d))), "eps").select("k", "n", "eps")


@query()
def rm_anova_sphericity(spark, d):
    """Mauchly's test; no statement, as it takes a determinant. A fixture checks it against numpy."""
    return _round(ex.sphericity(ex.seq_means(_runs(spark, d))), "eps", "w", "chi2", "p")


@query(with_views("predictions", f""", {MEANS}, co AS (SELECT count(*) AS n, corr(base, diff) AS r FROM g), t AS (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM co)
  SELECT n, round(r, 6) AS r, round(t, 5) AS t, round({t_p("t", "(n - 2)")}, 6) AS p FROM t"""))
def gain_baseline_p(spark, d):
    """Correlation of the gain with the baseline, with its t and p."""
    x = ex.correlation(ex.against(ex.seq_means(_runs(spark, d)), BASE), "base", "diff").withColumn("t", F.round("t", 5))
    return _round(x, "r", "p").select("n", "r", "t", "p")


@query(with_views("predictions", f""", {MEANS}, b AS (SELECT seq, aug FROM m QUALIFY row_number() OVER (PARTITION BY seq ORDER BY round(v, 9) DESC, aug) = 1) SELECT aug, count(*) AS n FROM b GROUP BY 1"""))
def best_aug_counts(spark, d):
    return ex.best_counts(ex.best_method(ex.seq_means(_runs(spark, d)), BASE))


SEPARATION = """x AS (SELECT label, class_of, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM (SELECT label, vec_id % 2 AS class_of, v FROM vectors)), ce AS (SELECT label, class_of, i, avg(x) AS m, count(*) AS n, sum(x * x) AS q FROM x GROUP BY 1, 2, 3),
s AS (SELECT a.label, (SELECT sum(m * m) FROM ce WHERE ce.label = a.label AND class_of = 0) + (SELECT sum(m * m) FROM ce WHERE ce.label = a.label AND class_of = 1) - 2 * sum(a.m * b.m) AS separation FROM ce a JOIN ce b ON a.label = b.label AND a.i = b.i AND a.class_of = 0 AND b.class_of = 1 GROUP BY 1)"""


@query(with_views("predictions vectors", f""", {MEANS}, {SEPARATION}, j AS (SELECT g.aug, g.diff, s.separation FROM g JOIN s ON s.label = g.seq)
  SELECT aug, count(*) AS n, round(corr(separation, diff), 5) AS r FROM j GROUP BY 1"""))
def gain_separation_corr(spark, d):
    """Of each method the correlation of its gain in a sequence with how far apart the sequence's two groups of vectors lie."""
    from textloom.operators import similarity as sim
    from textloom.sources.views import vectors

    v = vectors(spark, d).withColumn("class_of", F.pmod("vec_id", F.lit(2)))
    s = sim.separation(v, "label", "class_of").select(F.col("label").alias("seq"), "separation")
    j = ex.against(ex.seq_means(_runs(spark, d)), BASE).join(s, "seq")
    return j.groupBy("aug").agg(F.count("*").alias("n"), F.round(F.corr("separation", "diff"), 5).alias("r"))


@query(with_views("predictions vectors", f""", {MEANS}, {SEPARATION}, d AS (SELECT seq, avg(diff) AS gain FROM g GROUP BY 1), l AS (SELECT label, CAST(count(*) AS DOUBLE) AS n, avg(list_dot_product(v, v)) AS norm, avg(vec_id) AS mean_id FROM vectors GROUP BY 1),
  u AS (SELECT 'separation' AS covariate, separation AS x, gain FROM s JOIN d ON d.seq = s.label UNION ALL SELECT 'size', n, gain FROM l JOIN d ON d.seq = l.label UNION ALL SELECT 'mean_id', mean_id, gain FROM l JOIN d ON d.seq = l.label),
  r AS (SELECT covariate, round(corr(x, gain), 5) AS r FROM u GROUP BY 1) SELECT covariate, r, CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, covariate) AS INT) AS place FROM r"""))
def covariate_ranking(spark, d):
    """Covariates of the sequences by the strength of their correlation with the mean gain."""
    from pyspark.sql import Window

    from textloom.operators import similarity as sim
    from textloom.sources.views import vectors

    v = vectors(spark, d).withColumn("class_of", F.pmod("vec_id", F.lit(2)))
    more = v.groupBy("label").agg(F.count("*").cast("double").alias("size"), F.avg("vec_id").alias("mean_id"))
    x = sim.separation(v, "label", "class_of").join(more, "label").select(F.col("label").alias("seq"), F.explode(F.create_map(*[y for c in ("separation", "size", "mean_id") for y in (F.lit(c), F.col(c))])).alias("covariate", "x"))
    gain = ex.against(ex.seq_means(_runs(spark, d)), BASE).groupBy("seq").agg(F.avg("diff").alias("gain"))
    r = x.join(gain, "seq").groupBy("covariate").agg(F.round(F.corr("x", "gain"), 5).alias("r"))
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs("r")), "covariate")))  # a row for each covariate


@query(with_views("predictions", f", {MEANS} SELECT seq, aug, rank() OVER (PARTITION BY seq ORDER BY round(v, 9) DESC) AS rank FROM m"))
def method_rank(spark, d):
    return ex.ranks(ex.seq_means(_runs(spark, d)).withColumn("v", F.round("v", 9)), ["seq"], "v").select("seq", "aug", F.col("rank").cast("bigint").alias("rank"))
