"""Comparing experiments: runs of methods over sequences and seeds.

A table of runs has the columns aug (method), seq, seed and value. Seeds are averaged within each sequence first, so a
sequence counts once however many seeds it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.tails import chi2_p_value, f_p_value, t_p_value
from textloom.plans.lineage import cut

TIE = 1e-6


def seq_means(runs: DataFrame) -> DataFrame:
    """(aug, seq, v): means over the seeds."""
    return runs.groupBy("aug", "seq").agg(F.avg("value").alias("v"))


def against(means: DataFrame, baseline: str) -> DataFrame:
    """(aug, seq, v, base, diff) on the sequences that both have; the baseline itself is left out."""
    base = means.where(F.col("aug") == baseline).select("seq", F.col("v").alias("base"))
    return means.where(F.col("aug") != baseline).join(base, "seq").withColumn("diff", F.col("v") - F.col("base"))


def summary(means: DataFrame, baseline: str) -> DataFrame:
    """(aug, n_seq, mean, std, diff): the population deviation over sequences, the mean difference to the baseline."""
    s = means.groupBy("aug").agg(F.count("*").alias("n_seq"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return s.join(against(means, baseline).groupBy("aug").agg(F.avg("diff").alias("diff")), "aug", "left")


def pivot_with_margin(means: DataFrame, methods: list[str]) -> DataFrame:
    """(seq, one column for each method): means, with a last row of column means whose seq is null."""
    columns = [F.avg(F.when(F.col("aug") == x, F.col("v"))).alias(x) for x in methods]
    return means.groupingSets([[F.col("seq")], []], "seq").agg(*columns).select("seq", *methods)


def win_rates(means: DataFrame, baseline: str) -> DataFrame:
    """(aug, wins, ties, losses, rate): sequences where the method is better, differences within TIE are ties."""
    d = against(means, baseline).groupBy("aug").agg(F.count_if(F.col("diff") > TIE).alias("wins"), F.count_if(F.abs("diff") <= TIE).alias("ties"), F.count_if(F.col("diff") < -TIE).alias("losses"))
    return d.withColumn("rate", F.col("wins") / (F.col("wins") + F.col("ties") + F.col("losses")))


def best_method(means: DataFrame, baseline: str) -> DataFrame:
    """(seq, aug, gain): the best method of each sequence (ties to the first name) and its gain over the baseline."""
    w = Window.partitionBy("seq").orderBy(F.desc(F.round("v", 9)), "aug")
    best = means.withColumn("n", F.row_number().over(w)).where("n = 1")
    base = means.where(F.col("aug") == baseline).select("seq", F.col("v").alias("base"))
    return best.join(base, "seq", "left").select("seq", "aug", (F.col("v") - F.col("base")).alias("gain"))


def incomplete(runs: DataFrame, seeds: int) -> DataFrame:
    """(aug, seq, n): combinations of a known method and sequence that have fewer runs than seeds, none included."""
    # both sides are distinct keys of the experiment, a handful of methods and sequences
    every = runs.select("aug").distinct().crossJoin(runs.select("seq").distinct())
    n = runs.groupBy("aug", "seq").agg(F.count("*").alias("n"))
    return every.join(n, ["aug", "seq"], "left").select("aug", "seq", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < seeds)


def seed_variance(runs: DataFrame) -> DataFrame:
    """(aug, seq, n, std): the sample deviation over the seeds, where there are two or more."""
    return runs.groupBy("aug", "seq").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("std")).where("n > 1")


def paired_tests(means: DataFrame, baseline: str) -> DataFrame:
    """(aug, n, t, p, p_holm, mean_diff, hedges_g) of each method against the baseline; two sequences at least.

    Holm's correction is over the methods tested. Without variance t is null, and so is p."""
    a = against(means, baseline).groupBy("aug").agg(
        F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd"),
        F.var_samp("v").alias("va"), F.var_samp("base").alias("vb"),
    ).where("n >= 2")
    t = F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))
    g = F.try_divide(F.col("mean_diff"), F.sqrt((F.col("va") + F.col("vb")) / 2)) * (1 - 3 / (4 * (2 * F.col("n") - 2) - 1))
    a = a.withColumns({"t": t, "hedges_g": g}).withColumn("p", t_p_value("t", F.col("n") - 1))
    return holm(a, "p").select("aug", "n", "t", "p", "p_holm", "mean_diff", "hedges_g")


def holm(df: DataFrame, p: str) -> DataFrame:
    """df with p_holm, the step-down correction over the whole table (one row for each test); null p stays null."""
    known = F.count(p).over(Window.partitionBy())
    order = Window.partitionBy(F.col(p).isNull()).orderBy(p, *[c for c in df.columns[:1]])
    scaled = df.withColumn("_s", F.col(p) * (known - F.row_number().over(order) + 1))
    return scaled.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))).drop("_s")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, t, p, slope, intercept) of y on x; fewer than three rows give null t and p."""
    c = df.agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    t = F.when(F.col("n") >= 3, F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))
    return c.withColumn("t", t).withColumn("p", t_p_value("t", F.col("n") - 2))


def complete(means: DataFrame) -> DataFrame:
    """The means of the sequences that every method has, a row for each method and sequence, written once."""
    means = cut(means)
    k = means.agg(F.count_distinct("aug").alias("k"))
    full = means.groupBy("seq").agg(F.count_distinct("aug").alias("have")).join(F.broadcast(k)).where("have = k").select("seq")  # one row
    return cut(means.join(full, "seq", "left_semi"))


def _spectrum(batches):
    """(w) of rows (c, k): the determinant of the contrasts' covariance over that of a sphere of the same trace, from the
    doubly centred covariance matrix c, a row of k * k numbers."""
    import numpy as np
    import pandas as pd

    for pdf in batches:
        out = []
        for c, k in zip(pdf["c"], pdf["k"], strict=True):
            e = np.sort(np.linalg.eigvalsh(np.asarray(c, float).reshape(k, k)))[1:]  # one is 0
            out.append(float(np.prod(e) / e.mean() ** len(e)) if len(e) and e.mean() > 0 else None)
        yield pd.DataFrame({"n": pdf["n"], "k": pdf["k"], "eps": pdf["eps"], "w": pd.array(out, dtype="Float64")})


def sphericity(means: DataFrame) -> DataFrame:
    """(k, n, eps, w, chi2, df, p): Greenhouse and Geisser's epsilon and Mauchly's test over the sequences that every method has.

    The covariances are aggregates of pairs of methods; only their k * k numbers meet in one row."""
    m = complete(means)
    both = m.select("seq", F.col("aug").alias("a"), F.col("v").alias("x")).join(m.select("seq", F.col("aug").alias("b"), F.col("v").alias("y")), "seq")
    c = both.groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"), F.count("*").alias("n"))  # k * k rows from here on
    row, col, all_ = F.avg("c").over(Window.partitionBy("a")), F.avg("c").over(Window.partitionBy("b")), F.avg("c").over(Window.partitionBy())
    centred = c.withColumn("d", F.col("c") - row - col + all_)
    one = centred.agg(F.max("n").alias("n"), F.count_distinct("a").cast("int").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("d"))).alias("t"), F.sum(F.col("d") * F.col("d")).alias("q"), F.array_sort(F.collect_list(F.struct("a", "b", "d"))).alias("z"))
    one = one.select("n", "k", F.try_divide(F.col("t") * F.col("t"), (F.col("k") - 1) * F.col("q")).alias("eps"), F.transform("z", lambda x: x["d"]).alias("c")).where("k > 1")
    w = one.mapInPandas(_spectrum, "n long, k int, eps double, w double")
    p = F.col("k") - 1
    chi2 = -(F.col("n") - 1 - (2 * p * p + p + 2) / (6 * p)) * F.log(F.when(F.col("w") > 0, F.col("w")))
    w = w.withColumns({"chi2": chi2, "df": (F.col("k") * p / 2 - 1).cast("int")})
    return w.withColumn("p", chi2_p_value("chi2", "df")).select("k", "n", "eps", "w", "chi2", "df", "p")


def all_pairs(means: DataFrame, baseline: str) -> DataFrame:
    """(a, b, n, t, p, p_holm, hedges_g) of each pair of methods on the sequences that both have, two at least; a < b by name.

    In pairs with the baseline it's named first, but t and g keep the sign of the order by name. Holm's correction is over
    the pairs with the baseline; others have none."""
    x, y = means.select("seq", F.col("aug").alias("a"), F.col("v").alias("x")), means.select("seq", F.col("aug").alias("b"), F.col("v").alias("y"))
    s = x.join(y, "seq").where("a < b").withColumn("diff", F.col("x") - F.col("y")).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd"), F.var_samp("x").alias("va"), F.var_samp("y").alias("vb"))
    s = s.where("n >= 2").withColumn("t", F.try_divide("mean_diff", F.col("sd") / F.sqrt("n"))).withColumn("p", t_p_value("t", F.col("n") - 1))
    s = s.withColumn("hedges_g", F.try_divide("mean_diff", F.sqrt((F.col("va") + F.col("vb")) / 2)) * (1 - 3 / (4 * (2 * F.col("n") - 2) - 1)))
    swap = F.col("b") == baseline
    s = s.withColumns({"_a": F.when(swap, F.col("b")).otherwise(F.col("a")), "_b": F.when(swap, F.col("a")).otherwise(F.col("b"))})
    s = cut(s.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "n", "t", "p", "hedges_g"))
    own = holm(s.where(F.col("a") == baseline).select("b", "a", "n", "t", "p", "hedges_g"), "p")
    rest = s.where(F.col("a") != baseline).withColumn("p_holm", F.lit(None).cast("double"))
    return own.unionByName(rest).select("a", "b", "n", "t", "p", "p_holm", "hedges_g")


def stars(p: Column) -> Column:
    """'***', '**', '*' or nothing for p below 0.001, 0.01 and 0.05; null stays null."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "")


def best_counts(best: DataFrame) -> DataFrame:
    """(aug, n): in how many sequences each method is the best, of best_method."""
    return best.groupBy("aug").agg(F.count("*").alias("n"))


def on_common(metrics: DataFrame, baseline: str, values: list[str]) -> DataFrame:
    """(aug, n, values): means of values over the sequences that a method shares with the baseline; metrics(aug, seq, values)."""
    base = metrics.where(F.col("aug") == baseline).select("seq").distinct()
    return metrics.join(base, "seq", "left_semi").groupBy("aug").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def repeated_measures(means: DataFrame) -> DataFrame:
    """(ss_method, ss_seq, ss_error, df_method, df_error, f, p, eta_g) over sequences that every method has."""
    m = complete(means)
    grand = m.agg(F.avg("v").alias("g"), F.count_distinct("aug").alias("k"), F.count_distinct("seq").alias("n"), (F.var_pop("v") * F.count("*")).alias("total"))
    aug = m.groupBy("aug").agg(F.avg("v").alias("m")).agg((F.var_pop("m") * F.count("*")).alias("sa"))
    seq = m.groupBy("seq").agg(F.avg("v").alias("m")).agg((F.var_pop("m") * F.count("*")).alias("ss"))
    # one row each
    a = grand.join(F.broadcast(aug)).join(F.broadcast(seq)).withColumns({"ss_method": F.col("sa") * F.col("n"), "ss_seq": F.col("ss") * F.col("k")})
    a = a.withColumn("ss_error", F.col("total") - F.col("ss_method") - F.col("ss_seq")).withColumns({"df_method": F.col("k") - 1, "df_error": (F.col("k") - 1) * (F.col("n") - 1)})
    a = a.withColumn("f", F.try_divide(F.try_divide("ss_method", "df_method"), F.try_divide("ss_error", "df_error")))
    a = a.withColumns({"p": f_p_value("f", "df_method", "df_error"), "eta_g": F.try_divide("ss_method", F.col("ss_method") + F.col("ss_seq") + F.col("ss_error"))})
    return a.select("ss_method", "ss_seq", "ss_error", "df_method", "df_error", "f", "p", "eta_g")


def ranks(df: DataFrame, within: list[str], value: str) -> DataFrame:
    """df with its rank by falling value within each group; equal values share a rank."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*within).orderBy(F.desc(value))))
