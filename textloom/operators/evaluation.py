"""Scoring binary classifiers: threshold metrics, precision-recall curves, average precision, resampled prevalence.

Tables of predictions have the columns score (of the positive class), label (0 or 1) and those that name a run. Ties in
the score are one point of a curve, so every curve is first collapsed to one row for each run and score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def positive_probability(logit0: Column, logit1: Column) -> Column:
    """Softmax of two logits."""
    return 1 / (1 + F.exp(logit0 - logit1))


def confusion(df: DataFrame, run: list[str], threshold: float = 0.5) -> DataFrame:
    """(run, tp, fp, fn, tn): a score of the threshold or more is a positive prediction."""
    hit = F.col("score") >= threshold
    one = F.col("label") == 1
    return df.groupBy(*run).agg(F.count_if(hit & one).alias("tp"), F.count_if(hit & ~one).alias("fp"), F.count_if(~hit & one).alias("fn"), F.count_if(~hit & ~one).alias("tn"))


def scores_of(c: DataFrame, inverted: bool = False) -> DataFrame:
    """precision, recall, f1 and accuracy of confusion counts; inverted: of the negative class."""
    tp, fp, fn = (F.col(x) for x in (("tn", "fn", "fp") if inverted else ("tp", "fp", "fn")))
    right = F.col("tp") + F.col("tn")
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(right, right + F.col("fp") + F.col("fn"))})


def f1_at(df: DataFrame, run: list[str], thresholds: list[float]) -> DataFrame:
    """(run, threshold, f1) with one pass over the predictions, however many thresholds."""
    counts = []
    for t in thresholds:
        tp, fp, fn = F.count_if((F.col("score") >= t) & (F.col("label") == 1)), F.count_if((F.col("score") >= t) & (F.col("label") == 0)), F.count_if((F.col("score") < t) & (F.col("label") == 1))
        counts.append(F.struct(F.lit(t).alias("threshold"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")))
    return df.groupBy(*run).agg(F.array(*counts).alias("x")).select(*run, F.inline("x"))


def curve(df: DataFrame, run: list[str]) -> DataFrame:
    """(run, score, tp, fp, pos, neg, precision, recall, fpr): one point for each distinct score, counted from the top."""
    points = df.groupBy(*run, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    w = Window.partitionBy(*run)
    down = w.orderBy(F.desc("score"))
    c = points.select(*run, "score", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(w).alias("pos"), F.sum("n").over(w).alias("neg"))
    return c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("pos")), "fpr": ratio(F.col("fp"), F.col("neg"))})


def with_end(c: DataFrame, run: list[str]) -> DataFrame:
    """(run, score, precision, recall) of a curve with its last point: precision 1 at recall 0, without a score."""
    end = c.select(*run).distinct().select(*run, F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return c.select(*run, "score", "precision", "recall").unionByName(end)


def micro_f1(df: DataFrame, labels: Column, predicted: Column) -> DataFrame:
    """(tp, n_labels, n_predicted, f1) over all labels of rows with arrays of labels and of predictions."""
    sums = df.agg(F.sum(F.size(F.array_intersect(labels, predicted))).alias("tp"), F.sum(F.size(F.array_distinct(labels))).alias("n_labels"), F.sum(F.size(F.array_distinct(predicted))).alias("n_predicted"))
    return sums.withColumn("f1", ratio(2 * F.col("tp"), F.col("n_labels") + F.col("n_predicted")))


def average_precision(c: DataFrame, run: list[str]) -> DataFrame:
    """(run, ap) of a curve: the sum of precision times the step in recall."""
    before = F.coalesce(F.lag("recall").over(Window.partitionBy(*run).orderBy(F.desc("score"))), F.lit(0.0))
    return c.withColumn("step", (F.col("recall") - before) * F.col("precision")).groupBy(*run).agg(F.sum("step").alias("ap"))


def best_f1(c: DataFrame, run: list[str]) -> DataFrame:
    """(run, f1, threshold) of a curve: the best f1, at the smallest threshold that reaches it."""
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos"))
    top = F.max(F.struct(F.round(f1, 12).alias("f1"), (-F.col("score")).alias("minus")))
    return c.groupBy(*run).agg(top.alias("t")).select(*run, F.col("t.f1").alias("f1"), (-F.col("t.minus")).alias("threshold"))


def envelope_on_grid(c: DataFrame, run: list[str], steps: int) -> DataFrame:
    """(run, r, precision): the monotone envelope of a curve, interpolated at recall 0, 1 / steps, ... 1.

    The envelope at a recall is the best precision at that recall or more; between points it is interpolated in a line.
    """
    points = c.groupBy(*run, "recall").agg(F.max("precision").alias("precision"))
    up = Window.partitionBy(*run).orderBy("recall")
    env = points.withColumn("env", F.max("precision").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    env = env.withColumns({"r0": F.coalesce(F.lag("recall").over(up), F.lit(0.0)), "e0": F.lag("env").over(up)})
    env = env.withColumn("e0", F.coalesce("e0", F.lit(1.0)))
    # each segment makes its own grid points, so no run is compared with the whole grid
    first = F.when(F.col("r0") == 0, F.when(F.col("recall") > 0, 0).otherwise(1)).otherwise(F.floor(F.col("r0") * steps + 1e-9) + 1).cast("int")
    last = F.floor(F.col("recall") * steps + 1e-9).cast("int")
    seg = env.withColumns({"a": first, "b": last}).where("a <= b").withColumn("k", F.explode(F.sequence("a", "b")))
    r = F.col("k") / steps
    line = F.when(F.col("recall") > F.col("r0"), F.col("e0") + (F.col("env") - F.col("e0")) * (r - F.col("r0")) / (F.col("recall") - F.col("r0"))).otherwise(F.col("env"))
    return seg.select(*run, r.alias("r"), line.alias("precision"))


def two_level(df: DataFrame, method: str, unit: str, value: str) -> DataFrame:
    """(method, n, mean, std, se): the mean over units of the mean within each, with the sample deviation over units."""
    each = df.groupBy(method, unit).agg(F.avg(value).alias("v"))
    return each.groupBy(method).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).withColumn("se", F.col("std") / F.sqrt("n"))
