"""Planning of generated texts: template quotas, reuse of what a pool has, nested data sets, selection statistics.

The generating call itself is a function that is passed in; everything around it is a plan or a bookkeeping table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def template_plan(base: DataFrame, pool: DataFrame, each: int) -> DataFrame:
    """(template_idx, have, reuse, generate, next_gen): what each template of base still needs to be used ``each`` times.

    Rows of pool(template_idx, gen_num) are reused first; new ones are numbered after the largest gen_num."""
    have = pool.groupBy("template_idx").agg(F.count("*").alias("have"), F.max("gen_num").alias("last"))
    n = F.coalesce("have", F.lit(0))
    plan = base.select("template_idx").distinct().join(have, "template_idx", "left")
    return plan.select("template_idx", n.alias("have"), F.least(n, F.lit(each)).alias("reuse"), F.greatest(F.lit(each) - n, F.lit(0)).alias("generate"), (F.coalesce("last", F.lit(0)) + 1).alias("next_gen"))


def reused(pool: DataFrame, each: int) -> DataFrame:
    """The first ``each`` rows of every template by gen_num: a smaller request is always part of a larger one."""
    w = Window.partitionBy("template_idx").orderBy("gen_num")
    return pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each)


def to_generate(plan: DataFrame) -> DataFrame:
    """(template_idx, gen_num): one row for each text that is to be generated."""
    p = plan.where("generate > 0")
    return p.select("template_idx", F.explode(F.sequence(F.col("next_gen"), F.col("next_gen") + F.col("generate") - 1)).alias("gen_num"))


def linked_templates(pool: DataFrame, base: DataFrame) -> DataFrame:
    """(row_id, template_idx): generated rows joined to the template whose Text is their example; of equal templates the
    last wins, and a row whose example is no template's text is left out."""
    last = base.where(F.col("Text").isNotNull()).groupBy(F.col("Text").alias("example")).agg(F.max("template_idx").alias("template_idx"))
    return pool.where(F.col("example").isNotNull()).select("row_id", "example").join(last, "example").select("row_id", "template_idx")


def growth_plan(sizes: DataFrame) -> DataFrame:
    """(step, size, added, n_yes, n_no) of sizes(step, size): what each step adds, and running totals of balanced halves.

    A table of steps has a few rows, so one ordered window is small."""
    w = Window.orderBy("step")
    added = F.col("size") - F.coalesce(F.lag("size").over(w), F.lit(0))
    up = sizes.withColumn("added", added)
    total = F.sum(F.floor(F.col("added") / 2)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return up.select("step", "size", "added", total.alias("n_yes"), (F.sum("added").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - total).alias("n_no"))


def selection_stats(base: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(class_label, row_id, selected_count, iteration_count) over base and synthetic rows of a selection loop.

    base(class_label, row_id); synthetic(class_label, row_id, iteration, parent_a, parent_b) has a row for each iteration.
    Each text counts how often it was a parent, and for how many iterations it was in the pool."""
    rounds = synthetic.groupBy("class_label").agg(F.max("iteration").alias("rounds"))
    parents = synthetic.select(F.explode(F.array("parent_a", "parent_b")).alias("row_id")).groupBy("row_id").agg(F.count("*").alias("selected_count"))
    rows = base.select("class_label", "row_id", F.lit(0).cast("long").alias("iteration")).unionByName(synthetic.select("class_label", "row_id", F.col("iteration").cast("long").alias("iteration")))
    out = rows.join(rounds, "class_label", "left").join(parents, "row_id", "left")
    return out.select("class_label", "row_id", F.coalesce("selected_count", F.lit(0)).alias("selected_count"), (F.coalesce("rounds", F.lit(0)) - F.col("iteration")).alias("iteration_count"))
