"""Problem 2: samples that match given category shares, and the categories that can't be met."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.plans.lineage import table

#: Spellings of each category, trimmed and in lower case (fixed values of the data).
SPELLINGS = {"Yes": ("yes", "y", "1", "true"), "No": ("no", "n", "0", "false"), "Unsure": ("unsure", "?"), "Mixed": ("mixed",)}
#: Rows of all reservoirs together that a task holds; beyond, it gives them out and begins new ones, to be merged.
HELD = 1_000_000
RESERVOIR = "run string, cls string, rank long, row_id long"


def category(label: Column) -> Column:
    """The category of a label in any spelling, or null."""
    bare = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for name, spelled in SPELLINGS.items():
        out = F.when(bare.isin(*spelled), F.lit(name)).otherwise(out)
    return out


def needs(targets: DataFrame) -> DataFrame:
    """(run, class_label, cls, needed): the larger of min_rows and the target's share of the sample, rounded up."""
    share = F.ceil(F.col("target_pct") * F.col("sample_size") / 100)
    return targets.select("run", "class_label", category(F.col("class_label")).alias("cls"), F.greatest("min_rows", share).cast("long").alias("needed"))


def _usable(pool: DataFrame) -> DataFrame:
    """The rows with a category and a letter or digit."""
    return pool.where(F.col("Text").rlike(r"[\p{L}\p{N}]")).withColumn("cls", category(F.col("class_label"))).where("cls IS NOT NULL")


def quotas(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """(run, class_label, needed, available, quota, cls) for each row of targets, by counting all distinct texts.

    pool(row_id, run, class_label, Text), targets(run, class_label, target_pct, min_rows, sample_size). Available are the
    distinct Texts with a letter or digit; the quota is the smaller. Null runs match nothing; unknown labels have no
    category; rows of targets given twice appear twice; a category without any row has 0 available.
    """
    texts = _usable(pool).select("run", "cls", "Text").distinct().groupBy("run", "cls").agg(F.count("*").alias("available"))
    joined = needs(targets).join(texts, ["run", "cls"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return joined.withColumn("quota", F.least("needed", "available"))


def _fill(size: int):
    """The reservoirs of a task: of each run and category the ``size`` texts of smallest rank, each once, with its smallest id."""

    def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        x = pd.concat(parts).sort_values(["run", "cls", "rank", "row_id"], kind="stable").drop_duplicates(["run", "cls", "rank"])
        return x[x.groupby(["run", "cls"]).cumcount() < size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, n = None, [], 0
        for batch in batches:
            fresh.append(batch.to_pandas())
            n += batch.num_rows
            if n >= 100_000:
                held, fresh, n = merged([*([held] if held is not None else []), *fresh]), [], 0
                if len(held) > HELD:
                    yield pa.RecordBatch.from_pandas(held, preserve_index=False)
                    held = None
        rest = [*([held] if held is not None else []), *fresh]
        if rest:
            yield pa.RecordBatch.from_pandas(merged(rest), preserve_index=False)

    return run


def reservoirs(pool: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(run, cls, rank, row_id): of each run and category a uniform sample of ``size`` distinct texts, or all if there are fewer.

    A text's rank is the hash of seed and text, so every text is as likely as another, however many copies it has, and
    a reservoir is the texts of smallest rank. Each task fills reservoirs from the rows that it reads, in one pass; they
    merge by keeping the smallest ranks again: copies of one text meet by their rank, never by category, and the ranks
    beyond the size are cut off before and after the last shuffle, so a hot category is at most size rows of a task.
    """
    rows = _usable(pool).where("run IS NOT NULL AND row_id IS NOT NULL").select("run", "cls", F.xxhash64(F.lit(seed), "Text").alias("rank"), "row_id")
    kept = rows.mapInArrow(_fill(max(1, size)), RESERVOIR).groupBy("run", "cls", "rank").agg(F.min("row_id").alias("row_id"))
    place = F.row_number().over(Window.partitionBy("run", "cls").orderBy("rank"))
    return kept.withColumn("place", place).where(F.col("place") <= size)


def filled(pool: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(reservoirs, plan): plan is (run, class_label, cls, needed, held), where held below needed says that the category is
    exhausted, as its reservoir then has all its texts."""
    need = needs(targets)
    size = need.agg(F.max("needed")).first()[0] or 0
    kept = reservoirs(pool, size, seed)
    held = kept.groupBy("run", "cls").agg(F.count("*").alias("held"))
    return kept, need.join(held, ["run", "cls"], "left").withColumn("held", F.coalesce("held", F.lit(0)))


def exhausted(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """(run, class_label, needed, held): the rows of targets whose reservoir could not be filled to the need."""
    return filled(pool, targets)[1].where("held < needed").select("run", "class_label", "needed", "held")


def sample_to_targets(pool: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(run, class_label, row_id): of each row of targets its quota of rows, one for each distinct text: the need, or all
    texts of an exhausted category. A smaller sample of the same seed is part of a larger one."""
    kept, plan = filled(pool, targets, seed)
    plan = plan.select("run", "cls", "class_label", "needed").distinct()
    return kept.join(plan, ["run", "cls"]).where("place <= needed").select("run", "class_label", "row_id")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "candidate_pool"), table(spark, sf_dir, "target_mix")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, class_label): rows of target_mix that can't be met from candidate_pool."""
    return exhausted(*_tables(spark, sf_dir)).select("run", "class_label")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, class_label, needed, available, taken): each target with what the sample takes of it."""
    pool, targets = _tables(spark, sf_dir)
    taken = sample_to_targets(pool, targets).groupBy("run", "class_label").agg(F.count("*").alias("taken"))
    out = quotas(pool, targets).join(taken, ["run", "class_label"], "left")
    return out.select("run", "class_label", "needed", "available", F.coalesce("taken", F.lit(0)).alias("taken"))


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, class_label, row_id) of the sample."""
    return sample_to_targets(*_tables(spark, sf_dir))


_COUNTED = r"""
WITH pool AS (
  SELECT run, CASE WHEN l IN ('yes','y','1','true') THEN 'Yes' WHEN l IN ('no','n','0','false') THEN 'No'
    WHEN l IN ('unsure','?') THEN 'Unsure' WHEN l = 'mixed' THEN 'Mixed' END AS cls, Text
  FROM (SELECT run, Text, lower(regexp_replace(class_label, '^\s+|\s+$', '', 'g')) AS l FROM candidate_pool)
  WHERE regexp_matches(Text, '[\p{L}\p{N}]')),
have AS (SELECT run, cls, count(DISTINCT Text) AS n FROM pool WHERE cls IS NOT NULL GROUP BY run, cls),
plan AS (
  SELECT t.run, t.class_label, greatest(t.min_rows, CAST(ceil(t.target_pct * t.sample_size / 100.0) AS BIGINT)) AS needed,
    coalesce(h.n, 0) AS available
  FROM target_mix t LEFT JOIN have h ON h.run = t.run AND h.cls = t.class_label)
"""

ORACLES = {
    "p2_found": _COUNTED + "SELECT run, class_label FROM plan WHERE needed > available",
    "p2_report": _COUNTED + "SELECT run, class_label, CAST(needed AS BIGINT) AS needed, available, least(needed, available) AS taken FROM plan",
}
