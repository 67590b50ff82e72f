"""The labelled-text, vector and prediction views that the operators work on, over the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.plans.lineage import table

YES, NO = ("yes", "y", "1", "true"), ("no", "n", "0", "false")


def yes_no(label: Column) -> Column:
    """Yes or No in any of their spellings, trimmed and in any letter case; anything else is null."""
    bare = F.lower(F.trim(label))
    return F.when(bare.isin(*YES), "Yes").when(bare.isin(*NO), "No")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """general_claim with one row for each id (the first added), label and topic brought to one spelling."""
    rest = F.struct("Text", "class_label", "topic", "source", "style")
    raw = table(spark, sf_dir, "general_claim").groupBy("Sentence_id").agg(F.min_by(rest, F.struct("added_at", "stated_at", "Text")).alias("r")).select("Sentence_id", "r.*")
    return raw.select("Sentence_id", "Text", yes_no(F.col("class_label")).alias("class_label"), F.lower(F.trim("topic")).alias("topic"), "source", "style")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_pool with Yes, No or null labels."""
    return table(spark, sf_dir, "candidate_pool").select("row_id", "run", F.lower(F.trim("topic")).alias("topic"), yes_no(F.col("class_label")).alias("class_label"), "Text")


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """template_sequence with empty examples as null."""
    raw = table(spark, sf_dir, "template_sequence")
    return raw.select("row_id", "seq", "template_idx", "gen_num", "Text", yes_no(F.col("class_label")).alias("class_label"), F.expr("nullif(example, '')").alias("example"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as doubles, with class Yes for labels under 5 and the split: the first 32 of each class by hash are refs."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label", F.when(F.col("label") < 5, "Yes").otherwise("No").alias("class_label"))
    order = Window.partitionBy("class_label").orderBy(F.md5(F.concat(F.lit("42:"), F.col("vec_id").cast("string"))), "vec_id")
    first = v.select("vec_id", "class_label").withColumn("n", F.row_number().over(order)).where("n <= 32")  # cut off before the shuffle
    return v.join(F.broadcast(first.select("vec_id", F.lit(True).alias("is_ref"))), "vec_id", "left").withColumn("is_ref", F.coalesce("is_ref", F.lit(False)))  # 64 ids


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored row of one run each, over events: 5 methods x 15 sequences x 3 seeds."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("aug"), F.pmod("user_id", F.lit(15)).cast("int").alias("seq"), F.pmod("event_id", F.lit(3)).cast("int").alias("seed"), F.col("event_id").alias("row_id"),
        F.round(F.col("value") / (F.col("value") + 50), 3).alias("score"), (F.get_json_object("props", "$.k").cast("int") >= 75).cast("int").alias("label"),
    )


#: The same views for DuckDB, by name; a query names those it needs.
SQL = {
    "claims": """claims AS (
  SELECT Sentence_id, Text, CASE WHEN lower(trim(class_label)) IN ('yes','y','1','true') THEN 'Yes'
    WHEN lower(trim(class_label)) IN ('no','n','0','false') THEN 'No' END AS class_label, lower(trim(topic)) AS topic, source, style
  FROM general_claim
  QUALIFY row_number() OVER (PARTITION BY Sentence_id ORDER BY added_at NULLS FIRST, stated_at NULLS FIRST, Text NULLS FIRST) = 1)""",
    "pool": """pool AS (
  SELECT row_id, run, lower(trim(topic)) AS topic, CASE WHEN lower(trim(class_label)) IN ('yes','y','1','true') THEN 'Yes'
    WHEN lower(trim(class_label)) IN ('no','n','0','false') THEN 'No' END AS class_label, Text FROM candidate_pool)""",
    "templates": """templates AS (
  SELECT row_id, seq, template_idx, gen_num, Text, CASE WHEN lower(trim(class_label)) IN ('yes','y','1','true') THEN 'Yes'
    WHEN lower(trim(class_label)) IN ('no','n','0','false') THEN 'No' END AS class_label, nullif(example, '') AS example FROM template_sequence)""",
    "vectors": """vectors AS (
  SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY md5('42:' || vec_id), vec_id) <= 32 AS is_ref
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, CASE WHEN label < 5 THEN 'Yes' ELSE 'No' END AS class_label FROM embeddings))""",
    "predictions": """predictions AS (
  SELECT event_type AS aug, CAST(user_id % 15 AS INT) AS seq, CAST(event_id % 3 AS INT) AS seed, event_id AS row_id,
    round(value / (value + 50), 3) AS score, CAST(CAST(json_extract_string(props, '$.k') AS INT) >= 75 AS INT) AS label FROM events)""",
}


def with_views(names: str, body: str) -> str:
    """A DuckDB statement over the named views; body may start with further common tables after a comma."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names.split()) + ("" if body.lstrip().startswith(",") else "\n") + body
