"""Queries that draw, split and balance samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import sampling as s
from textloom.plans.lineage import table
from textloom.queries.base import query
from textloom.sources.views import claims, pool, predictions, templates, with_views

ORDER = "md5('42:' || Sentence_id), Sentence_id"
LABELLED = f"""l AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS g, row_number() OVER (PARTITION BY class_label ORDER BY {ORDER}) AS rn,
  count(*) OVER (PARTITION BY class_label) AS n, count(*) OVER () AS total FROM claims WHERE class_label IS NOT NULL)"""


def _labelled(spark, d):
    return claims(spark, d).where("class_label IS NOT NULL").select("Sentence_id", "class_label", "topic")


@query(with_views("claims", f", {LABELLED} SELECT Sentence_id, g AS rn FROM l"))
def shuffle_hash(spark, d):
    return s.ranked_whole(_labelled(spark, d), "Sentence_id").select("Sentence_id", F.col("rn").cast("bigint").alias("rn"))


@query(with_views("claims", f", {LABELLED} SELECT Sentence_id, CASE WHEN g <= floor(total * 4 / 5) THEN 'train' ELSE 'test' END AS part FROM l"))
def ratio_split(spark, d):
    return s.ratio_split(_labelled(spark, d), 4, 1, "Sentence_id").select("Sentence_id", "part")


@query(with_views("claims", f", {LABELLED} SELECT Sentence_id, class_label FROM l WHERE rn <= CASE class_label WHEN 'Yes' THEN 100 ELSE 300 END"))
def stratified_sample(spark, d):
    return s.stratified(_labelled(spark, d), "class_label", {"Yes": 100, "No": 300}, "Sentence_id").select("Sentence_id", "class_label")


@query(with_views("claims", f""", t AS (SELECT Sentence_id, topic, row_number() OVER (PARTITION BY topic ORDER BY {ORDER}) AS rn, count(*) OVER (PARTITION BY topic) AS n FROM claims WHERE topic IS NOT NULL)
  SELECT Sentence_id, topic, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'dev' ELSE 'test' END AS part FROM t"""))
def per_topic_split(spark, d):
    rows = claims(spark, d).where("topic IS NOT NULL").select("Sentence_id", "topic")
    return s.group_split(rows, ["topic"], [("train", 0.7), ("dev", 0.1)], "test", "Sentence_id").select("Sentence_id", "topic", "part")


@query(with_views("claims", f", {LABELLED} SELECT Sentence_id, CASE WHEN rn <= 500 THEN 'train' WHEN rn <= 550 THEN 'dev' ELSE 'rest' END AS part FROM l"))
def fixed_split(spark, d):
    part = F.when(F.col("rn") <= 500, "train").when(F.col("rn") <= 550, "dev").otherwise("rest")
    return s.placed(_labelled(spark, d), ["class_label"], "Sentence_id").select("Sentence_id", part.alias("part"))


@query(with_views("claims", f", {LABELLED} SELECT Sentence_id, CAST(CASE WHEN (rn - 1) // 50 < 4 THEN (rn - 1) // 50 ELSE -1 END AS INT) AS subset FROM l"))
def disjoint_subsets(spark, d):
    return s.disjoint_subsets(_labelled(spark, d), "class_label", 4, 50, "Sentence_id").select("Sentence_id", "subset")


@query(with_views("claims", f", {LABELLED} SELECT CAST(z.size AS INT) AS size, Sentence_id FROM l, (VALUES (400), (200), (100), (50)) z(size) WHERE g <= z.size"))
def halving_sequence(spark, d):
    return s.halvings(_labelled(spark, d), 400, 50, "Sentence_id").select("size", "Sentence_id")


@query(with_views("claims", f""", {LABELLED}, h AS (SELECT count_if(class_label = 'Yes') AS y, count_if(class_label = 'No') AS o FROM l)
  SELECT CAST(z.size AS INT) AS size, Sentence_id FROM l, h, (VALUES (100), (200), (400)) z(size)
  WHERE rn <= least(CASE class_label WHEN 'Yes' THEN y ELSE o END, z.size // 2 + greatest(z.size // 2 - CASE class_label WHEN 'Yes' THEN o ELSE y END, 0))"""))
def nested_balanced_prefix(spark, d):
    return s.balanced_prefixes(_labelled(spark, d), "class_label", ("Yes", "No"), [100, 200, 400], "Sentence_id").select("size", "Sentence_id")


@query(with_views("claims", f""", t AS (SELECT Sentence_id, topic, class_label, row_number() OVER (PARTITION BY topic, class_label ORDER BY {ORDER}) AS rn, count(*) OVER (PARTITION BY topic, class_label) AS n
    FROM claims WHERE topic IS NOT NULL AND class_label IS NOT NULL), m AS (SELECT class_label, min(n) AS least FROM t GROUP BY 1)
  SELECT Sentence_id, topic, class_label FROM t JOIN m USING (class_label) WHERE rn <= least"""))
def equalise_topics(spark, d):
    return s.equalised(_labelled(spark, d).where("topic IS NOT NULL"), "topic", "class_label", "Sentence_id").select("Sentence_id", "topic", "class_label")


@query(with_views("templates", """, l AS (SELECT row_id, example IS NULL AS r, row_number() OVER (PARTITION BY example IS NULL ORDER BY md5('42:' || row_id), row_id) AS rn FROM templates)
  SELECT CAST(z.step AS INT) AS step, row_id, r AS is_real FROM l, range(0, 5) z(step) WHERE rn <= CASE WHEN r THEN floor(80 * (4 - z.step) / 4) ELSE 80 - floor(80 * (4 - z.step) / 4) END"""))
def real_synth_mix(spark, d):
    t = templates(spark, d).withColumn("is_real", F.col("example").isNull())
    return s.mix_grid(t, F.col("is_real"), 80, 4, "row_id").select("step", "row_id", "is_real")


@query(with_views("claims", f", {LABELLED} SELECT Sentence_id, CASE WHEN rn <= 32 THEN 'reference' WHEN rn <= 64 THEN 'fewshot' ELSE 'rest' END AS part FROM l"))
def fewshot_ref_rest(spark, d):
    part = F.when(F.col("rn") <= 32, "reference").when(F.col("rn") <= 64, "fewshot").otherwise("rest")
    return s.placed(_labelled(spark, d), ["class_label"], "Sentence_id").select("Sentence_id", part.alias("part"))


@query(with_views("claims", f", {LABELLED} SELECT CAST((rn - 1) // 60 AS INT) AS seq, CAST((rn - 1) % 60 // 20 AS INT) AS step, Sentence_id FROM l WHERE rn <= 180"))
def incremental_growth(spark, d):
    r = s.ranked(_labelled(spark, d), ["class_label"], "Sentence_id").where("rn <= 180")
    return r.select(F.floor((F.col("rn") - 1) / 60).cast("int").alias("seq"), F.floor((F.col("rn") - 1) % 60 / 20).cast("int").alias("step"), "Sentence_id")


@query("SELECT source, Sentence_id FROM general_claim WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY Sentence_id, added_at) <= 2")
def first_n_per_group(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("Sentence_id", "added_at")
    return table(spark, d, "general_claim").where("source IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("source", "Sentence_id")


@query(with_views("predictions", "SELECT row_id, score FROM predictions ORDER BY score DESC, row_id LIMIT 100"))
def top_bottom_k(spark, d):
    return predictions(spark, d).orderBy(F.desc("score"), "row_id").limit(100).select("row_id", "score")


@query(with_views("predictions", "SELECT row_id, label FROM predictions QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, row_id) <= 50"))
def balanced_top_k(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy(F.desc("score"), "row_id")
    return predictions(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 50").select("row_id", "label")


@query(with_views("predictions", """, r AS (SELECT *, row_number() OVER (PARTITION BY aug, seq, seed, label ORDER BY md5('42:' || row_id), row_id) AS rn,
    sum(label) OVER w AS pos, sum(1 - label) OVER w AS neg FROM predictions WINDOW w AS (PARTITION BY aug, seq, seed)),
  q AS (SELECT *, greatest(1, CAST(round_even(pos * (1 - CAST(0.13 AS DOUBLE)) / CAST(0.13 AS DOUBLE), 0) AS BIGINT)) AS want FROM r),
  t AS (SELECT *, CASE WHEN label = 1 OR pos = 0 THEN 1 ELSE floor((want - rn) / neg) + 1 END AS times FROM q)
  SELECT aug, seq, seed, CAST(sum(times) AS BIGINT) AS n, CAST(sum(times * label) AS BIGINT) AS n_pos FROM t WHERE times > 0 GROUP BY 1, 2, 3"""))
def prevalence_resample(spark, d):
    r = s.resampled(predictions(spark, d), ["aug", "seq", "seed"], "label", 0.13, "row_id")
    return r.groupBy("aug", "seq", "seed").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


@query(with_views("pool", """, l AS (SELECT row_id, run, class_label, row_number() OVER (PARTITION BY run, class_label ORDER BY md5('42:' || row_id), row_id) AS rn FROM pool WHERE class_label IS NOT NULL),
  m AS (SELECT run, least(count_if(class_label = 'Yes'), count_if(class_label = 'No')) AS k FROM l GROUP BY 1)
  SELECT row_id, l.run, class_label FROM l JOIN m ON l.run = m.run WHERE rn <= k"""))
def restore_balance(spark, d):
    p = pool(spark, d).where("class_label IS NOT NULL").select("row_id", "run", "class_label")
    k = p.groupBy("run").agg(F.least(F.count_if(F.col("class_label") == "Yes"), F.count_if(F.col("class_label") == "No")).alias("k"))
    return s.placed(p, ["run", "class_label"], "row_id").join(k, "run").where("rn <= k").select("row_id", "run", "class_label")


@query(with_views("templates", """, e AS (SELECT CAST(epoch AS INT) AS epoch, row_id, class_label, row_number() OVER (PARTITION BY epoch, class_label ORDER BY md5('42:' || epoch || ':' || row_id), row_id) AS rn
    FROM templates, range(0, 3) t(epoch) WHERE gen_num = 0 AND class_label IS NOT NULL)
  SELECT epoch, class_label, CAST((rn - 1) // 5 AS INT) AS batch, row_id FROM e"""))
def prompt_batches(spark, d):
    base = templates(spark, d).where("gen_num = 0 AND class_label IS NOT NULL")
    return s.cycles(base, "row_id", 3, 5, ["class_label"]).select("epoch", "class_label", "batch", "row_id")


@query(with_views("claims", f""", {LABELLED}, d AS (SELECT draw, CAST('0x' || substr(md5('42:' || draw), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS k, CAST('0x' || substr(md5('43:' || draw), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM range(0, 1000) t(draw)),
  x AS (SELECT class_label, n, row_number() OVER (ORDER BY class_label) - 1 AS k, count(*) OVER () AS labels FROM (SELECT DISTINCT class_label, n FROM l))
  SELECT draw, l.class_label, l.Sentence_id FROM d JOIN x ON x.k = floor(d.k * x.labels) JOIN l ON l.class_label = x.class_label AND l.rn = floor(d.u * x.n) + 1"""))
def weighted_draws(spark, d):
    return s.weighted_draws(_labelled(spark, d), "class_label", "Sentence_id", 1000).select("draw", "class_label", "Sentence_id")


@query(with_views("pool", """, t AS (SELECT DISTINCT topic FROM pool WHERE topic IS NOT NULL), n AS (SELECT topic, count(*) AS n FROM pool WHERE topic IS NOT NULL GROUP BY 1)
  SELECT b.topic AS base, a.topic AS augment, nb.n + na.n AS size FROM t b JOIN t a ON a.topic <> b.topic JOIN n nb ON nb.topic = b.topic JOIN n na ON na.topic = a.topic"""))
def cross_topic_sets(spark, d):
    n = pool(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n"))
    pairs = n.toDF("base", "nb").join(F.broadcast(n.toDF("augment", "na")), F.col("base") != F.col("augment"))  # one row for each topic
    return pairs.select("base", "augment", (F.col("nb") + F.col("na")).alias("size"))


@query(with_views("pool", "SELECT run, count(*) AS n, CAST(least(100, 70000 // count(*)) AS BIGINT) AS epochs FROM pool GROUP BY 1"))
def training_budget(spark, d):
    n = F.count("*")
    return pool(spark, d).groupBy("run").agg(n.alias("n"), F.least(F.lit(100), F.floor(70000 / n)).alias("epochs"))
