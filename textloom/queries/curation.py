"""Queries over labelled texts: filters, deduplication, set operations, joins, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import curate
from textloom.plans.lineage import table
from textloom.queries.base import query
from textloom.sources.views import claims, pool, templates, with_views, yes_no

MEDIA = ["podcast", "broadcast", "leaflet", "billboard"]


@query(with_views("claims", """SELECT count_if(class_label = 'Yes') AS n_yes, count_if(class_label = 'No') AS n_no,
  round(100.0 * count_if(class_label = 'Yes') / nullif(count_if(class_label IN ('Yes','No')), 0), 6) AS pct_yes FROM claims"""))
def label_stats(spark, d):
    yes, no = F.count_if(F.col("class_label") == "Yes"), F.count_if(F.col("class_label") == "No")
    return claims(spark, d).agg(yes.alias("n_yes"), no.alias("n_no"), F.round(F.try_divide(100.0 * yes, yes + no), 6).alias("pct_yes"))


@query(with_views("claims", "SELECT class_label, count(*) AS n FROM claims WHERE class_label IS NOT NULL GROUP BY 1"))
def class_counts(spark, d):
    return claims(spark, d).where("class_label IS NOT NULL").groupBy("class_label").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT Text) AS n_texts, count(DISTINCT source) AS n_sources FROM general_claim")
def distinct_text(spark, d):
    return table(spark, d, "general_claim").agg(F.count_distinct("Text").alias("n_texts"), F.count_distinct("source").alias("n_sources"))


@query("""SELECT Sentence_id AS sentence_id, Text AS text, CASE WHEN lower(trim(class_label)) IN ('yes','y','1','true') THEN 1
  WHEN lower(trim(class_label)) IN ('no','n','0','false') THEN 0 END AS label, 'general' AS origin FROM general_claim""")
def schema_normalise(spark, d):
    label = F.when(yes_no(F.col("class_label")) == "Yes", 1).when(yes_no(F.col("class_label")) == "No", 0)
    return table(spark, d, "general_claim").select(F.col("Sentence_id").alias("sentence_id"), F.col("Text").alias("text"), label.alias("label"), F.lit("general").alias("origin"))


@query("SELECT Sentence_id, Text, '-' AS source, '-' AS style, '-' AS tweet_url FROM general_claim")
def add_replace_columns(spark, d):
    base = table(spark, d, "general_claim").select("Sentence_id", "source", "style", "Text")
    return curate.replace_columns(base, ["source", "style", "tweet_url"])


@query("SELECT Sentence_id FROM general_claim WHERE NOT coalesce(regexp_matches(Text, '(?i)podcast|broadcast|leaflet|billboard'), false)")
def regex_exclude_null_safe(spark, d):
    return table(spark, d, "general_claim").where(curate.matches_none(F.col("Text"), MEDIA)).select("Sentence_id")


@query("SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND NOT contains(text, chr(10)) AND length(text) > 15")
def quality_filter(spark, d):
    return table(spark, d, "documents").where((F.lower("lang") == "en") & ~F.contains("text", F.lit("\n")) & (F.length("text") > 15)).select("doc_id")


@query(r"SELECT row_id FROM candidate_pool WHERE length(Text) >= 10 AND NOT contains(Text, chr(10)) AND NOT regexp_matches(Text, '\s[A-Z]\s')")
def validity_filter(spark, d):
    ok = (F.length("Text") >= 10) & ~F.contains("Text", F.lit("\n")) & ~F.col("Text").rlike(r"\s[A-Z]\s")
    return table(spark, d, "candidate_pool").where(ok).select("row_id")


@query(with_views("templates", "SELECT example IS NULL AS is_real, count(*) AS n, count(DISTINCT template_idx) AS n_templates FROM templates GROUP BY 1"))
def real_or_synthetic(spark, d):
    return templates(spark, d).groupBy(F.col("example").isNull().alias("is_real")).agg(F.count("*").alias("n"), F.count_distinct("template_idx").alias("n_templates"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_keep_first(spark, d):
    return curate.dedup_first(table(spark, d, "documents").select("doc_id", "lang", "text"), ["text"], ["doc_id"]).select("doc_id", "lang")


@query("""SELECT src, id FROM (SELECT 'claim_split' AS src, 0 AS o, Sentence_id AS id, Text FROM claim_split
  UNION ALL SELECT 'candidate_pool', 1, row_id, Text FROM candidate_pool)
  QUALIFY row_number() OVER (PARTITION BY Text ORDER BY o, id) = 1""")
def union_dedup(spark, d):
    a = table(spark, d, "claim_split").select(F.lit("claim_split").alias("src"), F.col("Sentence_id").alias("id"), "Text")
    b = table(spark, d, "candidate_pool").select(F.lit("candidate_pool").alias("src"), F.col("row_id").alias("id"), "Text")
    return curate.union_dedup([a, b], ["Text"], ["id"]).select("src", "id")


@query("SELECT Sentence_id FROM claim_split c WHERE NOT EXISTS (SELECT 1 FROM general_claim g WHERE g.Text IS NOT DISTINCT FROM c.Text)")
def set_difference(spark, d):
    return curate.difference(table(spark, d, "claim_split"), [table(spark, d, "general_claim")], "Text").select("Sentence_id")


@query("""SELECT row_id FROM topic_dev t WHERE NOT EXISTS (SELECT 1 FROM (SELECT Text FROM general_claim UNION ALL SELECT Text FROM claim_split
  UNION ALL SELECT Text FROM seq_1_aug_0) g WHERE g.Text = t.Text)""")
def holdout_anti(spark, d):
    known = [table(spark, d, n) for n in ("general_claim", "claim_split", "seq_1_aug_0")]
    return curate.difference(table(spark, d, "topic_dev"), known, "Text", null_matches=False).select("row_id")


@query("SELECT DISTINCT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def overlap_semi(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    several = docs.groupBy("text").agg(F.count("*").alias("n")).where("n > 1")
    return curate.overlap(docs, several, "text").select("doc_id").distinct()


@query(with_views("templates", """SELECT s.seq, s.row_id FROM templates s WHERE s.example IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM templates r WHERE r.example IS NULL AND r.seq = s.seq AND r.Text = s.Text)"""))
def synth_minus_real(spark, d):
    t = templates(spark, d)
    real = t.where("example IS NULL").select("seq", "Text").distinct()
    return t.where("example IS NOT NULL").join(real, ["seq", "Text"], "left_anti").select("seq", "row_id")


@query("""SELECT source, 'a' AS side FROM (SELECT DISTINCT source FROM general_claim) g WHERE NOT EXISTS (SELECT 1 FROM claim_split c WHERE c.source IS NOT DISTINCT FROM g.source)
  UNION SELECT source, 'b' FROM (SELECT DISTINCT source FROM claim_split) c WHERE NOT EXISTS (SELECT 1 FROM general_claim g WHERE g.source IS NOT DISTINCT FROM c.source)""")
def exclusive_pair(spark, d):
    return curate.exclusive(table(spark, d, "general_claim").select("source").distinct(), table(spark, d, "claim_split").select("source").distinct(), "source")


@query("""SELECT source, count(*) AS n FROM (SELECT DISTINCT split, source FROM claim_split) GROUP BY source HAVING count(*) >= 3""")
def intersect_m_of_k(spark, d):
    c = table(spark, d, "claim_split")
    return curate.in_at_least([c.where(F.col("split") == s) for s in ("train", "dev", "test", "holdout")], "source", 3)


@query("""SELECT c.Sentence_id, NOT coalesce(c.Text = g.Text, false) OR NOT coalesce(c.class_label = g.class_label, false) AS different
  FROM (SELECT DISTINCT Sentence_id, Text, class_label FROM claim_split) c
  JOIN (SELECT Sentence_id, any_value(Text) AS Text, min(class_label) AS class_label FROM general_claim GROUP BY 1) g USING (Sentence_id)""")
def positional_compare(spark, d):
    a = table(spark, d, "claim_split").select("Sentence_id", "Text", "class_label").distinct()
    b = table(spark, d, "general_claim").groupBy("Sentence_id").agg(F.any_value("Text").alias("Text"), F.min("class_label").alias("class_label"))
    return curate.compare_in_order(a, b, "Sentence_id", ["Text", "class_label"])


@query("""SELECT p.row_id, t.target_pct, t.sample_size FROM candidate_pool p LEFT JOIN target_mix t
  ON p.run IS NOT DISTINCT FROM t.run AND p.class_label IS NOT DISTINCT FROM t.class_label""")
def label_left_join(spark, d):
    p, t = table(spark, d, "candidate_pool").alias("p"), table(spark, d, "target_mix").alias("t")
    on = F.col("p.run").eqNullSafe(F.col("t.run")) & F.col("p.class_label").eqNullSafe(F.col("t.class_label"))
    return p.join(t, on, "left").select("p.row_id", "t.target_pct", "t.sample_size")


@query(with_views("claims", "SELECT c.Sentence_id, s.description FROM claims c LEFT JOIN subject_area s ON c.topic = s.subject"))
def topic_lookup(spark, d):
    # one row for each subject; Spark broadcasts it by its size
    s = table(spark, d, "subject_area").withColumnRenamed("subject", "topic")
    return claims(spark, d).join(s, "topic", "left").select("Sentence_id", "description")


@query(with_views("claims", """SELECT topic, count_if(class_label = 'No') AS n_no, count_if(class_label = 'Yes') AS n_yes, count(*) AS n,
  round(count_if(class_label = 'Yes') / nullif(count_if(class_label IN ('Yes','No')), 0), 6) AS pos_ratio FROM claims WHERE topic IS NOT NULL GROUP BY 1"""))
def topic_class_pivot(spark, d):
    p = claims(spark, d).where("topic IS NOT NULL").groupBy("topic")
    yes, no = F.count_if(F.col("class_label") == "Yes"), F.count_if(F.col("class_label") == "No")
    return p.agg(no.alias("n_no"), yes.alias("n_yes"), F.count("*").alias("n"), F.round(F.try_divide(yes, yes + no), 6).alias("pos_ratio"))


@query(with_views("claims", """, n AS (SELECT topic, class_label, count(*) AS n FROM claims WHERE topic IS NOT NULL AND class_label IS NOT NULL GROUP BY 1, 2)
  SELECT class_label, min(n) AS least, max(n) AS most FROM n GROUP BY 1"""))
def min_class_per_topic(spark, d):
    n = claims(spark, d).where("topic IS NOT NULL AND class_label IS NOT NULL").groupBy("topic", "class_label").agg(F.count("*").alias("n"))
    return n.groupBy("class_label").agg(F.min("n").alias("least"), F.max("n").alias("most"))


@query(with_views("claims", """SELECT round(sum(CASE WHEN topic IN ('energy','environment') AND class_label = 'Yes' THEN 1 ELSE 0 END)
  / nullif(sum(CASE WHEN topic IN ('energy','environment') AND class_label IS NOT NULL THEN 1 ELSE 0 END), 0), 6) AS ratio FROM claims"""))
def topic_group_ratio(spark, d):
    group = F.col("topic").isin("energy", "environment")
    return claims(spark, d).agg(F.round(F.try_divide(F.count_if(group & (F.col("class_label") == "Yes")), F.count_if(group & F.col("class_label").isNotNull())), 6).alias("ratio"))


@query("""SELECT class_label, CAST(row_number() OVER (ORDER BY class_label) - 1 AS INT) AS label_id FROM (SELECT DISTINCT class_label FROM candidate_pool WHERE class_label IS NOT NULL)""")
def label_encoding(spark, d):
    return curate.label_ids(table(spark, d, "candidate_pool"), "class_label")


@query("""SELECT row_id, concat_ws(' | ', run, topic, Text) AS sentence FROM candidate_pool""")
def joined_text_columns(spark, d):
    return table(spark, d, "candidate_pool").select("row_id", F.concat_ws(" | ", "run", "topic", "Text").alias("sentence"))


@query(with_views("claims", """, w AS (SELECT source, class_label, count(*) AS n FROM claims WHERE source IS NOT NULL AND class_label IS NOT NULL GROUP BY 1, 2)
  SELECT source, class_label, round(n / sum(n) OVER (PARTITION BY source), 6) AS share, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS size FROM w"""))
def source_label_shares(spark, d):
    n = claims(spark, d).where("source IS NOT NULL AND class_label IS NOT NULL").groupBy("source", "class_label").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("source"))
    return n.select("source", "class_label", F.round(F.col("n") / total, 6).alias("share"), total.alias("size"))


@query(with_views("pool", """SELECT run, topic, count(*) AS n, count_if(class_label IS NULL) AS n_unlabelled FROM pool GROUP BY 1, 2"""))
def pool_counts(spark, d):
    return pool(spark, d).groupBy("run", "topic").agg(F.count("*").alias("n"), F.count_if(F.col("class_label").isNull()).alias("n_unlabelled"))
