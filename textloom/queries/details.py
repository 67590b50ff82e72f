"""Queries for casts, ids, encodings, comparisons by position and other small steps of curation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import curate
from textloom.operators import sampling as s
from textloom.plans.lineage import table
from textloom.queries.base import query
from textloom.sources.views import claims, pool, predictions, templates, with_views, yes_no

UNIT = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def strict_cast(spark, d):
    """A cast that fails on what is no number, as it does in ANSI mode."""
    return table(spark, d, "events").select("event_id", curate.whole_number(F.get_json_object("props", "$.k")).alias("k"))


@query("""SELECT row_id, (SELECT max(Sentence_id) FROM general_claim) + row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS new_id FROM candidate_pool""")
def surrogate_ids(spark, d):
    """New ids for the pool that go on after the largest real one."""
    most = table(spark, d, "general_claim").agg(F.max("Sentence_id").alias("most"))
    return s.ranked_whole(table(spark, d, "candidate_pool"), "row_id").join(F.broadcast(most)).select("row_id", (F.col("most") + F.col("rn")).alias("new_id"))  # one row


@query("""WITH t AS (SELECT DISTINCT class_label AS l FROM claim_split WHERE split = 'train' AND class_label IS NOT NULL), e AS (SELECT DISTINCT class_label AS l FROM claim_split WHERE split <> 'train' AND class_label IS NOT NULL AND class_label NOT IN (SELECT l FROM t))
  SELECT l AS class_label, CAST(row_number() OVER (ORDER BY o, l) - 1 AS INT) AS label_id FROM (SELECT l, 0 AS o FROM t UNION ALL SELECT l, 1 FROM e)""")
def label_encoding_unseen(spark, d):
    c = table(spark, d, "claim_split")
    return curate.label_ids_with_unseen(c.where("split = 'train'"), c.where("split <> 'train'"), "class_label")


@query("""WITH l AS (SELECT class_label, row_number() OVER (ORDER BY class_label) - 1 AS id, count(*) OVER () AS n FROM (SELECT DISTINCT class_label FROM candidate_pool WHERE class_label IS NOT NULL))
  SELECT row_id, list_transform(range(0, n), lambda i: CAST(i = id AS INT)) AS x FROM candidate_pool JOIN l USING (class_label)""")
def one_hot_labels(spark, d):
    p = table(spark, d, "candidate_pool").where("class_label IS NOT NULL").select("row_id", "class_label")
    ids = curate.label_ids(p, "class_label")
    n = ids.agg(F.count("*").alias("n"))
    return p.join(F.broadcast(ids), "class_label").join(F.broadcast(n)).select("row_id", curate.one_hot(F.col("label_id"), F.col("n")).alias("x"))  # labels are few


@query("""SELECT substr(topic, 1, 4) AS short, count(*) AS n FROM general_claim WHERE topic IS NOT NULL GROUP BY 1""")
def short_topics(spark, d):
    return table(spark, d, "general_claim").where("topic IS NOT NULL").groupBy(F.substring("topic", 1, 4).alias("short")).agg(F.count("*").alias("n"))


@query("""SELECT Sentence_id, CASE WHEN trim(class_label) = '1' THEN 'Yes' WHEN trim(class_label) = '0' THEN 'No' ELSE trim(class_label) END AS label FROM general_claim""")
def label_normalise(spark, d):
    """Labels that are numbers become words, others stay."""
    return table(spark, d, "general_claim").select("Sentence_id", curate.label_words(F.col("class_label")).alias("label"))


@query(with_views("claims", """, n AS (SELECT topic, count_if(class_label = 'No') AS n_no, count_if(class_label = 'Yes') AS n_yes FROM claims WHERE topic IS NOT NULL GROUP BY 1)
  SELECT subject, coalesce(n_no, 0) AS n_no, coalesce(n_yes, 0) AS n_yes FROM subject_area LEFT JOIN n ON n.topic = subject"""))
def topic_info_counts(spark, d):
    """The counts of each topic beside its row in the subject table, joined by name, not by position."""
    n = claims(spark, d).where("topic IS NOT NULL").groupBy(F.col("topic").alias("subject")).agg(F.count_if(F.col("class_label") == "No").alias("n_no"), F.count_if(F.col("class_label") == "Yes").alias("n_yes"))
    return curate.attach(table(spark, d, "subject_area").select("subject"), n, "subject", {"n_no": 0, "n_yes": 0})


@query("""WITH a AS (SELECT *, row_number() OVER (ORDER BY row_id) AS n FROM topic_dev), b AS (SELECT *, row_number() OVER (ORDER BY row_id) AS n FROM seq_1_aug_0)
  SELECT n, a.row_id AS left_id, b.row_id AS right_id, NOT coalesce(a.Text = b.Text, false) OR NOT coalesce(a.class_label = b.class_label, false) AS different FROM a JOIN b USING (n)""")
def compare_by_position(spark, d):
    """The two tables row by row in the order of their ids; rows beyond the shorter one have no partner."""
    a, b = (s.numbered(table(spark, d, n).select("row_id", "Text", "class_label"), ["row_id"]) for n in ("topic_dev", "seq_1_aug_0"))
    both = a.withColumnRenamed("row_id", "left_id").alias("a").join(b.withColumnRenamed("row_id", "right_id").alias("b"), "n")
    same = F.coalesce(F.col("a.Text") == F.col("b.Text"), F.lit(False)) & F.coalesce(F.col("a.class_label") == F.col("b.class_label"), F.lit(False))
    return both.select("n", "left_id", "right_id", (~same).alias("different"))


@query("""SELECT row_id, Text FROM candidate_pool ORDER BY row_id LIMIT 1 OFFSET 99""")
def row_by_position(spark, d):
    return curate.row_at(table(spark, d, "candidate_pool").select("row_id", "Text"), ["row_id"], 99)


@query(with_views("templates", "SELECT template_idx, coalesce(max(row_id) FILTER (class_label = 'Yes'), max(row_id)) AS row_id FROM templates GROUP BY 1"))
def preferred_row(spark, d):
    """Of each template the last row labelled Yes, or else the last row."""
    return curate.preferred(templates(spark, d), ["template_idx"], F.col("class_label") == "Yes", "row_id")


@query(with_views("templates", "SELECT seq, count_if(class_label = 'Yes') + count_if(class_label = 'No') AS total, count_if(example IS NOT NULL) AS synthetic, count_if(class_label = 'Yes') + count_if(class_label = 'No') - count_if(example IS NOT NULL) AS real FROM templates GROUP BY 1"))
def synthetic_counts(spark, d):
    """Rows of each sequence that have a label, synthetic rows, and the difference."""
    yes, no, made = F.count_if(F.col("class_label") == "Yes"), F.count_if(F.col("class_label") == "No"), F.count_if(F.col("example").isNotNull())
    return templates(spark, d).groupBy("seq").agg((yes + no).alias("total"), made.alias("synthetic"), (yes + no - made).alias("real"))


@query("""WITH r AS (SELECT event_type AS aug, user_id % 15 AS seq, event_id % 3 AS seed, count(*) AS n FROM events GROUP BY 1, 2, 3)
  SELECT aug, CASE WHEN n >= 40 THEN 'finished' ELSE 'failed' END AS state, count(*) AS n_runs, count(DISTINCT seq) AS n_seqs FROM r GROUP BY 1, 2""")
def run_states(spark, d):
    r = predictions(spark, d).groupBy("aug", "seq", "seed").agg(F.count("*").alias("n"))
    return r.groupBy("aug", F.when(F.col("n") >= 40, "finished").otherwise("failed").alias("state")).agg(F.count("*").alias("n_runs"), F.count_distinct("seq").alias("n_seqs"))


@query("""WITH m AS (SELECT median(epoch_us(added_at)) AS m FROM general_claim), y AS (SELECT *, CASE WHEN lower(trim(class_label)) IN ('yes','y','1','true') THEN 'Yes' WHEN lower(trim(class_label)) IN ('no','n','0','false') THEN 'No' END AS l FROM general_claim)
  SELECT count_if(date_part('year', added_at) = date_part('year', stated_at) AND l = 'Yes') AS early_yes, count_if(date_part('year', added_at) = date_part('year', stated_at) AND l = 'No') AS early_no,
    count_if(date_part('year', added_at) <> date_part('year', stated_at) AND l = 'Yes') AS late_yes, count_if(date_part('year', added_at) <> date_part('year', stated_at) AND l = 'No') AS late_no FROM y""")
def early_late_counts(spark, d):
    """Rows of each label that were added in the year they are from, and later."""
    y = yes_no(F.col("class_label"))
    early = F.year("added_at") == F.year("stated_at")
    return table(spark, d, "general_claim").agg(*[F.count_if(e & (y == x)).alias(f"{n}_{x.lower()}") for n, e in (("early", early), ("late", ~early)) for x in ("Yes", "No")])


@query(with_views("pool", """, n AS (SELECT run, count(*) AS n FROM pool WHERE run IS NOT NULL GROUP BY 1) SELECT run, round(ln(1 + n), 6) AS level, CAST(dense_rank() OVER (ORDER BY n) AS BIGINT) AS position FROM n"""))
def size_levels(spark, d):
    """The logarithm of the size of each run, and the place of its size among all sizes."""
    n = pool(spark, d).where("run IS NOT NULL").groupBy("run").agg(F.count("*").alias("n"))
    sizes = n.select("n").distinct().withColumn("position", F.row_number().over(Window.orderBy("n")).cast("bigint"))
    return n.join(sizes, "n").select("run", F.round(F.log1p("n"), 6).alias("level"), "position")


@query(with_views("claims", "SELECT topic, count(*) AS n FROM claims WHERE topic IS NOT NULL GROUP BY 1 ORDER BY n DESC, topic LIMIT 5"))
def largest_topics(spark, d):
    return claims(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(5)


L = """l AS (SELECT Sentence_id, class_label, row_number() OVER (PARTITION BY class_label ORDER BY md5('42:' || Sentence_id), Sentence_id) AS rn, count(*) OVER (PARTITION BY class_label) AS n FROM claims WHERE class_label IS NOT NULL)"""


@query(with_views("claims", f""", {L}, y AS (SELECT count(*) AS y FROM claims WHERE class_label = 'Yes') SELECT Sentence_id, class_label FROM l, y WHERE class_label <> 'No' OR rn > greatest(n - y, 0)"""))
def drop_surplus(spark, d):
    """Without the rows labelled No, drawn at random, that there are more of than rows labelled Yes."""
    c = claims(spark, d).where("class_label IS NOT NULL").select("Sentence_id", "class_label")
    yes = c.agg(F.count_if(F.col("class_label") == "Yes").alias("yes"))
    return s.drop_random(c.join(F.broadcast(yes)), "class_label", "No", F.col("in_group") - F.col("yes"), "Sentence_id").select("Sentence_id", "class_label")  # one row


@query(with_views("templates", """, x AS (SELECT row_id, example IS NULL AS is_real, class_label, row_number() OVER (PARTITION BY example IS NULL, class_label ORDER BY md5('42:' || row_id), row_id) AS rn, count(*) OVER (PARTITION BY example IS NULL, class_label) AS n FROM templates WHERE class_label IS NOT NULL)
  SELECT row_id, is_real, class_label FROM x WHERE rn <= (SELECT min(n) FROM x)"""))
def equal_sets(spark, d):
    """As many real and made rows of each class as the smallest of the four sets has, before they are compared."""
    t = templates(spark, d).where("class_label IS NOT NULL").select("row_id", F.col("example").isNull().alias("is_real"), "class_label")
    least = t.groupBy("is_real", "class_label").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return s.placed(t, ["is_real", "class_label"], "row_id").join(F.broadcast(least)).where("rn <= least").select("row_id", "is_real", "class_label")  # one row


@query(with_views("pool", f""", w AS (SELECT topic, count(*) AS n FROM pool WHERE topic IS NOT NULL GROUP BY 1), u AS (SELECT topic, sum(n) OVER (ORDER BY topic) / sum(n) OVER () AS hi, (sum(n) OVER (ORDER BY topic) - n) / sum(n) OVER () AS lo FROM w),
  x AS (SELECT draw, {UNIT.format("'42:' || draw")} AS u FROM range(0, 500) t(draw)) SELECT draw, topic FROM x JOIN u ON x.u >= u.lo AND x.u < u.hi"""))
def topic_draws(spark, d):
    """500 draws of a topic, each by its share of the pool."""
    n = pool(spark, d).where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n"))
    return s.categorical_draws(n, "topic", "n", 500).select("draw", "topic")


@query(with_views("templates", """, e AS (SELECT row_id FROM candidate_pool ORDER BY md5('42:' || row_id), row_id LIMIT 20), q AS (SELECT DISTINCT seq FROM templates WHERE seq IS NOT NULL)
  SELECT seq, row_id, 'own' AS part FROM templates WHERE seq IS NOT NULL UNION ALL SELECT seq, row_id, 'added' FROM q, e"""))
def same_rows_added(spark, d):
    """Every sequence with the same 20 sampled rows added."""
    rows = templates(spark, d).where("seq IS NOT NULL").select("seq", "row_id", F.lit("own").alias("part"))
    extra = table(spark, d, "candidate_pool").orderBy(s.hash_order(42, "row_id"), "row_id").limit(20).select("row_id", F.lit("added").alias("part"))
    return s.to_every(rows, rows.select("seq").distinct(), extra)
