"""Queries that plan generation: batches, topics, few shots, cycles, counts, assembled sets, the breeding loop."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import planning as pl
from textloom.plans.lineage import table
from textloom.queries.base import query
from textloom.queries.vectors import _parts
from textloom.sources.views import claims, pool, predictions, templates, with_views

UNIT = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
BATCHES = f"""n AS (SELECT run, max(sample_size) AS n FROM target_mix GROUP BY 1), b AS (SELECT run, unnest(range(0, CAST(ceil(n / 8.0) AS BIGINT))) AS batch FROM n),
t AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS k, count(*) OVER () AS topics FROM (SELECT DISTINCT topic FROM pool WHERE topic IS NOT NULL)),
p AS (SELECT run, batch, topic FROM b JOIN t ON t.k = floor({UNIT.format("'42:' || run || ':' || batch")} * t.topics))"""


def _batches(spark, d):
    runs = table(spark, d, "target_mix").groupBy("run").agg(F.max("sample_size").alias("n"))
    return pl.batch_plan(runs, pool(spark, d).where("topic IS NOT NULL").select("topic"), 8)


@query(with_views("pool", f", {BATCHES} SELECT run, CAST(batch AS INT) AS batch, topic FROM p"))
def pool_plan(spark, d):
    """Batches of eight texts for each run, each with a topic."""
    return _batches(spark, d)


@query(with_views("pool vectors", f""", {BATCHES}, x AS (SELECT run, batch, vec_id, row_number() OVER (PARTITION BY run, batch ORDER BY md5('42:' || run || ':' || batch || ':' || vec_id), vec_id) AS n FROM p, vectors WHERE is_ref)
  SELECT run, CAST(batch AS INT) AS batch, vec_id FROM x WHERE n <= 4"""))
def batch_few_shots(spark, d):
    """Four of the references for each batch."""
    return pl.few_shots(_batches(spark, d), _parts(spark, d)[1].select("id"), 4).withColumnRenamed("id", "vec_id")


COUNTS = """c AS (SELECT run AS "set", count_if(class_label = 'Yes') AS p, count_if(class_label = 'No') AS n FROM pool WHERE run IS NOT NULL GROUP BY 1),
z AS (SELECT * FROM (VALUES (0, 1000, 1000), (1, 3000, 2000), (2, 8000, 5000)) t(i, size, d))"""


def _sets(spark, d):
    return pool(spark, d).where("run IS NOT NULL").groupBy(F.col("run").alias("set")).agg(F.count_if(F.col("class_label") == "Yes").alias("n_pos"), F.count_if(F.col("class_label") == "No").alias("n_neg"))


@query(with_views("pool", f""", {COUNTS}, h AS (SELECT *, (d - CASE WHEN i = 0 THEN abs(n - p) ELSE 0 END) // 2 AS h FROM c, z WHERE abs(n - p) <= 1000)
  SELECT "set", CAST(size AS INT) AS size, CAST(sum(h) OVER w + greatest(n - p, 0) AS BIGINT) AS num_pos, CAST(sum(h) OVER w + greatest(p - n, 0) AS BIGINT) AS num_neg FROM h WINDOW w AS (PARTITION BY "set" ORDER BY i)"""))
def balancing_counts(spark, d):
    """What each run needs to be balanced at growing sizes; runs that the first size can't balance are left out."""
    return pl.generation_counts(_sets(spark, d), [1000, 3000, 8000], strict=False)


@query(with_views("pool", f""", {COUNTS}, h AS (SELECT *, CAST(round_even(d * p / CAST(p + n AS DOUBLE), 0) AS BIGINT) AS h FROM c, z WHERE p + n > 0)
  SELECT "set", CAST(size AS INT) AS size, CAST(sum(h) OVER w AS BIGINT) AS num_pos, CAST(sum(d - h) OVER w AS BIGINT) AS num_neg FROM h WINDOW w AS (PARTITION BY "set" ORDER BY i)"""))
def ratio_counts(spark, d):
    return pl.generation_counts(_sets(spark, d).where("n_pos + n_neg > 0"), [1000, 3000, 8000], balance=False)


@query(with_views("pool", """, r AS (SELECT topic, row_id FROM pool WHERE topic IS NOT NULL AND row_id IS NOT NULL), t AS (SELECT DISTINCT topic FROM r)
  SELECT topic AS base, NULL AS augment, 'base' AS part, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM r GROUP BY 1
  UNION ALL SELECT r.topic, t.topic, 'base', count(*), CAST(sum(row_id) AS BIGINT) FROM r JOIN t ON t.topic <> r.topic GROUP BY 1, 2
  UNION ALL SELECT t.topic, r.topic, 'augment', count(*), CAST(sum(row_id) AS BIGINT) FROM r JOIN t ON t.topic <> r.topic GROUP BY 1, 2"""))
def cross_topic_rows(spark, d):
    """The rows of every data set of a base topic alone or with another, counted and with the sum of their ids."""
    rows = pool(spark, d).where("topic IS NOT NULL AND row_id IS NOT NULL").select(F.col("row_id").alias("id"), "topic")
    return pl.crossed(rows, rows).groupBy("base", "augment", "part").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(with_views("templates", """, s AS (SELECT DISTINCT seq FROM templates WHERE seq IS NOT NULL), h AS (SELECT DISTINCT seq, gen_num AS aug FROM templates)
  SELECT s.seq, CAST(a.aug AS BIGINT) AS aug, h.seq IS NOT NULL AS already_exists FROM s CROSS JOIN range(0, 9) a(aug) LEFT JOIN h ON h.seq = s.seq AND h.aug = a.aug"""))
def tasks_to_generate(spark, d):
    """Each sequence with each augmented size, and whether it is there already."""
    t = templates(spark, d).select("seq", F.col("gen_num").alias("aug"))
    wanted = t.where("seq IS NOT NULL").select("seq").distinct().withColumn("aug", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    return pl.tasks(t, wanted)


@query(with_views("templates", """, f AS (SELECT seq, gen_num, list(DISTINCT template_idx) AS ids FROM templates WHERE seq IS NOT NULL GROUP BY 1, 2)
  SELECT a.seq, a.gen_num AS small, b.gen_num AS large, len(list_filter(a.ids, lambda x: NOT list_contains(b.ids, x))) AS missing FROM f a JOIN f b ON a.seq = b.seq AND b.gen_num = a.gen_num - 1"""))
def subset_compatible(spark, d):
    """Of each generation of a sequence how many templates the one before doesn't have; 0 makes them nested."""
    t = templates(spark, d).where("seq IS NOT NULL").select("seq", "gen_num", "template_idx").distinct()
    steps = t.select("seq", F.col("gen_num").alias("small")).distinct().join(t.select("seq", (F.col("gen_num") + 1).alias("small")).distinct(), ["seq", "small"])
    known = t.select("seq", (F.col("gen_num") + 1).alias("small"), "template_idx", F.lit(True).alias("there"))
    rows = t.withColumnRenamed("gen_num", "small").join(steps, ["seq", "small"]).join(known, ["seq", "small", "template_idx"], "left")
    return rows.groupBy("seq", "small", (F.col("small") - 1).alias("large")).agg(F.count_if(F.col("there").isNull()).alias("missing"))


@query(with_views("templates", """, s AS (SELECT row_id AS id, unnest([1, 2, 3, 4]) AS step FROM templates WHERE gen_num = 0)
  SELECT id, CAST(step AS INT) AS step, CAST(step - 1 AS INT) AS source_step, CAST(f AS INT) AS factor FROM s, (VALUES (1), (2), (4)) t(f) WHERE step <= f"""))
def back_translation_plan(spark, d):
    return pl.back_translations(templates(spark, d).where("gen_num = 0").select(F.col("row_id").alias("id")), [1, 2, 4], chained=True)


@query(with_views("claims", f""", n AS (SELECT run, max(sample_size) AS n FROM target_mix GROUP BY 1), k AS (SELECT run, unnest(range(0, n)) AS task FROM n),
  s AS (SELECT DISTINCT style FROM claims WHERE style IS NOT NULL), c AS (SELECT count(*) AS c FROM s),
  e AS (SELECT *, task // c AS r, task % c AS a FROM k, c), o AS (SELECT r, style, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || r || ':' || style), style) - 1 AS a FROM (SELECT DISTINCT r FROM e), s),
  w AS (SELECT topic, count(*) AS n FROM claims WHERE topic IS NOT NULL GROUP BY 1), u AS (SELECT topic, sum(n) OVER (ORDER BY topic) / sum(n) OVER () AS hi, (sum(n) OVER (ORDER BY topic) - n) / sum(n) OVER () AS lo FROM w),
  x AS (SELECT run, task, style, {UNIT.format("'7:' || run || ':' || task")} AS u FROM e JOIN o USING (r, a))
  SELECT run, CAST(task AS INT) AS task, style, topic FROM x JOIN u ON x.u >= u.lo AND x.u < u.hi"""))
def prompt_tasks(spark, d):
    """For each text of a run a style, in cycles without repetition, and a topic by its frequency."""
    from textloom.operators.sampling import fraction

    runs = table(spark, d, "target_mix").groupBy("run").agg(F.max("sample_size").alias("n"))
    k = runs.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    c = claims(spark, d)
    styled = pl.cycled(k, c.where("style IS NOT NULL").select("style").distinct(), "style", "task")
    n = c.where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n"))
    up, all_ = F.sum("n").over(Window.orderBy("topic")), F.sum("n").over(Window.partitionBy())  # one row for each topic
    ends = n.select("topic", (up / all_).alias("hi"), ((up - F.col("n")) / all_).alias("lo"))
    u = styled.withColumn("_id", F.concat_ws(":", "run", "task")).withColumn("_u", fraction(7, "_id"))
    return u.join(F.broadcast(ends), (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))).select("run", "task", "style", "topic")


@query("""WITH g AS (SELECT DISTINCT subject AS gene FROM subject_area WHERE subject IS NOT NULL), r AS (SELECT DISTINCT run AS id FROM target_mix),
  o AS (SELECT id, gene, row_number() OVER (PARTITION BY id ORDER BY md5('42:' || id || ':' || gene), gene) AS n FROM r, g)
  SELECT id, string_agg(gene, ',' ORDER BY n) FILTER (n <= 2) AS "first", string_agg(gene, ',' ORDER BY n) FILTER (n IN (3, 4)) AS "second", string_agg(gene, ',' ORDER BY n) FILTER (n > 4) AS rest FROM o GROUP BY 1""")
def gene_partition(spark, d):
    genes = table(spark, d, "subject_area").where("subject IS NOT NULL").select(F.col("subject").alias("gene")).distinct()
    got = pl.partition_genes(table(spark, d, "target_mix").select(F.col("run").alias("id")).distinct(), genes)
    return got.select("id", *[F.array_join(c, ",").alias(c) for c in ("first", "second", "rest")])


PROPS = f"""p AS (SELECT DISTINCT style AS category, topic AS feature FROM claims WHERE style IS NOT NULL AND topic IS NOT NULL), m AS (SELECT min(category) AS always, max(category) AS never FROM p),
f AS (SELECT category, list(feature ORDER BY feature) AS f FROM p GROUP BY 1), r AS (SELECT DISTINCT run AS id FROM target_mix),
o AS (SELECT id, category, f, row_number() OVER (PARTITION BY id ORDER BY category = always DESC, md5('42:' || id || ':' || category), category) AS n FROM r, f, m WHERE category <> never)"""


@query(with_views("claims", f""", {PROPS} SELECT id, category, f[1 + CAST(floor({UNIT.format("'43:' || id || ':' || category")} * len(f)) AS BIGINT)] AS feature FROM o WHERE n <= 3"""))
def property_samples(spark, d):
    """For each run one category always and two others, never the last one, each with one of its features."""
    p = claims(spark, d).where("style IS NOT NULL AND topic IS NOT NULL").select(F.col("style").alias("category"), F.col("topic").alias("feature")).distinct()
    ends = p.agg(F.min("category"), F.max("category")).first()
    return pl.drawn_properties(table(spark, d, "target_mix").select(F.col("run").alias("id")).distinct(), p, 2, ends[0] or "", [ends[1] or ""])


@query(with_views("predictions", "SELECT row_id, score FROM predictions ORDER BY score, row_id LIMIT 100"))
def bottom_k(spark, d):
    return pl.select_rows(predictions(spark, d), "bottom", "score", 100, "row_id").select("row_id", "score")


@query(with_views("predictions", ", x AS (SELECT row_id, label, abs(score - label) AS e FROM predictions) SELECT row_id, label FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY e DESC, row_id) <= 60"))
def hardest_rows(spark, d):
    """The rows of the greatest error, as many of each label."""
    p = predictions(spark, d).withColumn("e", F.abs(F.col("score") - F.col("label")))
    return pl.select_rows(p, "top", "e", 120, "row_id", "label").select("row_id", "label")


@query(with_views("templates", """, b AS (SELECT Text, max(template_idx) AS t FROM templates WHERE gen_num = 0 AND Text IS NOT NULL GROUP BY 1), d AS (SELECT * FROM templates WHERE gen_num > 0 QUALIFY row_number() OVER (PARTITION BY Text, example ORDER BY template_idx, gen_num) = 1)
  SELECT d.row_id, b.t AS template_idx FROM d JOIN b ON d.example = b.Text"""))
def pool_rebuild(spark, d):
    """Generated rows without those of equal Text and example, linked with their templates."""
    from textloom.operators.curate import dedup_first
    from textloom.operators.pools import linked_templates

    t = templates(spark, d)
    return linked_templates(dedup_first(t.where("gen_num > 0"), ["Text", "example"], ["template_idx", "gen_num"]), t.where("gen_num = 0"))


@query(with_views("pool", """, r AS (SELECT run, row_id, class_label, row_number() OVER (PARTITION BY run, class_label ORDER BY row_id) AS a, row_number() OVER (PARTITION BY run, class_label ORDER BY md5('42:' || row_id), row_id) AS b FROM pool WHERE class_label IS NOT NULL AND run IS NOT NULL)
  SELECT 'unfiltered' AS kind, run, row_id FROM r WHERE a <= 16 UNION ALL SELECT 'sampled', run, row_id FROM r WHERE b <= 16"""))
def assembled_sets(spark, d):
    """Augmentations of 16 rows a class from each run: the first ones generated, and a random draw."""
    from textloom.operators.sampling import ranked

    p = pool(spark, d).where("class_label IS NOT NULL AND run IS NOT NULL").select("run", "class_label", "row_id")
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("run", "class_label").orderBy("row_id"))).where("n <= 16")
    drawn = ranked(p, ["run", "class_label"], "row_id").where("rn <= 16")
    return first.select(F.lit("unfiltered").alias("kind"), "run", "row_id").unionByName(drawn.select(F.lit("sampled").alias("kind"), "run", "row_id"))


@query()
def breeding_loop(spark, d):
    """Three rounds over all vectors of both classes: the rows that were parents or born, with their statistics. Tested by
    brute force; no statement, as SQL would compare all pairs in each round."""
    out, _ = pl.breed(_parts(spark, d)[0], 3)
    return out.where("selected_count > 0 OR iteration_count < 3").select("class_label", F.col("id").alias("vec_id"), "selected_count", "iteration_count")
