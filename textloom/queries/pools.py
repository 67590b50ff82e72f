"""Queries that plan and assemble generated data sets, over template_sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import pools as po
from textloom.queries.base import query
from textloom.sources.views import templates, with_views

PLAN = """h AS (SELECT template_idx, count(*) AS have, max(gen_num) AS last FROM templates WHERE gen_num > 0 GROUP BY 1),
p AS (SELECT b.template_idx, coalesce(have, 0) AS have, least(coalesce(have, 0), 8) AS reuse, greatest(8 - coalesce(have, 0), 0) AS generate, coalesce(last, 0) + 1 AS next_gen
  FROM (SELECT DISTINCT template_idx FROM templates WHERE gen_num = 0) b LEFT JOIN h USING (template_idx))"""


def _parts(spark, d):
    t = templates(spark, d)
    return t.where("gen_num = 0"), t.where("gen_num > 0")


@query(with_views("templates", f", {PLAN} SELECT * FROM p"))
def template_quota(spark, d):
    return po.template_plan(*_parts(spark, d), 8)


@query(with_views("templates", f", {PLAN} SELECT template_idx, unnest(range(next_gen, next_gen + generate)) AS gen_num FROM p WHERE generate > 0"))
def templates_to_generate(spark, d):
    return po.to_generate(po.template_plan(*_parts(spark, d), 8))


@query(with_views("templates", "SELECT template_idx, gen_num, row_id FROM templates WHERE gen_num > 0 QUALIFY row_number() OVER (PARTITION BY template_idx ORDER BY gen_num) <= 4"))
def pool_reuse(spark, d):
    return po.reused(_parts(spark, d)[1], 4).select("template_idx", "gen_num", "row_id")


@query(with_views("templates", """SELECT s.row_id, b.template_idx FROM templates s JOIN (SELECT Text, max(template_idx) AS template_idx FROM templates WHERE gen_num = 0 AND Text IS NOT NULL GROUP BY 1) b ON s.example = b.Text WHERE s.gen_num > 0"""))
def pool_links(spark, d):
    base, made = _parts(spark, d)
    return po.linked_templates(made, base)


@query(with_views("templates", """, n AS (SELECT seq AS step, count(*) AS n FROM templates GROUP BY 1), s AS (SELECT step, CAST(sum(n) OVER (ORDER BY step) AS BIGINT) AS size, n AS added FROM n)
  SELECT step, size, added, CAST(sum(added // 2) OVER (ORDER BY step) AS BIGINT) AS n_yes, CAST(sum(added) OVER (ORDER BY step) - sum(added // 2) OVER (ORDER BY step) AS BIGINT) AS n_no FROM s"""))
def sequence_growth(spark, d):
    from pyspark.sql import Window

    n = templates(spark, d).groupBy(F.col("seq").alias("step")).agg(F.count("*").alias("n"))
    sizes = n.select("step", F.sum("n").over(Window.orderBy("step")).alias("size"))  # one row for each sequence
    return po.growth_plan(sizes)


LOOP = """b AS (SELECT class_label, row_id, template_idx FROM templates WHERE gen_num = 0 AND class_label IS NOT NULL),
s AS (SELECT t.class_label, t.row_id, row_number() OVER (PARTITION BY t.class_label ORDER BY t.template_idx, t.gen_num) AS iteration, b.row_id AS parent_a, coalesce(p.row_id, b.row_id) AS parent_b
  FROM templates t JOIN b ON b.template_idx = t.template_idx LEFT JOIN templates p ON p.template_idx = t.template_idx AND p.gen_num = t.gen_num - 1 WHERE t.gen_num > 0 AND t.class_label IS NOT NULL)"""


@query(with_views("templates", f""", {LOOP}, m AS (SELECT class_label, max(iteration) AS rounds FROM s GROUP BY 1),
  c AS (SELECT row_id, count(*) AS n FROM (SELECT parent_a AS row_id FROM s UNION ALL SELECT parent_b FROM s) GROUP BY 1),
  a AS (SELECT class_label, row_id, 0 AS iteration FROM b UNION ALL SELECT class_label, row_id, iteration FROM s)
  SELECT a.class_label, a.row_id, coalesce(c.n, 0) AS selected_count, coalesce(m.rounds, 0) - a.iteration AS iteration_count FROM a LEFT JOIN m USING (class_label) LEFT JOIN c ON c.row_id = a.row_id"""))
def genetic_pool_stats(spark, d):
    from textloom.operators.sampling import Window

    base, made = _parts(spark, d)
    b = base.where("class_label IS NOT NULL").select("class_label", "row_id", "template_idx")
    before = templates(spark, d).select("template_idx", (F.col("gen_num") + 1).alias("gen_num"), F.col("row_id").alias("p"))
    w = Window.partitionBy("class_label").orderBy("template_idx", "gen_num")
    s = made.where("class_label IS NOT NULL").join(b.select("template_idx", F.col("row_id").alias("parent_a")), "template_idx").join(before, ["template_idx", "gen_num"], "left")
    s = s.select("class_label", "row_id", F.row_number().over(w).alias("iteration"), "parent_a", F.coalesce("p", "parent_a").alias("parent_b"))
    return po.selection_stats(b, s)
