"""Queries that parse responses and build prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import corpus as co
from textloom.operators import parsing as pa
from textloom.plans.lineage import table
from textloom.queries.base import query
from textloom.sources.views import claims, pool, templates, with_views

LINES = """l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN starts_with(x, '- ') THEN substr(x, 3) ELSE x END), lambda x: regexp_matches(x, '\\S')) AS items FROM documents WHERE text IS NOT NULL)"""


@query(r"""SELECT doc_id, regexp_extract_all(text, '(?m)^\s*-\s+(.+)$', 1)[1] AS first_item FROM documents WHERE len(regexp_extract_all(text, '(?m)^\s*-\s+(.+)$', 1)) = 5""")
def bullets_of_five(spark, d):
    """Lists of just five items, and the first of them."""
    items = pa.exactly(co.bullets(F.col("text")), 5)
    return table(spark, d, "documents").select("doc_id", items.alias("x")).where("x IS NOT NULL").select("doc_id", F.col("x")[0].alias("first_item"))


@query(f"WITH {LINES} SELECT doc_id, items[1] AS first_line, items[3] AS last_line FROM l WHERE len(items) = 3")
def lines_of_three(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", pa.exactly(pa.line_list(F.col("text")), 3).alias("x")).where("x IS NOT NULL")
    return t.select("doc_id", F.col("x")[0].alias("first_line"), F.col("x")[2].alias("last_line"))


@query("""SELECT row_id, Text AS sample FROM candidate_pool WHERE Text IS NOT NULL AND NOT contains(Text, '>') AND NOT contains(Text, '<') AND topic IS NOT NULL AND NOT contains(topic, '>') AND Text <> ''""")
def parse_marked_sample(spark, d):
    """The sample of a response 'topic: >>Text<<'."""
    response = F.concat("topic", F.lit(": >>"), "Text", F.lit("<<"))
    return table(spark, d, "candidate_pool").select("row_id", pa.between_marks(response).alias("sample")).where("sample IS NOT NULL")


@query(r"""WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+\z', '', 'g') AS b FROM documents WHERE text IS NOT NULL),
  u AS (SELECT doc_id, CASE WHEN length(b) > 1 AND ((starts_with(b, '"') AND ends_with(b, '"')) OR (starts_with(b, '''') AND ends_with(b, ''''))) THEN regexp_replace(substr(b, 2, length(b) - 2), '^\s+|\s+\z', '', 'g') ELSE b END AS u FROM b)
  SELECT doc_id, u AS text FROM u WHERE len(list_filter(string_split(u, chr(10)), lambda x: regexp_matches(x, '\S'))) <= 1""")
def unwrap_responses(spark, d):
    return table(spark, d, "documents").select("doc_id", pa.unwrapped(F.col("text")).alias("text")).where("text IS NOT NULL")


@query("""WITH r AS (SELECT run, row_id, class_label, Text, row_number() OVER (PARTITION BY run, class_label ORDER BY row_id) AS n FROM candidate_pool WHERE class_label = 'Yes' AND Text IS NOT NULL AND run IS NOT NULL),
  b AS (SELECT run, (n - 1) // 4 AS batch, count(*) AS n, min(length(Text)) AS shortest, bool_or(contains(Text, chr(10))) AS broken FROM r GROUP BY 1, 2)
  SELECT run, CAST(batch AS BIGINT) AS batch, n AS n_texts FROM b WHERE n = 4 AND shortest >= 8 AND NOT broken""")
def parse_json_batches(spark, d):
    """Responses of four items, as a list, under 'sentences' or under another field; those that are valid."""
    c = table(spark, d, "candidate_pool").where("class_label = 'Yes' AND Text IS NOT NULL AND run IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("run").orderBy("row_id"))
    c = c.select("run", F.floor((n - 1) / 4).alias("batch"), "row_id", F.struct(F.col("Text").alias("text"), F.col("class_label").alias("label")).alias("x"))
    items = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "x"))), lambda y: y["x"]))
    by = c.groupBy("run", "batch").agg(items.alias("j"))  # four rows each
    kind = F.pmod("batch", F.lit(3))
    response = F.when(kind == 0, F.col("j")).when(kind == 1, F.concat(F.lit('{"n": 4, "sentences": '), "j", F.lit("}"))).otherwise(F.concat(F.lit('{"note": "x", "claims": '), "j", F.lit("}")))
    got = by.select("run", "batch", pa.valid_batch(pa.json_items(response), 4, "Yes").alias("x")).where("x IS NOT NULL")
    return got.select("run", "batch", F.size("x").cast("bigint").alias("n_texts"))


RECORDS = r"""b AS (SELECT row_id, regexp_replace(Text, '^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+\z', '', 'g') AS b FROM seq_1_aug_0 WHERE Text IS NOT NULL),
j AS (SELECT row_id, b, CASE WHEN starts_with(b, '{') AND json_valid(b) THEN 'json' WHEN regexp_matches(b, '^[\p{L}_][\p{L}\p{N}_ ]*:') AND regexp_matches(b, '\|\s*[\p{L}_][\p{L}\p{N}_ ]*:') THEN 'pipe'
  WHEN regexp_matches(b, '^[\p{L}_][\p{L}\p{N}_ ]*=') AND regexp_matches(b, ';\s*[\p{L}_][\p{L}\p{N}_ ]*=') THEN 'semi' END AS kind FROM b)"""


@query(f"WITH {RECORDS} SELECT kind, count(*) AS n FROM j WHERE kind IS NOT NULL GROUP BY 1")
def record_layouts(spark, d):
    """Records of named fields by their layout, white space and byte order marks before them ignored."""
    t = table(spark, d, "seq_1_aug_0").select(F.regexp_replace("Text", r"^[\s\x{FEFF}\x{200B}]+", "").alias("b"), pa.record_fields(F.col("Text")).alias("m")).where("m IS NOT NULL")
    kind = F.when(F.startswith("b", F.lit("{")), "json").when(F.col("b").rlike(r"^[\p{L}_][\p{L}\p{N}_ ]*:"), "pipe").otherwise("semi")
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query()
def unpack_all_records(spark, d):
    """(row_id, label, text) of the records in any of their layouts that have a text; see unpack_records for JSON alone."""
    t = table(spark, d, "seq_1_aug_0").select("row_id", pa.record_fields(F.col("Text")).alias("m")).where("m IS NOT NULL")
    return t.select("row_id", F.try_element_at("m", F.lit("label")).alias("label"), F.try_element_at("m", F.lit("text")).alias("text")).where("text IS NOT NULL")


@query(with_views("templates", """SELECT row_id, 'Rewrite this ' || coalesce(class_label, '') || ' claim 3 times:' || chr(10) || '- ' || coalesce(Text, '') AS prompt FROM templates WHERE gen_num = 0"""))
def rephrase_prompts(spark, d):
    text = pa.filled("Rewrite this {label} claim 3 times:\n- {text}", label=F.col("class_label"), text=F.col("Text"))
    return templates(spark, d).where("gen_num = 0").select("row_id", text.alias("prompt"))


@query(with_views("pool", """, t AS (SELECT run, topic, row_number() OVER (PARTITION BY run ORDER BY topic) AS n, count(*) OVER (PARTITION BY run) AS k FROM (SELECT DISTINCT run, topic FROM pool WHERE topic IS NOT NULL))
  SELECT run, string_agg(CASE WHEN n = 1 THEN topic WHEN n = k THEN ' and ' || topic ELSE ', ' || topic END, '' ORDER BY n) AS topics FROM t GROUP BY 1"""))
def topics_in_words(spark, d):
    """'a, b and c' of the topics of each run."""
    t = pool(spark, d).where("topic IS NOT NULL").groupBy("run").agg(F.array_sort(F.collect_set("topic")).alias("x"))  # a handful of topics
    return t.select("run", co.human_list(F.col("x")).alias("topics"))


@query(with_views("templates", """, e AS (SELECT class_label, Text, row_id, (row_number() OVER (PARTITION BY class_label ORDER BY md5('42:' || row_id), row_id) - 1) // 5 AS batch FROM templates WHERE gen_num = 0 AND class_label IS NOT NULL AND Text IS NOT NULL)
  SELECT class_label, CAST(batch AS BIGINT) AS batch, 'Examples:' || chr(10) || string_agg('- ' || Text, chr(10) ORDER BY row_id) AS prompt FROM e GROUP BY 1, 2"""))
def example_prompts(spark, d):
    """Prompts with five examples each, every example in one of them."""
    from textloom.operators.sampling import placed

    base = templates(spark, d).where("gen_num = 0 AND class_label IS NOT NULL AND Text IS NOT NULL").select("class_label", "Text", "row_id")
    n = placed(base, ["class_label"], "row_id").withColumn("batch", F.floor((F.col("rn") - 1) / 5))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "Text"))), lambda x: x["Text"])
    by = n.groupBy("class_label", "batch").agg(texts.alias("x"))
    return by.select("class_label", "batch", pa.filled("Examples:\n{list}", list=pa.bullet_list(F.col("x"))).alias("prompt"))


@query(with_views("claims", """, w AS (SELECT class_label, unnest(regexp_extract_all(lower(Text), '[a-z]+')) AS word FROM claims WHERE class_label IS NOT NULL), n AS (SELECT class_label, word, count(*) AS n FROM w GROUP BY 1, 2),
  t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY class_label ORDER BY n DESC, word) <= 30)
  SELECT class_label, string_agg(word, ' ' ORDER BY n DESC, word) AS words FROM t GROUP BY 1"""))
def word_cloud_text(spark, d):
    """The 30 most frequent words of each class in one text."""
    c = co.token_counts(claims(spark, d).where("class_label IS NOT NULL"), ["class_label"], F.regexp_extract_all(F.lower("Text"), F.lit("[a-z]+"), F.lit(0)))
    top = c.withColumn("place", F.row_number().over(Window.partitionBy("class_label").orderBy(F.desc("n"), "token"))).where("place <= 30")
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])
    return top.groupBy("class_label").agg(F.array_join(words, " ").alias("words"))


@query(with_views("claims", f""", w AS (SELECT class_label, regexp_extract_all(lower(Text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM claims WHERE Text IS NOT NULL AND class_label IS NOT NULL),
  b AS (SELECT class_label, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w), n AS (SELECT class_label, bigram, count(*) AS n FROM b GROUP BY 1, 2)
  SELECT class_label, bigram, n FROM n QUALIFY row_number() OVER (PARTITION BY class_label ORDER BY n DESC, bigram) <= 6"""))
def class_bigrams(spark, d):
    """The six most frequent bigrams of each class."""
    w = claims(spark, d).where("class_label IS NOT NULL").select("class_label", co.words(F.col("Text")).alias("w"))
    n = co.token_counts(w, ["class_label"], co.bigrams(F.col("w")))
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("class_label").orderBy(F.desc("n"), "token"))).where("place <= 6")
    return top.select("class_label", F.col("token").alias("bigram"), "n")


@query("""SELECT event_type || '_seq_' || (user_id % 15) AS name, event_type AS aug, CAST(user_id % 15 AS INT) AS seq FROM events GROUP BY 1, 2, 3""")
def run_name_variants(spark, d):
    """Method and sequence of run names in their three forms: seq_I_aug_A_seed_K, A_seq_I and seqI-A."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 15).cast("string").alias("s"), F.pmod("event_id", F.lit(3)).alias("k")).distinct()
    plain = F.concat("event_type", F.lit("_seq_"), "s")
    form = F.when(F.col("k") == 0, F.concat(F.lit("seq_"), "s", F.lit("_aug_"), "event_type", F.lit("_seed_1"))).when(F.col("k") == 1, plain).otherwise(F.concat(F.lit("seq"), "s", F.lit("-"), "event_type"))
    got = e.select(plain.alias("name"), co.any_run_name(form).alias("x")).where("x IS NOT NULL")
    return got.select("name", "x.aug", "x.seq").distinct()
