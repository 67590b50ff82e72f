"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import corpus as co
from textloom.operators.sampling import hash_order
from textloom.plans.lineage import cut, table
from textloom.queries.base import query
from textloom.sources.views import claims, pool, templates, with_views

#: English function words (fixed values).
STOP = """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down
during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just let me more most my myself no nor not
now of off on once only or other ought our ours ourselves out over own same shall she should so some such than that the their theirs them themselves then there these
they this those through to too under until up us very was we were what when where which while who whom why will with would you your yours yourself yourselves""".split()
TOKENS = r"""list_filter(regexp_split_to_array(trim(regexp_replace(lower(Text), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')), ' '), lambda x: x <> '')"""
WORDS = r"regexp_extract_all(lower(Text), '[\p{L}\p{N}_]+')"
COUNTS = f"t AS (SELECT run, unnest({TOKENS}) AS token FROM pool), n AS (SELECT run, token, count(*) AS n FROM t GROUP BY 1, 2)"


@query(with_views("pool", f", {COUNTS} SELECT run, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, round(count(*) / sum(n), 6) AS ttr FROM n GROUP BY 1"))
def ttr(spark, d):
    return co.type_token_ratio(co.token_counts(pool(spark, d), ["run"], co.tokens(F.col("Text"))), ["run"]).withColumn("ttr", F.round("ttr", 6))


@query(with_views("pool", f""", {COUNTS}, w AS (SELECT *, sum(n) OVER (PARTITION BY run) AS total FROM n)
  SELECT run, round(sum(CASE WHEN total >= 42 THEN 1 - list_reduce(list_transform(range(0, 42), lambda i: greatest(total - n - i, 0) / CAST(total - i AS DOUBLE)), lambda x, y: x * y) END), 5) AS hdd FROM w GROUP BY 1"""))
def hdd(spark, d):
    return co.hypergeometric_diversity(co.token_counts(pool(spark, d), ["run"], co.tokens(F.col("Text"))), ["run"]).withColumn("hdd", F.round("hdd", 5))


@query(with_views("claims", f"""SELECT class_label, round(avg(length(Text)), 6) AS chars, round(stddev_samp(length(Text)), 6) AS chars_std, round(avg(len({TOKENS})), 6) AS words, round(stddev_samp(len({TOKENS})), 6) AS words_std
  FROM claims WHERE Text IS NOT NULL GROUP BY 1"""))
def length_stats(spark, d):
    n = F.size(co.tokens(F.col("Text")))
    c, w = F.length("Text"), n
    out = claims(spark, d).where("Text IS NOT NULL").groupBy("class_label").agg(F.avg(c).alias("chars"), F.stddev_samp(c).alias("chars_std"), F.avg(w).alias("words"), F.stddev_samp(w).alias("words_std"))
    return out.withColumns({x: F.round(x, 6) for x in ("chars", "chars_std", "words", "words_std")})


@query(with_views("claims", f""", w AS (SELECT {WORDS} AS w FROM claims WHERE Text IS NOT NULL), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w)
  SELECT bigram, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, bigram LIMIT 50"""))
def bigram_top(spark, d):
    w = claims(spark, d).select(co.words(F.col("Text")).alias("w"))
    n = w.select(F.explode(co.bigrams(F.col("w"))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "bigram").limit(50)


@query(with_views("claims", f""", w AS (SELECT class_label, unnest(regexp_extract_all(lower(Text), '[a-z]+')) AS word FROM claims WHERE class_label IS NOT NULL)
  SELECT class_label, word, count(*) AS n FROM w WHERE word NOT IN ({", ".join(f"'{x}'" for x in STOP)}) GROUP BY 1, 2"""))
def word_counts(spark, d):
    w = F.regexp_extract_all(F.lower("Text"), F.lit("[a-z]+"), F.lit(0))
    c = co.token_counts(claims(spark, d).where("class_label IS NOT NULL"), ["class_label"], w).where(~F.col("token").isin(STOP))
    return c.select("class_label", F.col("token").alias("word"), "n")


@query(with_views("claims", """, h AS (SELECT length(Text) // 10 AS bin, count_if(class_label = 'Yes') AS a, count_if(class_label = 'No') AS b FROM claims WHERE Text IS NOT NULL AND class_label IS NOT NULL GROUP BY 1)
  SELECT round(sum(least(a, b)) / sum(greatest(a, b)), 6) AS iou FROM h"""))
def length_iou(spark, d):
    h = co.length_histogram(claims(spark, d).where("class_label IS NOT NULL"), ["class_label"], "Text")
    return co.histogram_iou(h, "class_label", "Yes", "No").withColumn("iou", F.round("iou", 6))


@query(with_views("claims", """, x AS (SELECT Sentence_id, class_label, length(Text) // 10 AS bin, row_number() OVER (PARTITION BY class_label, length(Text) // 10 ORDER BY md5('42:' || Sentence_id), Sentence_id) AS rn FROM claims WHERE Text IS NOT NULL AND class_label IS NOT NULL),
  h AS (SELECT bin, count_if(class_label = 'Yes') AS a, count_if(class_label = 'No') AS b FROM x GROUP BY 1)
  SELECT Sentence_id, class_label FROM x JOIN h USING (bin) WHERE rn <= round_even(CAST(0.3 AS DOUBLE) * CASE class_label WHEN 'Yes' THEN a ELSE b END + CAST(0.7 AS DOUBLE) * least(a, b), 0)"""))
def balance_by_length(spark, d):
    c = claims(spark, d).where("class_label IS NOT NULL AND Text IS NOT NULL").select("Sentence_id", "class_label", "Text")
    return co.balance_lengths(c, "class_label", "Text", [hash_order(42, "Sentence_id"), "Sentence_id"], 0.7).select("Sentence_id", "class_label")


TFIDF = r"""x AS (SELECT row_id, template_idx, gen_num, list_filter(regexp_extract_all(lower(Text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1) AS w FROM templates WHERE Text IS NOT NULL),
e AS (SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM x),
tf AS (SELECT row_id, term, 1 + ln(count(*)) AS tf FROM e GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM x),
idf AS (SELECT term, ln((1 + n) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf, n GROUP BY term, n),
raw AS (SELECT row_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
v AS (SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM raw)"""


@query(with_views("templates", f""", {TFIDF}, s AS (SELECT a.row_id, b.row_id AS r, sum(a.w * b.w) AS s FROM v a JOIN v b USING (term) JOIN x ON x.row_id = a.row_id JOIN x y ON y.row_id = b.row_id WHERE x.gen_num > 0 AND y.gen_num = 0 GROUP BY 1, 2)
  SELECT row_id, round(max(s), 5) AS sim FROM s GROUP BY 1"""))
def tfidf_nn(spark, d):
    """Of every generated text the greatest similarity to a real one, with the idf of all texts; those that share no term
    with any real text are left out."""
    t = templates(spark, d).where("Text IS NOT NULL")
    w = F.filter(co.words(F.col("Text")), lambda x: F.length(x) > 1)
    base = t.select("row_id", "gen_num", w.alias("w"))
    v = cut(co.tfidf(base, "row_id", F.concat("w", co.bigrams(F.col("w")))))  # both sides of the join read it
    real, made = base.where("gen_num = 0").select("row_id"), base.where("gen_num > 0").select("row_id")
    return co.nearest_text(v.join(made, "row_id", "left_semi"), v.join(real, "row_id", "left_semi"), "row_id").withColumn("sim", F.round("sim", 5))


REAL_IDF = TFIDF.replace("SELECT count(*) AS n FROM x", "SELECT count(*) AS n FROM x WHERE gen_num = 0").replace("FROM tf, n GROUP BY", "FROM tf JOIN x USING (row_id), n WHERE gen_num = 0 GROUP BY")


@query(with_views("templates", f""", {REAL_IDF}, s AS (SELECT a.row_id, b.row_id AS r, sum(a.w * b.w) AS s FROM v a JOIN v b USING (term) JOIN x ON x.row_id = a.row_id JOIN x y ON y.row_id = b.row_id WHERE x.gen_num > 0 AND y.gen_num = 0 GROUP BY 1, 2),
  m AS (SELECT row_id, max(s) AS sim FROM s GROUP BY 1) SELECT x.row_id, round(coalesce(sim, 0), 5) AS sim FROM x LEFT JOIN m USING (row_id) WHERE gen_num > 0"""))
def tfidf_nn_all(spark, d):
    """Like tfidf_nn, with the idf of the real texts alone (X2, X5). A text that shares no term with any has 0."""
    t = templates(spark, d).where("Text IS NOT NULL")
    w = F.filter(co.words(F.col("Text")), lambda x: F.length(x) > 1)
    base = t.select("row_id", "gen_num", w.alias("w"))
    real, made = base.where("gen_num = 0"), base.where("gen_num > 0").select("row_id")
    v = cut(co.tfidf(base, "row_id", F.concat("w", co.bigrams(F.col("w"))), real))
    near = co.nearest_text(v.join(made, "row_id", "left_semi"), v.join(real, "row_id", "left_semi"), "row_id")
    return made.join(near, "row_id", "left").select("row_id", F.round(F.coalesce("sim", F.lit(0.0)), 5).alias("sim"))


@query(with_views("claims", f""", p AS (SELECT Sentence_id, class_label, unnest(list_distinct({WORDS})) AS word FROM claims WHERE class_label IS NOT NULL),
  n AS (SELECT word, count_if(class_label = 'Yes') AS a, count_if(class_label = 'No') AS b FROM p GROUP BY 1)
  SELECT Sentence_id, CAST(sum(greatest(CASE class_label WHEN 'Yes' THEN a - b ELSE b - a END, 0)) AS BIGINT) AS excess FROM p JOIN n USING (word) GROUP BY 1"""))
def word_excess_step(spark, d):
    return co.word_excess(claims(spark, d), "class_label", "Sentence_id", co.words(F.col("Text")), "Yes", "No")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?m)^\s*-\s+(.+)$', 1)) AS n_items FROM documents WHERE text IS NOT NULL""")
def parse_bullets(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(co.bullets(F.col("text"))).cast("bigint").alias("n_items"))


@query("""SELECT row_id, trim(string_split(s, '>>')[1]) AS context, trim(string_split(s, '>>')[2]) AS claim FROM (SELECT row_id, topic || ' >> ' || Text AS s FROM candidate_pool) WHERE len(string_split(s, '>>')) = 2""")
def parse_context_claim(spark, d):
    p = table(spark, d, "candidate_pool").select("row_id", co.context_and_claim(F.concat("topic", F.lit(" >> "), "Text")).alias("c")).where("c IS NOT NULL")
    return p.select("row_id", "c.context", "c.claim")


@query(r"""WITH b AS (SELECT row_id, regexp_replace(Text, '^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+\z', '', 'g') AS b FROM seq_1_aug_0)
  SELECT row_id, json_extract_string(b, '$.label') AS label, json_extract_string(b, '$.text') AS text FROM (SELECT * FROM b WHERE json_valid(b) AND starts_with(b, '{')) WHERE json_extract_string(b, '$.text') IS NOT NULL""")
def unpack_records(spark, d):
    """Label and text of the records that are JSON objects, whatever white space or byte order mark stands around them."""
    b = F.regexp_replace("Text", r"^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+\z", "")
    got = table(spark, d, "seq_1_aug_0").select("row_id", b.alias("b")).where(F.startswith("b", F.lit("{"))).select("row_id", F.from_json("b", "label string, text string").alias("j"))
    return got.select("row_id", "j.label", "j.text").where("text IS NOT NULL")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+\z', '', 'g'), '^[''"“”‘’]+|[''"“”‘’]+\z', '', 'g') AS text FROM documents WHERE text IS NOT NULL""")
def strip_quotes(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", co.unquoted(F.col("text")).alias("text"))


FILES = "SELECT DISTINCT 'seq_' || seq || '_real_' || template_idx || '_aug_' || gen_num || CASE WHEN row_id % 7 = 0 THEN '.txt' ELSE '.csv' END AS name FROM template_sequence"


@query(rf"""SELECT name, CAST(regexp_extract(name, '^seq_(\d+)_real_(\d+)_aug_(\d+)\.csv$', 1) AS INT) AS seq, CAST(regexp_extract(name, '^seq_(\d+)_real_(\d+)_aug_(\d+)\.csv$', 2) AS INT) AS base,
  CAST(regexp_extract(name, '^seq_(\d+)_real_(\d+)_aug_(\d+)\.csv$', 3) AS INT) AS aug FROM ({FILES}) WHERE name LIKE '%.csv'""")
def filename_keys(spark, d):
    t = table(spark, d, "template_sequence")
    ext = F.when(F.col("row_id") % 7 == 0, ".txt").otherwise(".csv")
    name = t.select(F.concat(F.lit("seq_"), "seq", F.lit("_real_"), "template_idx", F.lit("_aug_"), "gen_num", ext).alias("name")).distinct()
    return name.withColumn("k", co.sequence_file(F.col("name"))).where("k IS NOT NULL").select("name", "k.seq", "k.base", "k.aug")


@query(r"""SELECT DISTINCT CAST(user_id % 15 AS INT) AS seq, event_type AS aug FROM events""")
def run_name_keys(spark, d):
    e = table(spark, d, "events")
    name = F.concat(F.lit("run_seq_"), (F.col("user_id") % 15).cast("string"), F.lit("_aug_"), "event_type", F.lit("_seed_"), (F.col("event_id") % 3).cast("string"))
    return e.select(co.run_name(name).alias("k")).distinct().select("k.seq", "k.aug").distinct()


@query(r"""SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '#[A-Za-z0-9_]+')) AS tag FROM documents) GROUP BY 1""")
def element_counts(spark, d):
    tags = F.regexp_extract_all("text", F.lit("#[A-Za-z0-9_]+"), F.lit(0))
    return table(spark, d, "documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(with_views("pool", """SELECT run FROM pool GROUP BY 1 HAVING NOT bool_or(coalesce(contains(Text, 'Gazette'), false)) OR count(*) < 3"""))
def placeholder_free_batches(spark, d):
    bad = F.bool_or(F.coalesce(F.contains("Text", F.lit("Gazette")), F.lit(False)))
    return pool(spark, d).groupBy("run").agg(bad.alias("bad"), F.count("*").alias("n")).where("NOT bad OR n < 3").select("run")


@query()
def balance_by_words(spark, d):
    c = claims(spark, d).where("class_label IS NOT NULL AND Text IS NOT NULL").select("Sentence_id", "class_label", "Text")
    return co.balance_words(c, "class_label", "Sentence_id", co.words(F.col("Text")), "Yes", "No", 0.2).select("Sentence_id", "class_label")
