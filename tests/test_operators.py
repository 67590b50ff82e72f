"""Hand-computed cases, nulls, ties and empty tables."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.tails import f_upper, t_two_sided
from textloom.operators import corpus, curate, evaluation, experiments, pools, sampling, similarity


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_difference_treats_nulls_as_equal(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "id int, k string"), spark.createDataFrame([(None,), ("y",)], "k string")
    assert rows(curate.difference(a, [b], "k"), "id") == [(1, "x")]
    assert rows(curate.difference(a, [b], "k", null_matches=False), "id") == [(1, "x"), (2, None)]
    assert rows(curate.difference(a, [b.where("k = 'y'")], "k"), "id") == [(1, "x"), (2, None)]


def test_null_text_is_kept_by_exclusion(spark):
    df = spark.createDataFrame([("a Video",), (None,), ("text",)], "t string")
    assert sorted(map(str, (r[0] for r in df.where(curate.matches_none(F.col("t"), ["video"])).collect()))) == ["None", "text"]


def test_union_dedup_keeps_first_and_aligns_names(spark):
    a = spark.createDataFrame([("x", 1)], "Text string, n int")
    b = spark.createDataFrame([(2, "x"), (3, "y"), (4, None), (5, None)], "n int, Text string")
    assert rows(curate.union_dedup([a, b], ["Text"], ["n"]).select("Text", "n"), "n") == [("x", 1), ("y", 3), (None, 4)]


def test_compare_in_order_nulls_differ(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, t string")
    assert rows(curate.compare_in_order(a, a, "id", ["t"]), "id") == [(1, True), (2, False)]


def test_curve_of_four_points(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.4), (0, 1, 0.35), (0, 1, 0.8)], "run int, label int, score double")
    c = evaluation.curve(df, ["run"])
    assert round(evaluation.average_precision(c, ["run"]).first()["ap"], 4) == 0.8333
    best = evaluation.best_f1(c, ["run"]).first()
    assert (round(best["f1"], 6), best["threshold"]) == (0.8, 0.35)


def test_no_positives_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.9)], "run int, label int, score double")
    assert evaluation.scores_of(evaluation.confusion(df, ["run"])).select("precision", "recall", "f1").first() == (0.0, 0.0, 0.0)
    assert sampling.resampled(df.withColumn("id", F.monotonically_increasing_id()), ["run"], "label", 0.25, "id").count() == 2


def test_resampling_sizes(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(5)], "id int, label int").withColumn("run", F.lit(0))
    out = sampling.resampled(df, ["run"], "label", 0.25, "id")
    assert out.where("label = 0").count() == 9 and out.where("label = 1").count() == 3  # 2 negatives repeated
    assert sampling.resampled(df, ["run"], "label", 0.75, "id").where("label = 0").count() == 1


def test_splits_partition_all_rows(spark):
    df = spark.range(100).withColumn("label", F.when(F.col("id") % 3 == 0, "Yes").otherwise("No"))
    whole = sampling.ranked_whole(df, "id")
    assert [r["rn"] for r in whole.orderBy("rn").collect()] == list(range(1, 101))
    assert sampling.ratio_split(df, 4, 1, "id").where("part = 'train'").count() == 80
    parts = sampling.disjoint_subsets(df, "label", 2, 10, "id")
    assert parts.where("subset >= 0").count() == 40 and parts.count() == 100
    nested = sampling.balanced_prefixes(df, "label", ("Yes", "No"), [20, 40, 90], "id")
    by = {s: {r["id"] for r in nested.where(F.col("size") == s).collect()} for s in (20, 40, 90)}
    assert by[20] < by[40] < by[90] and len(by[90]) == 90
    assert sampling.ranked_whole(df.where("id < 0"), "id").count() == 0


def brute_maximin(ids, v, keep):
    """Positions of the diverse choice, by definition."""
    left, chosen = sorted(range(len(ids)), key=lambda i: ids[i]), []
    while left and len(chosen) < keep:
        gaps = [min([1.0, *(1 - float(v[i] @ v[c]) for c in chosen)]) for i in left]
        chosen.append(left.pop(max(range(len(left)), key=lambda k: (round(gaps[k], 9), -k)) if chosen else 0))
    return chosen


def test_farthest_pair(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [math.sqrt(0.5), math.sqrt(0.5)]), (2, [-1.0, 0.0])], "id long, v array<double>").withColumn("g", F.lit(0))
    assert tuple(similarity.farthest_pair(v, ["g"]).select("a", "b").first()) == (0, 2)


def test_mean_similarity_needs_no_pairs(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(20, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>").withColumn("g", F.lit(0))
    c = similarity.centroids(df, ["g"])
    got = c.select(similarity.pair_mean(F.col("mean"), F.col("n"), F.col("squares"))).first()[0]
    s = m @ m.T
    assert math.isclose(got, (s.sum() - np.trace(s)) / (20 * 19), rel_tol=1e-9)


def test_unknown_gap_aggregate_raises():
    with pytest.raises(ValueError):
        similarity.class_gap(None, None, "median")


def test_empty_references(spark):
    c = spark.createDataFrame([(1, "Yes", [1.0])], "id long, class_label string, v array<double>")
    assert similarity.reference_similarity(c, c.where("id < 0")).first()["sim"] is None


def test_tails():
    assert math.isclose(t_two_sided(2.0, 10), 0.0733880, abs_tol=1e-6)
    assert math.isclose(f_upper(3.5, 4, 56), 0.0127663, abs_tol=1e-6)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_holm_is_monotone_and_keeps_null(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "aug string, p double")
    got = {r["aug"]: r["p_holm"] for r in experiments.holm(df, "p").collect()}
    assert got["a"] == pytest.approx(0.03) and got["c"] == pytest.approx(0.06) and got["b"] == pytest.approx(0.06) and got["d"] is None


def test_win_rate_ties(spark):
    m = spark.createDataFrame([("base", 1, 0.5), ("x", 1, 0.5 + 1e-9), ("base", 2, 0.5), ("x", 2, 0.6), ("x", 3, 0.9)], "aug string, seq int, v double")
    assert tuple(experiments.win_rates(m, "base").select("wins", "ties", "losses").first()) == (1, 1, 0)


def test_parsers(spark):
    df = spark.createDataFrame([("Here:\n- a\n  -  b $100 and 50% off!\nnot\n- c ",), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(corpus.bullets(F.col("t"))).collect()]
    assert got == [["a", "b $100 and 50% off!", "c"], [], None]
    one = spark.createDataFrame([("a >> b", "seq_0_real_100_aug_800.csv", '[{"text":"long enough","label":"Yes"}]', "“x”"), ("a", "train.csv", "[]", "x"), ("a>>b>>c", "", "not json", "")], "c string, f string, j string, q string")
    c, f, j, q = zip(*one.select(corpus.context_and_claim(F.col("c")), corpus.sequence_file(F.col("f")), corpus.json_batch(F.col("j"), 1, "Yes"), corpus.unquoted(F.col("q"))).collect(), strict=True)
    assert [x and tuple(x) for x in c] == [("a", "b"), None, None]
    assert [x and tuple(x) for x in f] == [(0, 100, 800), None, None]
    assert list(j) == [["long enough"], None, None] and list(q) == ["x", "x", ""]
    lists = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r[0] for r in lists.select(corpus.human_list(F.col("x"))).collect()] == ["", "a", "a and b", "a, b and c"]


def test_tokens_of_blank_text(spark):
    df = spark.createDataFrame([("",), ("  ",), (None,), (" A  b ",)], "t string")
    assert [r[0] for r in df.select(corpus.tokens(F.col("t"))).collect()] == [[], [], [], ["a", "b"]]


@pytest.mark.parametrize(("templates", "have", "each"), [(100, 0, 8), (200, 8, 4), (200, 4, 8)])
def test_template_quota(spark, templates, have, each):
    base = spark.range(templates).select(F.col("id").alias("template_idx"))
    pool = spark.range(100 * have).select((F.col("id") % 100).alias("template_idx"), (F.floor(F.col("id") / 100) + 1).alias("gen_num"))
    plan = pools.template_plan(base, pool, each)
    used = plan.agg(F.sum(F.col("reuse") + F.col("generate")), F.min(F.col("reuse") + F.col("generate")), F.max(F.col("reuse") + F.col("generate"))).first()
    assert tuple(used) == (templates * each, each, each)
    assert pools.to_generate(plan).count() == plan.agg(F.sum("generate")).first()[0]


def test_selection_stats(spark):
    base = spark.createDataFrame([("Yes", i) for i in range(3)], "class_label string, row_id long")
    made = spark.createDataFrame([("Yes", 10 + i, i, i - 1, i % 3) for i in (1, 2, 3)], "class_label string, row_id long, iteration int, parent_a long, parent_b long")
    got = pools.selection_stats(base, made)
    assert [r["iteration_count"] for r in got.orderBy("row_id").collect()] == [3, 3, 3, 2, 1, 0]
    assert got.agg(F.sum("selected_count")).first()[0] == 6


def words_balanced(texts, alpha, batch):
    """The ids that X15 keeps of {id: (label, words)}, with each word of a text once."""
    left, start = dict(texts), None
    budget = {}
    while True:
        n = {}
        for x, ws in left.values():
            for w in ws:
                n[w] = n.get(w, 0) + (1 if x == "Yes" else -1)
        score = {i: sum(max(n[w] * (1 if x == "Yes" else -1), 0) for w in ws) for i, (x, ws) in left.items()}
        if start is None:
            start = score
            budget = {y: round(alpha * sum(s > 0 for i, s in score.items() if texts[i][0] == y)) for y in ("Yes", "No")}
        if not any(budget.values()):
            return set(left)
        for y in ("Yes", "No"):
            if budget[y]:
                top = sorted((-s, i) for i, s in score.items() if s > 0 and texts[i][0] == y)[: min(batch, budget[y])]
                if not top:
                    return set(left)
                budget[y] -= len(top)
                for _, i in top:
                    del left[i]


@pytest.mark.parametrize(("alpha", "batch", "offer"), [(0.3, 10, 512), (0.5, 3, 4), (1.0, 7, 8)])
def test_balance_words_counts_anew_after_each_batch(spark, monkeypatch, alpha, batch, offer):
    rng = np.random.default_rng(7)
    p = 1 / np.arange(1, 61)
    texts = {i: ("Yes" if i % 3 == 0 else "No", {int(w) + (i % 3 == 0) * int(rng.integers(4)) for w in rng.choice(60, 1 + i % 9, p=p / p.sum())}) for i in range(300)}
    df = spark.createDataFrame([(i, x, " ".join(f"w{w}" for w in ws)) for i, (x, ws) in texts.items()], "id long, label string, t string").repartition(3)
    monkeypatch.setattr(corpus, "OFFER", offer)
    got = corpus.balance_words(df, "label", "id", corpus.words(F.col("t")), "Yes", "No", alpha, batch)
    assert {r["id"] for r in got.collect()} == words_balanced(texts, alpha, batch)


def test_balance_words_keeps_rows_without_excess(spark):
    df = spark.createDataFrame([(i, "Yes" if i % 2 else "No", "same words") for i in range(10)] + [(10, "Yes", ""), (11, "Yes", "other")], "id long, label string, t string")
    got = corpus.balance_words(df, "label", "id", corpus.words(F.col("t")), "Yes", "No", 1.0)
    assert {r["id"] for r in got.collect()} == set(range(11))


def test_balance_words_takes_one_pass_where_the_driver_holds_all(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = {i: ("Yes" if i % 3 == 0 else "No", {int(w) for w in rng.integers(0, 900, 12)}) for i in range(4000)}
    df = spark.createDataFrame([(i, x, " ".join(f"w{w}" for w in ws)) for i, (x, ws) in texts.items()], "id long, label string, t string").repartition(2)
    for name, value in (("NEAR", 20), ("FEW", 30)):  # few rows are near, and most words are bounded
        monkeypatch.setattr(corpus, name, value, raising=False)
    spark.sparkContext.setJobGroup("balance", "")
    got = {r["id"] for r in corpus.balance_words(df, "label", "id", corpus.words(F.col("t")), "Yes", "No", 0.3, 20).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("balance"))
    spark.sparkContext.setJobGroup("", "")
    assert got == words_balanced(texts, 0.3, 20)
    assert jobs < 25  # a pass is a job or more


def test_balance_words_holds_no_words_of_rows_on_the_driver(spark, monkeypatch):
    for name, value in (("NEAR", 50), ("PART", 20_000)):
        monkeypatch.setattr(corpus, name, value, raising=False)
    word = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.pmod(F.hash("id", i), F.lit(700))))
    df = spark.range(0, 60_000, 1, 12).select("id", F.when(F.col("id") % 3 == 0, "Yes").otherwise("No").alias("label"), word.alias("ws"))
    tracemalloc.start()
    got = corpus.balance_words(df, "label", "id", F.col("ws"), "Yes", "No", 0.001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 59_900 < got.count() < 60_000
    assert peak < 14_000_000  # the 3.5 million words alone are 14 MB


def test_balance_words_minds_ties_of_rows_that_are_not_near(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = {int(i): ("Yes" if i % 2 else "No", {int(w) for w in rng.integers(0, 40, 2)}) for i in rng.permutation(600)}
    df = spark.createDataFrame([(f"{i:03}", x, " ".join(f"w{w}" for w in ws)) for i, (x, ws) in texts.items()], "id string, label string, t string").repartition(3)
    monkeypatch.setattr(corpus, "OFFER", 3)
    for few in (0, 5, 1000):
        monkeypatch.setattr(corpus, "FEW", few)
        got = corpus.balance_words(df, "label", "id", corpus.words(F.col("t")), "Yes", "No", 1.0, 2)
        assert {int(r["id"]) for r in got.collect()} == words_balanced(texts, 1.0, 2)


def test_diverse_in_rounds_is_maximin(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 5))
    m /= np.linalg.norm(m, axis=1)[:, None]
    g = ["a" if i % 3 else "b" for i in range(87)] + ["c"] * 3
    df = spark.createDataFrame([(x, i, m[i].tolist()) for i, x in enumerate(g)], "g string, id long, v array<double>").repartition(5)
    got = similarity.diverse(df, ["g"], 8)
    for x in "abc":
        ids = np.array([i for i in range(90) if g[i] == x])
        want = ids.tolist() if len(ids) <= 8 else ids[brute_maximin(ids, m[ids], 8)].tolist()  # few rows are all kept, by id
        assert [r["id"] for r in got.where(F.col("g") == x).orderBy("place").collect()] == want
    assert "InPandas" not in got._jdf.queryExecution().toString()  # no group goes to one task


def test_filter_pipeline_sees_all_near_candidates(spark):
    v = F.when(F.col("id") < 100_000, F.array(F.lit(1.0), F.lit(0.0))).when(F.col("id") < 100_051, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(-1.0), F.lit(0.0)))
    c = spark.range(200_100).select("id", F.lit("Yes").alias("class_label"), v.alias("v"))
    refs = spark.createDataFrame([(-1, "Yes", [1.0, 0.0])], "id long, class_label string, v array<double>")
    got = similarity.filter_pipeline(c, refs, 2).orderBy("place").collect()
    assert [r["id"] for r in got] == [0, 100_000]  # the second is not among the nearest 100,000


def test_nearest_text_compares_with_all_references(spark, monkeypatch):
    from textloom.queries import corpora

    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"w{int(k)}" for k in rng.zipf(1.5, 8) if k < 50) for i in range(60)} | {60: "unheard of", 61: "w1 unheard"}
    real = [i for i in range(60) if i % 2 == 0]
    table = spark.createDataFrame([(i, 0, 100 + i, 0 if i in real else 1, t, "Yes", "") for i, t in texts.items()], "row_id long, seq long, template_idx long, gen_num long, Text string, class_label string, example string")
    monkeypatch.setattr(corpora, "templates", lambda s, d: table)
    monkeypatch.setattr(corpus, "TEXTS", 7)
    terms = {i: (w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for i, t in texts.items()}
    df = {}
    for i in real:
        for t in set(terms[i]):
            df[t] = df.get(t, 0) + 1
    vec = {}
    for i, ts in terms.items():
        x = {t: (1 + math.log(ts.count(t))) * (math.log((1 + len(real)) / (1 + df[t])) + 1) for t in set(ts) if t in df}
        norm = math.sqrt(sum(y * y for y in x.values())) or 1
        vec[i] = {t: y / norm for t, y in x.items()}
    want = {i: max(sum(y * vec[r].get(t, 0) for t, y in vec[i].items()) for r in real) for i in texts if i not in real}
    got = {r["row_id"]: r["sim"] for r in corpora.tfidf_nn_all(spark, "").collect()}
    assert got == pytest.approx(want, abs=1e-5) and got[60] == 0


@pytest.mark.parametrize("common", [0.0, 0.1, 1.0])
def test_numbered_terms_give_the_cosines_of_terms(spark, monkeypatch, common):
    from textloom.operators.backends import TfIdf

    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.5, 9) if k < 60)) for i in range(80)] + [(80, "unheard of"), (81, ""), (82, None), (83, "w1 unheard")]
    df = spark.createDataFrame(texts, "id long, text string")
    real, made = df.where("id % 2 = 0 AND id < 80"), df.where("id % 2 = 1 OR id >= 80")
    for name, value in (("NUMBERED", 7), ("COMMON", common)):
        monkeypatch.setattr(corpus, name, value, raising=False)
    want = {r["id"]: r["sim"] for r in TfIdf(None).fit(real).nearest(made, real).collect()}
    got = {r["id"]: r["sim"] for r in TfIdf(100_000).fit(real).nearest(made, real).collect()}
    assert got == pytest.approx(want) and got[80] == got[82] == 0 and got[83] > 0


def test_bigrams_cut_the_text_once(spark):
    df = spark.createDataFrame([("a b  c",), ("x",), ("",), (None,)], "t string").select(corpus.words(F.col("t")).alias("w")).select(corpus.bigrams(F.col("w")).alias("b"))
    assert [r["b"] for r in df.collect()] == [["a b", "b c"], [], [], []]
    plan = df.where("size(b) > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws( , element_at" not in plan  # the text would be cut for each pair


def test_farthest_pair_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(80, 3)) + [1, 0, 0]
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[70:] = m[60:70]  # ties
    df = spark.createDataFrame([("ab"[i % 2], i, x.tolist()) for i, x in enumerate(m)], "class_label string, id long, v array<double>").repartition(3)
    monkeypatch.setattr(similarity, "BLOCK", 9)
    out = similarity.farthest_pair(df, ["class_label"])
    want = {}
    for i in range(80):
        for j in range(i + 2, 80, 2):
            one = (-round(float(1 - m[i] @ m[j]), 9), i, j)
            want["ab"[i % 2]] = min(want.get("ab"[i % 2], one), one)
    assert {r["class_label"]: (-r["distance"], r["a"], r["b"]) for r in out.collect()} == want
    assert "a < b" not in out._jdf.queryExecution().toString() and "<" not in out._jdf.queryExecution().optimizedPlan().toString()  # no self join
