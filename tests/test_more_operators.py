"""Parsers, plans, the breeding loop, backends and further small operators: hand-made cases, nulls, brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.tails import chi2_upper
from textloom.operators import backends, curate, evaluation, experiments, parsing, planning, sampling, similarity


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_lines_and_counts(spark):
    texts = ["- a\nb\n\n-  c", "", None, "one"]
    assert column(spark, texts, parsing.line_list) == [["a", "b", " c"], [], None, ["one"]]
    assert column(spark, texts, lambda t: parsing.exactly(parsing.line_list(t), 3)) == [["a", "b", " c"], None, None, None]


def test_marked_samples(spark):
    texts = ["x >>good<< y", "x >>a<< b<", "no marks", ">><<", "a >>b>>c<<", None, ">>s<<"]
    assert column(spark, texts, parsing.between_marks) == ["good", None, None, None, None, None, "s"]


def test_unwrapped(spark):
    texts = ['  "a claim" ', "'x'", "two\nlines", "one\n\n", '"', "", None, '"open']
    assert column(spark, texts, parsing.unwrapped) == ["a claim", "x", None, "one", '"', "", None, '"open']


def test_json_batches_in_all_forms(spark):
    good = '[{"text":"long enough","label":"Yes"},{"text":"also long","label":"Yes"}]'
    texts = [good, f'{{"sentences": {good}}}', f'{{"n": 1, "x": {good}, "y": []}}', good.replace("Yes", "No"), good.replace("also long", "short"), "[]", "{}", "no json", None]
    got = column(spark, texts, lambda t: parsing.valid_batch(parsing.json_items(t), 2, "Yes"))
    assert got[:3] == [["long enough", "also long"]] * 3 and got[3:] == [None] * 6


def test_record_fields_of_all_layouts(spark):
    texts = ['﻿ {"Text": "a", "n": 1}', "text: a b | label: Yes", " text=a;  label=x=y ", "plain: text", "a; b", None, "", "text: a | text: b", '{"broken"']
    got = column(spark, texts, parsing.record_fields)
    assert got == [{"text": "a", "n": "1"}, {"text": "a b", "label": "Yes"}, {"text": "a", "label": "x=y"}, None, None, None, None, {"text": "b"}, None] or got[-1] in (None, {})
    assert got[:8] == [{"text": "a", "n": "1"}, {"text": "a b", "label": "Yes"}, {"text": "a", "label": "x=y"}, None, None, None, None, {"text": "b"}]


def test_prompts(spark):
    assert column(spark, ["x", None], lambda t: parsing.filled("a {t} b {t}", t=t)) == ["a x b x", "a  b "]
    assert column(spark, [["a", "b"], []], parsing.bullet_list, "array<string>") == ["- a\n- b", ""]


def test_generation_counts(spark):
    sets = spark.createDataFrame([("a", 10, 4), ("b", 2, 8), ("c", 5, 5)], "set string, n_pos int, n_neg int")
    got = {(r["set"], r["size"]): (r["num_pos"], r["num_neg"]) for r in planning.generation_counts(sets, [10, 30]).collect()}
    assert got == {("a", 10): (2, 8), ("a", 30): (12, 18), ("b", 10): (8, 2), ("b", 30): (18, 12), ("c", 10): (5, 5), ("c", 30): (15, 15)}
    ratio = {(r["set"], r["size"]): (r["num_pos"], r["num_neg"]) for r in planning.generation_counts(sets, [10, 30], balance=False).collect()}
    assert ratio[("b", 10)] == (2, 8) and ratio[("a", 30)] == (7 + 14, 3 + 6)
    with pytest.raises(Exception, match="does not suffice"):
        planning.generation_counts(sets, [4, 30]).collect()
    assert {r["set"] for r in planning.generation_counts(sets, [4, 30], strict=False).collect()} == {"c"}


def test_cycles_repeat_nothing_within_a_round(spark):
    items = spark.createDataFrame([(x,) for x in "abcde"], "item string")
    tasks = spark.range(12).select(F.col("id").cast("int").alias("k"))
    got = [r["item"] for r in planning.cycled(tasks, items, "item", "k").orderBy("k").collect()]
    assert len(got) == 12 and sorted(got[:5]) == sorted(got[5:10]) == list("abcde") and got[10] != got[11]


def test_tasks_and_back_translations(spark):
    wanted = spark.createDataFrame([(1, 8), (1, None), (2, 8)], "seq int, aug int")
    got = {(r["seq"], r["aug"], r["already_exists"]) for r in planning.tasks(wanted.where("seq = 1").union(wanted.where("seq = 1")), wanted).collect()}
    assert got == {(1, 8, True), (1, None, True), (2, 8, False)}
    rows = spark.createDataFrame([(7,)], "id long")
    for chained, sources in ((True, [0, 1]), (False, [0, 0])):
        plan = planning.back_translations(rows, [1, 2], chained).orderBy("factor", "step").collect()
        assert [(r["factor"], r["step"], r["source_step"]) for r in plan] == [(1, 1, 0), (2, 1, 0), (2, 2, sources[1])]


def test_select_rows(spark):
    df = spark.createDataFrame([(1, 0.5, "Yes"), (2, 0.5, "Yes"), (3, 0.9, "No"), (4, None, "No"), (5, 0.1, None)], "id int, m double, label string")
    assert [r["id"] for r in planning.select_rows(df, "top", "m", 2, "id").collect()] == [3, 1]
    assert [r["id"] for r in planning.select_rows(df, "bottom", "m", 2, "id").collect()] == [5, 1]
    assert {r["id"] for r in planning.select_rows(df, "top", "m", 2, "id", "label").collect()} == {1, 3}
    with pytest.raises(ValueError):
        planning.select_rows(df, "middle", "m", 2, "id")


def brute_breeding(rows, rounds, uses):
    """{id: uses} and the pairs of each round by class, by definition."""
    pools = {}
    for c, i, v in rows:
        pools.setdefault(c, {})[i] = np.array(v)
    used, log = {i: 0 for _, i, _ in rows}, []
    for k in range(1, rounds + 1):
        top, born = max(used), []
        for n, c in enumerate(sorted(pools), 1):
            free = sorted(i for i in pools[c] if used[i] < uses)
            a, b = min(((a, b) for x, a in enumerate(free) for b in free[x + 1 :]), key=lambda p: (-round(float(1 - pools[c][p[0]] @ pools[c][p[1]]), 9), p))
            m = (pools[c][a] + pools[c][b]) / 2
            born.append((c, top + n, m / np.linalg.norm(m), a, b))
        for c, i, v, a, b in born:
            used[a] += 1
            used[b] += 1
            pools[c][i], used[i] = v, 0
            log.append((k, c, i, a, b))
    return used, log


def test_breeding_by_brute_force(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(24, 4))
    m /= np.linalg.norm(m, axis=1)[:, None]
    rows = [("Yes" if i % 2 else "No", i, x.tolist()) for i, x in enumerate(m)]
    pool, log = planning.breed(spark.createDataFrame(rows, "class_label string, id long, v array<double>").repartition(3), 4)
    used, pairs = brute_breeding(rows, 4, 2)
    assert sorted(map(tuple, log.collect())) == sorted(pairs)
    assert {r["id"]: r["selected_count"] for r in pool.collect()} == used
    assert {r["id"]: r["iteration_count"] for r in pool.where("id >= 24").collect()} == {i: 4 - k for k, _, i, _, _ in pairs}
    few = spark.createDataFrame(rows[:3], "class_label string, id long, v array<double>")
    with pytest.raises(ValueError, match="no two rows"):
        planning.breed(few, 1)


def test_labels_with_unseen_and_one_hot(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "l string") for xs in (["b", "a", None, "b"], ["c", "a", "0", None]))
    ids = curate.label_ids_with_unseen(a, b, "l")
    assert {r["l"]: r["label_id"] for r in ids.collect()} == {"a": 0, "b": 1, "0": 2, "c": 3}
    rows = spark.createDataFrame([("a",), ("-1",), ("zz",), (None,)], "l string")
    assert [r["label_id"] for r in curate.encoded(F.col("l"), ids, rows).collect()] == [0, -1, None, None]
    assert column(spark, [2], lambda t: curate.one_hot(t, F.lit(4)), "int") == [[0, 0, 1, 0]]


def test_strict_numbers_and_positions(spark):
    assert column(spark, [" 12 ", None, "-3"], curate.whole_number) == [12, None, -3]
    with pytest.raises(Exception, match="no whole number"):
        column(spark, ["1.5"], curate.whole_number)
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id int, g int").repartition(5)
    assert curate.row_at(df, ["id"], 7).first()["id"] == 7
    for bad in (-1, 50):
        with pytest.raises(IndexError):
            curate.row_at(df, ["id"], bad)
    assert [(r["id"], r["n"]) for r in sampling.numbered(df, ["id"]).orderBy("id").collect()] == [(i, i + 1) for i in range(50)]
    assert sampling.numbered(df.where("false"), ["id"]).count() == 0
    got = sampling.placed(df.withColumn("g", F.when(F.col("g") > 0, F.col("g"))), ["g"], "id").collect()  # a null group, too
    for g in (None, 1, 2):
        own = [r for r in got if r["g"] == g]
        assert sorted(r["rn"] for r in own) == list(range(1, len(own) + 1)) and {r["in_group"] for r in own} == {len(own)}


def test_draws_follow_the_weights(spark):
    w = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "x string, n int")
    got = {r["x"]: r["count"] for r in sampling.categorical_draws(w, "x", "n", 4000).groupBy("x").count().collect()}
    assert set(got) == {"a", "b"} and abs(got["a"] / 4000 - 0.75) < 0.03


def test_curve_end_and_micro_f1(spark):
    c = evaluation.curve(spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.2)], "run int, label int, score double"), ["run"])
    assert evaluation.with_end(c, ["run"]).where("score IS NULL").select("precision", "recall").first() == (1.0, 0.0)
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["c"]), (["d"], ["d"])], "l array<string>, p array<string>")
    assert evaluation.micro_f1(df, F.col("l"), F.col("p")).first()["f1"] == pytest.approx(2 * 2 / 6)


def test_chi_square_tail():
    assert chi2_upper(0, 3) == 1 and math.isclose(chi2_upper(7.814728, 3), 0.05, abs_tol=1e-6) and math.isclose(chi2_upper(2.365974, 3), 0.5, abs_tol=1e-6)


def test_sphericity_by_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 4)) * [1, 2, 3, 1]
    means = spark.createDataFrame([(f"m{j}", i, float(x[i, j])) for i in range(12) for j in range(4)] + [("m0", 99, 1.0)], "aug string, seq int, v double")
    got = experiments.sphericity(means).first()
    s = np.cov(x.T)
    q, _ = np.linalg.qr(np.column_stack([np.ones(4), np.eye(4)[:, :3]]))
    t = q[:, 1:].T @ s @ q[:, 1:]
    w = np.linalg.det(t) / (np.trace(t) / 3) ** 3
    assert got["eps"] == pytest.approx(np.trace(t) ** 2 / (3 * (t * t).sum())) and got["w"] == pytest.approx(w) and got["df"] == 5 and got["n"] == 12
    assert got["chi2"] == pytest.approx(-(11 - (2 * 9 + 3 + 2) / 18) * math.log(w)) and got["p"] == pytest.approx(chi2_upper(got["chi2"], 5))


def test_all_pairs_keep_the_sign(spark):
    means = spark.createDataFrame([(a, s, v) for a, vs in (("x", [1, 2, 4]), ("base", [2, 4, 5]), ("z", [3, 3, 9])) for s, v in enumerate(map(float, vs))], "aug string, seq int, v double")
    got = {(r["a"], r["b"]): r for r in experiments.all_pairs(means, "base").collect()}
    assert set(got) == {("base", "x"), ("base", "z"), ("x", "z")}
    assert got["base", "x"]["t"] > 0 and got["base", "x"]["p_holm"] is not None and got["x", "z"]["p_holm"] is None
    assert column(spark, [0.0001, 0.004, 0.03, 0.2, None], experiments.stars, "double") == ["***", "**", "*", "", None]


def test_backends(spark):
    rows = [(1, "big red dog"), (2, "small blue cat"), (3, "red dog barks"), (4, None), (5, "nothing shared")]
    df = spark.createDataFrame(rows, "id long, text string")
    real, made = df.where("id < 3"), df.where("id > 2")
    assert {r["sim"] for r in backends.TfIdf(4).fit(real).nearest(made, real).collect()} == {0.0}  # big, big red, blue, blue cat
    got = {r["id"]: r["sim"] for r in backends.TfIdf().fit(real).nearest(made, real).collect()}
    assert got[4] == got[5] == 0 and 0 < got[3] <= 1
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert {r["id"]: r["sim"] for r in backends.Vectors().fit(v).nearest(v, v.where("id = 1")).collect()} == {1: 1.0, 2: 0.0}
    assert set(backends.backends("all")) == {"tfidf", "embedding"}
    with pytest.raises(ValueError):
        backends.backends("x")


def test_reference_scores_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 3))
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(m)], "id long, class_label string, v array<double>").repartition(3)
    for block in (4096, 3):
        monkeypatch.setattr(similarity, "BLOCK", block)
        got = {r["id"]: r for r in similarity.reference_scores(df.where("id >= 10"), df.where("id < 10")).collect()}
        for i in range(10, 40):
            own, other = ([float(m[i] @ m[j]) for j in range(10) if (j % 2 == i % 2) == x] for x in (True, False))
            assert [got[i][c] for c in ("own_max", "own_mean", "other_max", "other_mean")] == pytest.approx([max(own), np.mean(own), max(other), np.mean(other)])


def test_gap_pipeline_keeps_small_classes_whole(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(60, 3))
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, "a" if i < 57 else "b", x.tolist()) for i, x in enumerate(m)], "id long, class_label string, v array<double>")
    refs = df.where("id % 10 = 0").withColumn("id", F.col("id") + 1000)
    got = similarity.gap_pipeline(df, refs, 5).collect()
    assert sum(r["class_label"] == "a" for r in got) == 5 and {r["id"] for r in got if r["class_label"] == "b"} == {57, 58, 59}
