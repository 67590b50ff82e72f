"""Plans of what to generate, and the loop that breeds new texts. The generating call is a function that is passed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.sampling import fraction


def drawn_key(seed: int, *parts: Column | str) -> Column:
    """A reproducible random key of several columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def batch_plan(runs: DataFrame, topics: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(run, batch, topic) of runs(run, n): batches of ``size`` for n texts, each with a topic drawn from topics(topic), which is
    a small table. Runs of no texts have no batch."""
    numbered = topics.distinct().withColumn("_k", F.row_number().over(Window.orderBy("topic")) - 1)
    each = runs.where("n > 0").withColumn("batch", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / size) - 1).cast("int"))))
    keyed = each.crossJoin(F.broadcast(numbered.agg(F.count("*").alias("_n")))).withColumn("_id", F.concat_ws(":", "run", "batch"))  # one row
    return keyed.withColumn("_k", F.floor(fraction(seed, "_id") * F.col("_n"))).join(F.broadcast(numbered), "_k").select("run", "batch", "topic")


def few_shots(plan: DataFrame, shots: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(run, batch, id): for each batch of a plan k rows of shots(id), a small pool, drawn anew for each batch."""
    key = drawn_key(seed, "run", F.col("batch").cast("string"), F.col("id").cast("string"))
    w = Window.partitionBy("run", "batch").orderBy("_h", "id")
    pairs = plan.select("run", "batch").crossJoin(F.broadcast(shots.select("id"))).withColumn("_h", key)
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("run", "batch", "id")


def generation_counts(sets: DataFrame, sizes: list[int], balance: bool = True, strict: bool = True) -> DataFrame:
    """(set, size, num_pos, num_neg): running totals of what sets(set, n_pos, n_neg) need for each augmented size.

    balance: the first step fills up the class with fewer rows, the rest is halved. If the first step is too small for that,
    it is an error, or, not strict, the set is left out. Otherwise the set's own ratio is kept, rounded half to even."""
    steps = [(i, s, s - (sizes[i - 1] if i else 0)) for i, s in enumerate(sizes)]
    each = sets.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("size"), F.lit(d).alias("d")) for i, s, d in steps])))
    each = each.select("set", "n_pos", "n_neg", "_s.i", "_s.size", "_s.d")
    up = Window.partitionBy("set").orderBy("i")  # a row for each size
    gap = F.col("n_neg") - F.col("n_pos")
    if balance:
        short = F.abs(gap) > steps[0][2]
        if strict:
            each = each.withColumn("d", F.when(short, F.raise_error(F.lit("the first size does not suffice to balance a set")).cast("int")).otherwise(F.col("d")))
        else:
            each = each.where(~short)
        half = F.floor((F.col("d") - F.when(F.col("i") == 0, F.abs(gap)).otherwise(0)) / 2)
        pos, neg = F.sum(half).over(up) + F.greatest(gap, F.lit(0)), F.sum(half).over(up) + F.greatest(-gap, F.lit(0))
    else:
        add = F.bround(F.col("d") * F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).cast("long")
        pos, neg = F.sum(add).over(up), F.sum(F.col("d") - add).over(up)
    return each.select("set", "size", pos.cast("long").alias("num_pos"), neg.cast("long").alias("num_neg"))


def crossed(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """(base, augment, part, id) of rows(id, topic): for each base topic its own rows alone (augment null), and with those of
    each other topic. Every row comes once for each topic of topics(topic), a small table, so rows stay where they are."""
    other = topics.select(F.col("topic").alias("_t")).distinct()
    alone = rows.select(F.col("topic").alias("base"), F.lit(None).cast("string").alias("augment"), F.lit("base").alias("part"), "id")
    pairs = rows.crossJoin(F.broadcast(other)).where("topic <> _t")
    as_base = pairs.select(F.col("topic").alias("base"), F.col("_t").alias("augment"), F.lit("base").alias("part"), "id")
    as_augment = pairs.select(F.col("_t").alias("base"), F.col("topic").alias("augment"), F.lit("augment").alias("part"), "id")
    return alone.unionByName(as_base).unionByName(as_augment)


def tasks(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with already_exists: whether existing has a row of the same columns, nulls being equal."""
    names = wanted.columns
    known = existing.select(*names).distinct().withColumn("_there", F.lit(True)).withColumnsRenamed({c: f"_{c}" for c in names})
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return wanted.join(known, on, "left").select(*names, F.coalesce("_there", F.lit(False)).alias("already_exists"))


def back_translations(rows: DataFrame, factors: list[int], chained: bool) -> DataFrame:
    """(id, step, source_step, factor): each row of rows(id) translated back max(factors) times, from step 0, the original, or
    chained from the step before; a data set of factor f has the first f steps."""
    each = rows.select("id", F.explode(F.sequence(F.lit(1), F.lit(max(factors)))).alias("step"))
    source = F.col("step") - 1 if chained else F.lit(0)
    return each.withColumn("source_step", source).withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).where("step <= factor")


def cycled(tasks_: DataFrame, items: DataFrame, item: str, number: str, seed: int = 42) -> DataFrame:
    """tasks_ with an item each: task number k gets place k mod n of round k div n, every round a new random order of items."""
    n = items.agg(F.count("*").alias("_n"))
    rounds = tasks_.crossJoin(F.broadcast(n)).withColumns({"_round": F.floor(F.col(number) / F.col("_n")), "_at": F.col(number) % F.col("_n")})  # one row
    order = rounds.select("_round").distinct().crossJoin(F.broadcast(items.select(item)))  # a few items for each round
    w = Window.partitionBy("_round").orderBy(drawn_key(seed, F.col("_round").cast("string"), item), item)
    order = order.withColumn("_at", F.row_number().over(w).cast("long") - 1)
    return rounds.withColumn("_at", F.col("_at").cast("long")).join(order, ["_round", "_at"]).drop("_round", "_at", "_n")


def partition_genes(rows: DataFrame, genes: DataFrame, seed: int = 42) -> DataFrame:
    """(id, first, second, rest) of rows(id): genes(gene), a small table, in a random order for each row: two to inherit from the
    first parent, two from the second, the rest to change."""
    keyed = rows.select("id").crossJoin(F.broadcast(genes.select("gene"))).withColumn("_h", drawn_key(seed, F.col("id").cast("string"), "gene"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("_h", "gene"))), lambda x: x["gene"])
    by = keyed.groupBy("id").agg(order.alias("g"))
    return by.select("id", F.slice("g", 1, 2).alias("first"), F.slice("g", 3, 2).alias("second"), F.slice("g", F.lit(5), F.greatest(F.size("g") - 4, F.lit(0))).alias("rest"))


def drawn_properties(rows: DataFrame, properties: DataFrame, k: int, always: str, never: list[str], seed: int = 42) -> DataFrame:
    """(id, category, feature) of rows(id): for each row a feature of the category ``always`` and of k others, never of those
    in never. properties(category, feature) is a small table."""
    sizes = properties.distinct().groupBy("category").agg(F.array_sort(F.collect_list("feature")).alias("_f"))
    each = rows.select("id").crossJoin(F.broadcast(sizes.where(~F.col("category").isin(*never)))).withColumn("_c", F.concat_ws(":", F.col("id").cast("string"), "category"))
    first = Window.partitionBy("id").orderBy((F.col("category") == always).desc(), drawn_key(seed, "_c"), "category")
    have = each.where(F.col("category") == always).select("id")
    chosen = each.withColumn("_n", F.row_number().over(first)).join(have, "id", "left_semi").where(F.col("_n") <= k + 1)
    at = F.floor(fraction(seed + 1, "_c") * F.size("_f")).cast("int")
    return chosen.select("id", "category", F.element_at("_f", at + 1).alias("feature"))


def select_rows(df: DataFrame, mode: str, metric: str, count: int, row_id: str, label: str | None = None) -> DataFrame:
    """The count rows of the greatest (mode 'top') or smallest ('bottom') metric, ties to the smaller id; with a label, half
    as many of each of its values. Null metrics and, with a label, null labels are left out."""
    if mode not in ("top", "bottom"):
        raise ValueError(f"unknown mode {mode}")
    order = [F.desc(metric) if mode == "top" else F.asc(metric), F.col(row_id)]
    known = df.where(F.col(metric).isNotNull())
    if label is None:
        return known.orderBy(*order).limit(count)
    w = Window.partitionBy(label).orderBy(*order)
    return known.where(F.col(label).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count // 2).drop("_n")


def midpoint(pairs: DataFrame) -> DataFrame:
    """A stand-in for the generator: (class_label, v) of pairs(class_label, a, b, va, vb), the unit vector between the parents."""
    mean = F.zip_with("va", "vb", lambda x, y: (x + y) / 2)
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return pairs.select("class_label", mean.alias("m")).select("class_label", F.transform("m", lambda x: x / norm).alias("v"))


def breed(pool: DataFrame, rounds: int, most_uses: int = 2, make: Callable[[DataFrame], DataFrame] = midpoint) -> tuple[DataFrame, DataFrame]:
    """(pool, parents) after some rounds over pool(class_label, id, v): in each, the most distant pair of each class among those used
    less than most_uses times become parents, and what make gives for them joins the pool.

    pool: (class_label, id, v, selected_count, iteration_count); a new id is the greatest id so far and the next numbers, by
    class. iteration_count is for how many rounds the row could be chosen. parents: (iteration, class_label, id, a, b).
    A class with fewer than two rows left is an error. Each round is a Spark job over the whole pool, which is cut."""
    from textloom.operators.similarity import farthest_pair
    from textloom.plans.lineage import cut

    spark = pool.sparkSession
    now = cut(pool.select("class_label", "id", "v", F.lit(0).alias("selected_count"), F.lit(0).alias("entered")))
    classes = sorted(r[0] for r in now.select("class_label").where("class_label IS NOT NULL").distinct().collect())  # a few classes
    log = []
    for k in range(1, rounds + 1):
        free = now.where(F.col("selected_count") < most_uses).select("class_label", "id", "v")
        found = {r["class_label"]: (r["a"], r["b"]) for r in farthest_pair(free, ["class_label"]).collect()}  # one pair a class
        if set(found) != set(classes):
            raise ValueError(f"round {k}: no two rows are left of {sorted(set(classes) - set(found))}")
        top = now.agg(F.max("id")).first()[0]
        rows = [(k, c, top + i, *found[c]) for i, c in enumerate(classes, 1)]
        log += rows
        born = spark.createDataFrame(rows, "iteration int, class_label string, id long, a long, b long")
        va, vb = now.select(F.col("id").alias("a"), F.col("v").alias("va")), now.select(F.col("id").alias("b"), F.col("v").alias("vb"))
        made = make(va.join(F.broadcast(born), "a").join(vb, "b").select("class_label", "a", "b", "va", "vb"))
        made = made.join(F.broadcast(born.select("class_label", "id")), "class_label").select("class_label", "id", "v", F.lit(0).alias("selected_count"), F.lit(k).alias("entered"))
        used = born.select(F.explode(F.array("a", "b")).alias("id")).withColumn("_u", F.lit(1))
        now = now.join(F.broadcast(used), "id", "left").withColumn("selected_count", F.col("selected_count") + F.coalesce("_u", F.lit(0))).drop("_u")
        now = cut(now.unionByName(made))
    out = now.select("class_label", "id", "v", "selected_count", (F.lit(rounds) - F.col("entered")).alias("iteration_count"))
    return out, spark.createDataFrame(log, "iteration int, class_label string, id long, a long, b long")
