"""Sampling, splitting and balancing by hash order.

A seeded generator can't be repeated by a distributed engine, so every draw orders rows by the md5 of seed and id: the
sizes and strata are those of a random draw, and the same rows come out for the same seed, wherever it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, row_id: str) -> Column:
    """A reproducible random key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


#: Hexadecimal digits of the hash by which a group is divided to be ordered.
DIGITS = 3


def ranked(df: DataFrame, groups: list[str], row_id: str, seed: int = 42) -> DataFrame:
    """df with rn, the place of each row in the random order of its group (1 is the first), where only the first rows of each
    group are kept afterwards: Spark cuts the others off before the shuffle. Else see placed."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*groups).orderBy(hash_order(seed, row_id), row_id)))


def fraction(seed: int, row_id: str) -> Column:
    """A reproducible random number of a row, from 0 to less than 1, in steps of 2 to the minus 52."""
    return F.conv(F.substring(hash_order(seed, row_id), 1, 13), 16, 10).cast("double") / float(1 << 52)


def categorical_draws(weights: DataFrame, item: str, weight: str, draws: int, seed: int = 42) -> DataFrame:
    """(draw, item): draws with replacement, each item by its share of the weight. weights has one row for each item; the
    cumulative shares are compared with a random number. Items without a positive weight are never drawn."""
    known = weights.where(F.col(weight) > 0)
    whole, up = Window.partitionBy(), Window.orderBy(item)
    ends = known.select(item, (F.sum(weight).over(up) / F.sum(weight).over(whole)).alias("_to"), ((F.sum(weight).over(up) - F.col(weight)) / F.sum(weight).over(whole)).alias("_from"))
    d = weights.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("_u", fraction(seed, "draw"))
    return d.join(ends, (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).select("draw", item)


def drop_random(df: DataFrame, label: str, value: str, n: Column, row_id: str, seed: int = 42) -> DataFrame:
    """df without n rows of one label, the first in random order; n may refer to in_group, the rows of the label."""
    return placed(df, [label], row_id, seed).where(~F.col(label).eqNullSafe(F.lit(value)) | (F.col("rn") > n)).drop("rn", "in_group")


def to_every(rows: DataFrame, sets: DataFrame, extra: DataFrame) -> DataFrame:
    """rows with the same extra rows added to each of sets(its columns are those that tell sets apart)."""
    return rows.unionByName(sets.crossJoin(extra).select(*rows.columns))


def placed(df: DataFrame, groups: list[str], row_id: str, seed: int = 42, key: Column | None = None) -> DataFrame:
    """df with rn, the place of each row in the random order of its group, and in_group, the rows of the group.

    The place is a row's place within its hash prefix plus the rows of all prefixes before, so that no task orders a whole
    group, however large. key: another random key than the hash of seed and id."""
    keyed = df.withColumn("_h", hash_order(seed, row_id) if key is None else key).withColumn("_p", F.substring("_h", 1, DIGITS))
    sizes = keyed.groupBy(*groups, "_p").agg(F.count("*").alias("_n"))  # 4,096 rows for a group at most
    own = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "in_group": F.sum("_n").over(own)}).drop("_n").withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)}).withColumnRenamed("_p", "_q")
    on = F.col("_p") == F.col("_q")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    place = F.row_number().over(Window.partitionBy(*groups, "_p").orderBy("_h", row_id))
    whole = keyed.withColumn("_place", place).join(sizes, on).withColumn("rn", F.col("_place") + F.col("_before"))
    return whole.drop("_h", "_p", "_q", "_place", "_before", *[f"_g{i}" for i in range(len(groups))])


def ranked_whole(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """df with rn over all rows, no task ordering the whole table."""
    return placed(df.withColumn("_all", F.lit(0)), ["_all"], row_id, seed).drop("_all", "in_group")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with n, the place of each row by the order columns from 1, which should tell rows apart. Rows are ranged over the
    tasks by the first of them; a row's place is that in its range plus the rows of the ranges before."""
    from textloom.plans.lineage import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each task
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("n", place).join(F.broadcast(before), "_part").withColumn("n", F.col("n") + F.col("_before")).drop("_part", "_before")


def stratified(df: DataFrame, label: str, sizes: dict[str, int], row_id: str, seed: int = 42) -> DataFrame:
    """At most the given number of rows of each label; labels without a size give none."""
    most = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return ranked(df.where(F.col(label).isin(*sizes)), [label], row_id, seed).where(F.col("rn") <= most[F.col(label)]).drop("rn")


def ratio_split(df: DataFrame, a: int, b: int, row_id: str, seed: int = 42) -> DataFrame:
    """df with part 'train' for the first n * a / (a + b) rows, truncated, and 'test' for the others."""
    total = df.agg(F.count("*").alias("_total"))
    whole = ranked_whole(df, row_id, seed).join(F.broadcast(total))
    return whole.withColumn("part", F.when(F.col("rn") <= F.floor(F.col("_total") * a / (a + b)), "train").otherwise("test")).drop("rn", "_total")


def group_split(df: DataFrame, groups: list[str], fractions: list[tuple[str, float]], rest: str, row_id: str, seed: int = 42) -> DataFrame:
    """df with part: of each group the floors of the fractions in turn, the remainder is ``rest``."""
    out, at = F.lit(rest), F.lit(0)
    bounds = []
    for name, share in fractions:
        at = at + F.floor(F.col("in_group") * share)
        bounds.append((name, at))
    for name, bound in reversed(bounds):
        out = F.when(F.col("rn") <= bound, name).otherwise(out)
    return placed(df, groups, row_id, seed).withColumn("part", out).drop("rn", "in_group")


def disjoint_subsets(df: DataFrame, label: str, k: int, size: int, row_id: str, seed: int = 42) -> DataFrame:
    """df with subset 0 to k - 1, each with size rows of every label where there are enough, and -1 for the remainder."""
    at = F.floor((F.col("rn") - 1) / size)
    return placed(df, [label], row_id, seed).withColumn("subset", F.when(at < k, at).otherwise(F.lit(-1)).cast("int")).drop("rn", "in_group")


def halvings(df: DataFrame, most: int, least: int, row_id: str, seed: int = 42) -> DataFrame:
    """(size, rows): the nested prefixes of most, most / 2, ... rows, no smaller than least."""
    sizes = []
    while most >= max(1, least):
        sizes.append(most)
        most //= 2
    first = ranked_whole(df, row_id, seed).where(F.col("rn") <= (sizes[0] if sizes else 0))
    return first.withColumn("size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"))).where("rn <= size").drop("rn")


def balanced_prefixes(df: DataFrame, label: str, labels: tuple[str, str], sizes: list[int], row_id: str, seed: int = 42) -> DataFrame:
    """(size, rows): for each size half of it from either label, filled from the other where one runs short."""
    base = placed(df.where(F.col(label).isin(*labels)), [label], row_id, seed).drop("in_group")
    have = df.agg(*[F.count_if(F.col(label) == x).alias(f"_{i}") for i, x in enumerate(labels)])
    whole = base.join(F.broadcast(have)).withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    half = F.floor(F.col("size") / 2)
    own = F.when(F.col(label) == labels[0], F.col("_0")).otherwise(F.col("_1"))
    other = F.when(F.col(label) == labels[0], F.col("_1")).otherwise(F.col("_0"))
    quota = F.least(own, half + F.greatest(half - other, F.lit(0)))
    return whole.where(F.col("rn") <= quota).drop("rn", "_0", "_1")


def equalised(df: DataFrame, group: str, label: str, row_id: str, seed: int = 42) -> DataFrame:
    """Of every group as many rows of each label as the smallest group has of it."""
    sizes = df.groupBy(group, label).agg(F.count("*").alias("_n")).groupBy(label).agg(F.min("_n").alias("_least"))
    return placed(df, [group, label], row_id, seed).join(F.broadcast(sizes), label).where("rn <= _least").drop("rn", "in_group", "_least")  # one size for each label


def mix_grid(df: DataFrame, is_real: Column, total: int, steps: int, row_id: str, seed: int = 42) -> DataFrame:
    """(step, rows): for step 0 to steps, total * (steps - step) / steps real rows and the rest synthetic."""
    base = ranked(df.withColumn("_real", is_real), ["_real"], row_id, seed).where(F.col("rn") <= total)
    real = F.floor(F.lit(total) * (steps - F.col("step")) / steps)
    return base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).where(F.when(F.col("_real"), F.col("rn") <= real).otherwise(F.col("rn") <= total - real)).drop("rn", "_real")


def resampled(df: DataFrame, run: list[str], label: str, rate: float | list[float], row_id: str, seed: int | list[int] = 42) -> DataFrame:
    """Runs resampled to a share of positives: all positives and round(pos * (1 - rate) / rate) negatives, at least one.

    Where there are too few negatives, they are repeated in turn; runs without a positive stay as they are. The rounding
    is half to even. Several rates (column rate) share one ordering of the rows; several seeds (column draw) are that many
    independent draws."""
    sizes = df.groupBy(*run).agg(F.sum(label).alias("_pos"), F.sum(1 - F.col(label)).alias("_neg"))
    if isinstance(seed, list):
        each = df.withColumn("draw", F.explode(F.array(*map(F.lit, seed))))
        key = F.md5(F.concat(F.col("draw").cast("string"), F.lit(":"), F.col(row_id).cast("string")))
        base = placed(each, [*run, "draw", label], row_id, key=key).drop("in_group").join(sizes, run)
    else:
        base = placed(df, [*run, label], row_id, seed).drop("in_group").join(sizes, run)
    if isinstance(rate, list):
        base, share = base.withColumn("rate", F.explode(F.array(*map(F.lit, rate)))), F.col("rate")
    else:
        share = F.lit(rate)
    want = F.greatest(F.lit(1), F.bround(F.col("_pos") * (1 - share) / share).cast("int"))
    times = F.when((F.col(label) == 1) | (F.col("_pos") == 0), 1).otherwise(F.floor((want - F.col("rn")) / F.col("_neg")) + 1)
    base = base.withColumn("_times", times.cast("int")).where("_times > 0")
    return base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("rn", "_pos", "_neg", "_times")


def cycles(df: DataFrame, row_id: str, epochs: int, batch: int, groups: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(epoch, batch, rows): every epoch a new random order of each group, cut into batches; no row twice in an epoch."""
    keys = ["epoch", *(groups or [])]
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col(row_id).cast("string")))
    return placed(each, keys, row_id, key=order).withColumn("batch", F.floor((F.col("rn") - 1) / batch).cast("int")).drop("rn", "in_group")


def weighted_draws(df: DataFrame, label: str, row_id: str, draws: int, seed: int = 42) -> DataFrame:
    """(draw, rows): draws with replacement in which every label has the same chance and every row of a label, too."""
    spark = df.sparkSession
    base = placed(df.where(F.col(label).isNotNull()), [label], row_id, seed).drop("in_group")
    sizes = base.groupBy(label).agg(F.count("*").alias("_n"))
    named = sizes.withColumn("_k", F.row_number().over(Window.orderBy(label)) - 1).withColumn("_labels", F.count("*").over(Window.partitionBy()))  # one row for each label
    n = named.agg(F.max("_labels").alias("_all"))
    d = spark.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(n))
    d = d.withColumns({"_k": F.floor(fraction(seed, "draw") * F.col("_all")), "_u": fraction(seed + 1, "draw")})
    d = d.join(F.broadcast(named.select(label, "_k", "_n")), "_k").withColumn("rn", F.floor(F.col("_u") * F.col("_n")) + 1)
    return d.select("draw", label, "rn").join(base, [label, "rn"]).drop("rn")
