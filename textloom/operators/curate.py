"""Curating labelled texts: deduplication, set differences, overlaps, comparison, schema mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; null keys are equal to each other. An empty df stays empty."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_dedup(dfs: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """All rows by column name, missing columns null, then the first of each key; earlier tables win."""
    numbered = [d.withColumn("_src", F.lit(i)) for i, d in enumerate(dfs)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return dedup_first(whole, keys, ["_src", *order]).drop("_src")


def difference(left: DataFrame, rights: list[DataFrame], key: str, null_matches: bool = True) -> DataFrame:
    """Rows of left whose key is in none of rights. Where null_matches, a null key is equal to a null key; otherwise
    rows with a null key always stay. Several right tables cost one anti join against their union."""
    keys = reduce(DataFrame.unionByName, [r.select(F.col(key).alias("_k")) for r in rights]).distinct()
    on = F.col(key).eqNullSafe(F.col("_k")) if null_matches else F.col(key) == F.col("_k")
    return left.join(keys, on, "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key is also in right; null keys never match."""
    return left.join(right.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def exclusive(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of only one of the two tables."""
    left = difference(a, [b], key).select(key, F.lit("a").alias("side"))
    return left.unionByName(difference(b, [a], key).select(key, F.lit("b").alias("side"))).distinct()


def in_at_least(dfs: list[DataFrame], key: str, least: int) -> DataFrame:
    """(key, n): keys that are in at least ``least`` of the tables."""
    each = reduce(DataFrame.unionByName, [d.select(key).distinct() for d in dfs])
    return each.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def compare_in_order(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, different) for each key of both; a null differs from everything, a null included."""
    same = reduce(lambda x, y: x & y, [F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False)) for c in columns])
    return a.alias("a").join(b.alias("b"), key).select(key, (~same).alias("different"))


def replace_columns(df: DataFrame, names: list[str], value: str = "-") -> DataFrame:
    """Columns of a constant, moved to the end where they were there before."""
    return df.drop(*names).withColumns({n: F.lit(value) for n in names})


def matches_none(text: Column, words: list[str]) -> Column:
    """Whether none of the words occurs in any letter case; a null text has none."""
    return ~F.coalesce(text.rlike("(?i)" + "|".join(words)), F.lit(False))


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """(label, label_id): the distinct labels in order, numbered from 0; null labels have no number.

    The labels are first made distinct, so the window that numbers them holds as many rows as there are labels."""
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
    return distinct.withColumn("label_id", F.row_number().over(Window.orderBy(label)) - 1)


def label_ids_with_unseen(train: DataFrame, other: DataFrame, label: str) -> DataFrame:
    """(label, label_id): the labels of train in order, then those that only other has, numbered on; -1 is for no label."""
    known = train.select(label, F.lit(0).alias("_o")).where(F.col(label).isNotNull()).distinct()
    more = other.select(label, F.lit(1).alias("_o")).where(F.col(label).isNotNull()).distinct().join(known.select(label), label, "left_anti")
    whole = known.unionByName(more)  # one row for each label
    return whole.select(label, (F.row_number().over(Window.orderBy("_o", label)) - 1).alias("label_id"))


def encoded(label: Column, ids: DataFrame, df: DataFrame, name: str = "label_id") -> DataFrame:
    """df with the number of its label; a label that is '-1' stays -1, and one without a number is null."""
    key = ids.columns[0]
    joined = df.withColumn("_l", label).join(F.broadcast(ids.select(F.col(key).alias("_l"), F.col("label_id").alias("_id"))), "_l", "left")  # labels are few
    return joined.withColumn(name, F.when(F.col("_l") == "-1", F.lit(-1)).otherwise(F.col("_id"))).drop("_l", "_id")


def one_hot(label_id: Column, n: Column) -> Column:
    """An array of n numbers, 1 at the label's place."""
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: (i == label_id).cast("int"))


def whole_number(text: Column) -> Column:
    """A text as a whole number; anything else is an error, a null text stays null."""
    ok = text.isNull() | text.rlike(r"^\s*[+-]?\d+\s*$")
    return F.when(ok, F.trim(text).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no whole number: "), text)).cast("bigint"))


def label_words(label: Column) -> Column:
    """1 and 0 as Yes and No; other labels stay, trimmed."""
    bare = F.trim(label)
    return F.when(bare == "1", "Yes").when(bare == "0", "No").otherwise(bare)


def attach(df: DataFrame, values: DataFrame, key: str, defaults: dict[str, int]) -> DataFrame:
    """df with the columns of values, one row for each key, joined by the key; where it has none, the defaults."""
    return df.join(values, key, "left").fillna(defaults)


def row_at(df: DataFrame, order: list[str], position: int) -> DataFrame:
    """The row at a position from 0 in an order; an IndexError beyond the last row. Only position + 1 rows are sorted out."""
    first = df.orderBy(*order).limit(max(0, position + 1))
    if position < 0 or first.count() <= position:
        raise IndexError(f"no row {position}")
    return first.orderBy(*[F.desc(c) for c in order]).limit(1)


def preferred(df: DataFrame, groups: list[str], best: Column, value: str) -> DataFrame:
    """(groups, value): of each group the greatest value among its best rows, or else among all."""
    return df.groupBy(*groups).agg(F.coalesce(F.max(F.when(best, F.col(value))), F.max(value)).alias(value))
