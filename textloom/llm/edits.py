"""Problem 6: groups of records that are nearly the same despite small edits, insertions and reordering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.wordsets import COUNTS, ROWS, SKETCH, Near, Sets, by_portions, cell_counts, cell_rows, distinct_pairs, hot_table, hot_words, mixed, near_portions, pieces, verified, word_sets
from textloom.plans.lineage import cut, release, table

SHARE = 0.6
#: Records of a group at most.
GROUP = 16
#: Queries and groups for each set that are opened together, and how many at least.
OPENED, LEAST_OPENED = 3, 500_000

SET = "rec long, lead long, size int, s0 long, s1 long, s2 long, s3 long, h array<long>"
GROUPED = SET.replace("lead", "gid")


def _lead(sets: Sets, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first three uncommon words as one key: sets with the same are mostly alike, so their union stays narrow."""
    w = sets.ordered(hot)[0]
    key = w[sets.starts]
    for k in (1, 2):
        more = sets.sizes > k
        key[more] = mixed(key[more], w[sets.starts[more] + k])
    return key


def _sets(hot: dict[int, int]):
    known = hot_table(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = Sets(batch.column("h"))
            columns = [_lead(sets, known), sets.sizes.astype(np.int32), *sets.sketches().T]
            yield pa.RecordBatch.from_arrays([batch.column("rec"), *(pa.array(np.ascontiguousarray(c)) for c in columns), batch.column("h")], names=["rec", "lead", "size", *SKETCH, "h"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets in the order of their leads: each lead's in groups of GROUP, one after another."""
    for batch in batches:
        if batch.num_rows:
            rec, lead = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rec", "lead"))
            at = np.arange(len(lead))
            begins = np.maximum.accumulate(np.where(np.diff(lead, prepend=lead[0]) != 0, at, 0))
            first = at - (at - begins) % GROUP
            yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array(mixed(lead[first], rec[first])), *batch.columns[2:]], names=["rec", "gid", *batch.schema.names[2:]])


def _matrix(hot: dict[int, int], t: float, part: int = 0, parts: int = 1, count: bool = False):
    """The queries, of side 0, and the groups that the matrix has for them, of side 1, by the tokens that they need.

    A group whose sets stand in two batches is given twice, each time with the tokens of what stands there.
    Only the tokens of one part of parts; with count, only the number of rows of each token."""
    known = hot_table(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, gid = Sets(batch.column("h")), batch.column("gid").to_numpy(zero_copy_only=False)
            rows, cells = sets.prefix_cells(known, t, part, parts)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(gid)) + 1])
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(gid))))[rows]
            order = np.lexsort((cells, group))
            group, needed = group[order], cells[order]
            new = np.ones(len(group), bool)
            new[1:] = (np.diff(group) != 0) | (np.diff(needed) != 0)
            group, needed = group[new], needed[new]
            if count:
                yield cell_counts(np.concatenate([cells, needed]))
                continue
            yield cell_rows(sets, batch.column("rec"), rows, cells)
            size, union = np.minimum.reduceat(sets.sizes, starts).astype(np.int32), np.bitwise_or.reduceat(sets.sketches(), starts, axis=0)
            columns = [needed, np.ones(len(needed), np.int8), gid[starts][group], size[group], *(union[group, k] for k in range(len(SKETCH)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "side", "rid", "size", *SKETCH])

    return run


def token_groups(sets: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(GROUPED) of sets(rec, h): those that begin with the same three uncommon words are a group of at most GROUP members."""
    ordered = sets.mapInArrow(_sets(hot), SET).repartitionByRange("lead", "rec").sortWithinPartitions("lead", "rec")  # a lead of very many sets is no one task's
    return cut(ordered.mapInArrow(_groups, GROUPED))


def near_edits(grouped: DataFrame, hot: dict[int, int], t: float) -> DataFrame:
    """(left, right, share) of token_groups(sets, hot), left < right, through a token-group matrix.

    The matrix says of each
    token which groups' members need it; a group also has the sketch of the union of all its members' tokens. A query
    meets the groups that need one of its tokens, and opens those of which the union leaves room for a share of t. The
    tokens are taken a portion at a time, each made from the sets when it is needed.
    """
    n = grouped.count()
    counts = grouped.mapInArrow(_matrix(hot, t, count=True), COUNTS)
    opened = near_portions(lambda part, parts: grouped.mapInArrow(_matrix(hot, t, part, parts), ROWS), Near(t, sides=True, unions=True), counts, n)
    tell = F.struct("rec", "size", *SKETCH)
    q, m = grouped.select(F.col("rec").alias("left"), tell.alias("q")), grouped.select(F.col("gid").alias("right"), tell.alias("m"))
    differ = sum(F.bit_count(F.col(f"q.{c}").bitwiseXOR(F.col(f"m.{c}"))) for c in SKETCH)

    def members(own: DataFrame) -> DataFrame:
        pairs = own.join(q, "left").join(m, "right").where(F.col("q.rec") < F.col("m.rec"))
        pairs = pairs.where(differ <= (F.col("q.size") + F.col("m.size")) * ((1 - t) / (1 + t)) + 1e-9)
        return pairs.select(F.col("q.rec").alias("left"), F.col("m.rec").alias("right"))

    pairs = by_portions(opened, max(LEAST_OPENED, OPENED * n), members)
    return verified(pairs, grouped.select("rec", "h"), t)


def edit_links(df: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """(members, links) of df(id, text): members (id, rec, string key), links (left, right, share) between different word sets."""
    members, sets = word_sets(df.select("id", "text", F.md5("text").alias("string")), "string")
    hot = hot_words(sets)
    grouped = token_groups(sets, hot)
    del sets  # the groups hold the words
    release(df.sparkSession)
    return members, near_edits(grouped, hot, t)


def edit_groups(df: DataFrame, t: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(members, links) of df(id, text): members (id, rec, grp, string key), links between different word sets.

    grp is the smallest id reached through links and copies. Every row of the same words has the same rec. Texts that
    are null or have no word are in neither; an empty df gives empty results.
    """
    members, links = edit_links(df, t)
    label = components(links.select("left", "right")).withColumnRenamed("node", "rec")
    return members.join(label, "rec", "left").select("id", "rec", F.coalesce("label", "rec").alias("grp"), "string"), links


def near_rows(df: DataFrame, t: float = SHARE) -> DataFrame:
    """(row_a, row_b), row_a < row_b: rows of df(id, text) with a share of t or more whose strings aren't equal."""
    members, links = edit_links(df, t)
    links = links.select("left", "right")
    varied = members.groupBy("rec").agg(F.min("string").alias("x"), F.max("string").alias("y")).where("x != y")
    links = links.unionByName(varied.select(F.col("rec").alias("left"), F.col("rec").alias("right")))
    a = members.select(F.col("rec").alias("left"), F.col("id").alias("a"), F.col("string").alias("sa"))
    b = members.select(F.col("rec").alias("right"), F.col("id").alias("b"), F.col("string").alias("sb"))
    pairs = links.join(a, "left").join(b, "right").where("a != b AND sa != sb AND (left != right OR a < b)")
    return distinct_pairs(pairs.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b")), members)


def _field(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return table(spark, sf_dir, "template_sequence").select(F.col("row_id").alias("id"), F.col(field).alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_a, row_b): pairs of rows of template_sequence nearly the same, but not equal, in Text or example."""
    text, example = (near_rows(_field(spark, sf_dir, f)).select(F.lit(f).alias("field"), "row_a", "row_b") for f in ("Text", "example"))
    return text.unionByName(example)


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, grp): each row of template_sequence that has a word in the field, and its group."""
    out = None
    for f in ("Text", "example"):
        one = edit_groups(_field(spark, sf_dir, f))[0].select(F.lit(f).alias("field"), F.col("id").alias("row_id"), "grp")
        out = one if out is None else out.unionByName(one)
    return out


_PAIRS = r"""
SELECT '{0}' AS field, a AS row_a, b AS row_b FROM (
  WITH w AS (SELECT row_id AS id, unnest(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))) AS w FROM template_sequence),
  n AS (SELECT id, count(*) AS n FROM w GROUP BY 1), p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM w x JOIN w y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2)
  SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b JOIN template_sequence s ON s.row_id = a JOIN template_sequence t ON t.row_id = b WHERE shared >= 0.6 * (x.n + y.n - shared) AND s.{0} <> t.{0})"""

#: All pairs by their common words, for small tables.
ORACLES = {"p6_found": f"{_PAIRS.format('Text')} UNION ALL {_PAIRS.format('example')}"}
