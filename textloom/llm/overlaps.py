"""Problem 5: records of evaluation splits that are also, exactly or almost, in the training split."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.wordsets import COUNTS, Near, Sets, meeting, alike, cell_counts, divided, mixed, pieces, verify
from textloom.plans.lineage import cut, spread, table

SHARE = 0.7
#: Words of the shortest shared span of texts whose union has LONG different words or more; below, the run that edits
#: must leave (shared_run) is enough.
LEAST, LONG = 4, 32
#: Words after the shortest span by which suffixes are sorted further and their common prefix is measured. A longer
#: span is found in pieces that overlap, and merged.
BEYOND = 4

SUFFIX = "cell long, rid long, at int, before int, least byte, size int, flags byte, t0 long, t1 long, s0 long, s1 long, s2 long, s3 long"
SPANS = "left long, right long, left_at int, right_at int, n_words int"


def shared_run(union: int, t: float) -> int:
    """Words in a row that two texts in one order with this union and a word share of t or more have in common, at least.

    o words are shared and d are not; d words cut the shared ones into d + 1 runs.
    """
    o = math.ceil(t * union - 1e-9)
    return math.ceil(o / (union - o + 1))


def least_span(union: int, t: float) -> int:
    """The shortest span by which two texts with this union are found."""
    return LEAST if union >= LONG else min(LEAST, shared_run(union, t))


def spans_of(size: int, t: float) -> list[int]:
    """The shortest spans by which the partners of a text of this many different words are found."""
    return sorted({least_span(u, t) for u in range(size, int(size / t + 1e-9) + 1)})


class Concatenated:
    """The word sequences of a piece of a batch, one after another, with an end after each."""

    def __init__(self, w: pa.ListArray):
        self.sizes = w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = w.flatten().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def suffixes(self, kinds: np.ndarray, t: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(least, place, cell): the suffixes that are at least ``least`` words long, and the hash of so many words."""
        at = np.arange(len(self.words))
        left = self.sizes[self.row] - (at - self.starts[self.row])  # words to the end of the text
        for rows in alike(np.arange(len(self.sizes)), kinds):
            wanted = np.zeros(len(self.sizes), bool)
            wanted[rows] = True
            for k in spans_of(int(kinds[rows[0]]), t):
                place = at[wanted[self.row] & (left >= k)]
                cell = self.words[place]
                for i in range(1, k):
                    cell = mixed(cell, self.words[place + i])
                yield k, place, mixed(cell, np.full(len(place), k))

    def after(self, place: np.ndarray, k: int) -> np.ndarray:
        """(places, BEYOND): 32 bits of each word after the first k, 0 past the end."""
        where = place[:, None] + k + np.arange(BEYOND)
        end = (self.starts + self.sizes)[self.row[place]][:, None]
        found = self.words[np.minimum(where, len(self.words) - 1)].astype(np.int32) | 1
        return np.where(where < end, found, 0).astype(np.int32)


def _suffixes(t: float, count: bool = False):
    """The suffixes of the texts with what their order and their comparison take; with count, only the number of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, sets = Concatenated(batch.column("w")), Sets(batch.column("h"))
            ids, flags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rec", "flags"))
            sketch = None if count else sets.sketches()
            for k, place, cell in texts.suffixes(sets.sizes, t):
                if count:
                    yield cell_counts(cell)
                    continue
                row = texts.row[place]
                first = place == texts.starts[row]
                before = np.where(first, 0, texts.words[np.maximum(place - 1, 0)].astype(np.int32) | 1).astype(np.int32)
                tail = np.ascontiguousarray(texts.after(place, k)).view(np.int64)
                columns = [cell, ids[row], (place - texts.starts[row]).astype(np.int32), before, np.full(len(place), k, np.int8), sets.sizes[row].astype(np.int32), flags[row].astype(np.int8),
                           np.ascontiguousarray(tail[:, 0]), np.ascontiguousarray(tail[:, 1]), *(sketch[row, i] for i in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in SUFFIX.split(", ")])

    return run


TRAIN, OTHER = 1, 2


def _common(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The words that suffixes of one cell have in common, measured up to BEYOND after the first."""
    tail = np.stack([x["t0"], x["t1"]], axis=1)
    ta, tb = (np.ascontiguousarray(tail[i]).view(np.int32) for i in (a, b))
    return (x["least"][a] + np.logical_and.accumulate((ta == tb) & (ta != 0), axis=1).sum(axis=1)).astype(np.int32)


def _shared(x: dict[str, np.ndarray], near: Near) -> Iterator[pa.RecordBatch]:
    """Spans of whole cells of the sorted suffix array.

    Suffixes of both sides that stand in one cell share its words; of those whose texts may be near, the common prefix
    is measured. Of a span that goes on to the left only every BEYOND-th place is given, as those overlap."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(x["cell"])) + 1])
    lens = np.diff(np.append(starts, len(x["cell"])))
    both = np.bitwise_or.reduceat(x["flags"], starts) == TRAIN | OTHER
    for a, b in meeting(x, starts[both], lens[both], near):
        fa, fb = x["flags"][a], x["flags"][b]
        use = (x["mark"][a] & 2 > 0) | (x["mark"][a] >> 2 != x["mark"][b] >> 2)  # two blocks: only across them
        use &= ((fa & (fb >> 1)) | (fb & (fa >> 1))) & TRAIN > 0
        use &= (x["before"][a] != x["before"][b]) | (x["before"][a] == 0) | (x["at"][a] % BEYOND == 0) | (x["at"][b] % BEYOND == 0)
        a, b = a[use], b[use]
        if not len(a):
            continue
        n = _common(x, a, b)
        for i, j in ((a, b), (b, a)):
            one = (x["flags"][i] & TRAIN > 0) & (x["flags"][j] & OTHER > 0)
            columns = [x["rid"][i[one]], x["rid"][j[one]], x["at"][i[one]], x["at"][j[one]], n[one]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in SPANS.split(", ")])


def _spans(t: float):
    """The array of a partition, cell by cell; batches end at the end of a cell."""
    names, near = ["mark", *(c.split()[0] for c in SUFFIX.split(", "))], Near(t, sides=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if not len(x["cell"]):
                continue
            if rest is not None:
                x = {n: np.concatenate([rest[n], v]) for n, v in x.items()}
            new = np.flatnonzero(np.diff(x["cell"]))
            last = int(new[-1]) + 1 if len(new) else 0
            if last:
                yield from _shared({n: v[:last] for n, v in x.items()}, near)
            rest = {n: v[last:].copy() for n, v in x.items()}
        if rest is not None:
            yield from _shared(rest, near)

    return run


def shared_spans(texts: DataFrame, t: float) -> DataFrame:
    """(SPANS): the spans that a training and another text of texts(rec, flags, w, h) share, in pieces that overlap.

    w are the words in the order of the text, h its different words, flags 1 for training, 2 for other, 3 for both. The
    texts of a partition are concatenated; their suffixes are partitioned by their first words and sorted, which makes
    each partition a part of the suffix array; where suffixes of both sides stand together, their common prefix is measured
    and the span is given, unless the sketches of the two texts show that their word share is below t. No other pair is
    left out.
    """
    rows, counts = texts.mapInArrow(_suffixes(t), SUFFIX), texts.mapInArrow(_suffixes(t, count=True), COUNTS)
    return divided(rows, counts, sides=False).sortWithinPartitions("cell", "t0", "t1").mapInArrow(_spans(t), SPANS)


def merged(spans: Column) -> Column:
    """Words that an array of (start, words) covers, overlaps counted once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"))

    def add(x, y):
        end = y["at"] + y["n"]
        return F.struct(F.greatest(x["end"], end).alias("end"), (x["covered"] + F.greatest(F.lit(0), end - F.greatest(x["end"], y["at"]))).alias("covered"))

    return F.aggregate(F.array_sort(spans), start, add, lambda x: x["covered"])


def split_overlaps(df: DataFrame, t: float = SHARE, train: str = "train") -> DataFrame:
    """(train_id, other_id, share, coverage) of df(id, split, text): the pairs across the training split that share a span
    of least_span words and have a word share of t or more.

    Spans come from a suffix array over the texts in the order of their words (shared_spans). The spans of a pair are
    merged to the coverage of the evaluation record, the share of its words that the training record has in spans; the
    word share of the pairs left is then counted over the whole texts. Where the shared words of two texts stand in one
    order, a share of t leaves a run of shared_run words at least; for unions below LONG words that run is looked for.
    Texts whose words are so edited or reordered that no LEAST shared words follow each other are not found: they have
    no span in common, and spans are what is looked for.

    Copies are compared once and expanded at the end. A null split is not training and not evaluation, so its rows are
    left out, as are texts that are null or have no word; rows delivered twice count once; an empty df gives no rows.
    """
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    known = spread(df.where("id IS NOT NULL AND text IS NOT NULL AND split IS NOT NULL").select("id", (F.col("split") == train).alias("is_train"), "text"))
    hashed = known.select("id", "is_train", F.transform(word, lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)
    hashed = hashed.withColumn("k", F.md5(F.concat_ws(",", F.col("w").cast("array<string>"))))
    flag = F.when(F.col("is_train"), TRAIN).otherwise(OTHER)
    firsts = hashed.groupBy("k").agg(F.min("id").alias("rec"), F.bit_or(flag).cast("byte").alias("flags"), F.first("w").alias("w"))
    # one id may carry several texts; the number tells them apart
    texts = cut(firsts.select("k", F.xxhash64("k").alias("rec"), "flags", "w", F.array_sort(F.array_distinct("w")).alias("h")))
    members = cut(hashed.select("id", "is_train", F.xxhash64("k").alias("rec")).distinct())
    spans = shared_spans(texts.drop("k"), t)
    pairs = spans.groupBy("left", "right").agg(F.collect_set(F.struct(F.col("right_at").alias("at"), F.col("n_words").alias("n"))).alias("spans"))
    pairs = pairs.select("left", "right", merged(F.col("spans")).alias("covered"))
    links = verify(pairs, texts.select("rec", "h"), t, "covered")
    lengths = texts.select(F.col("rec").alias("right"), F.size("w").alias("n"))
    links = links.join(lengths, "right").select("left", "right", "share", (F.col("covered") / F.col("n")).alias("coverage"))
    one = F.lit(1.0)
    same = texts.where(F.col("flags") == TRAIN | OTHER).select(F.col("rec").alias("left"), F.col("rec").alias("right"), one.alias("share"), one.alias("coverage"))
    trained = members.where("is_train").select(F.col("rec").alias("left"), F.col("id").alias("train_id"))
    others = members.where("NOT is_train").select(F.col("rec").alias("right"), F.col("id").alias("other_id"))
    return links.unionByName(same).join(trained, "left").join(others, "right").select("train_id", "other_id", "share", "coverage").distinct()


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claim_split")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlaps(_splits(spark, sf_dir).select(F.col("Sentence_id").alias("id"), "split", F.col("Text").alias("text")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): ids of claim_split, one in train and one in another split, that are the same or nearly the same."""
    found = _found(spark, sf_dir).where("train_id != other_id")
    return found.select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, source, n_rows, n_hit, pct_hit): of each split and source other than train, the ids met in train."""
    rows = _splits(spark, sf_dir).select(F.col("Sentence_id").alias("other_id"), "split", "source").where("split != 'train'").distinct()
    hit = _found(spark, sf_dir).select("other_id").distinct().withColumn("hit", F.lit(1))
    by = rows.join(hit, "other_id", "left").groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_hit"))
    return by.withColumn("pct_hit", F.round(F.col("n_hit") * 100 / F.col("n_rows"), 4))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(other_id, train_id, coverage): for each evaluation record that is met, the training record that covers most of it
    with shared spans (ties to the smaller id)."""
    best = F.max_by(F.struct("train_id", "coverage"), F.struct(F.round("coverage", 9), -F.col("train_id")))
    return _found(spark, sf_dir).groupBy("other_id").agg(best.alias("b")).select("other_id", "b.train_id", F.round("b.coverage", 6).alias("coverage"))


#: All pairs across the splits by their common words, for small tables.
ORACLES = {
    "p5_found": r"""
WITH t AS (SELECT DISTINCT Sentence_id AS id, split = 'train' AS train, Text FROM claim_split WHERE split IS NOT NULL AND Text IS NOT NULL),
w AS (SELECT DISTINCT id, train, unnest(list_distinct(regexp_extract_all(lower(Text), '[\p{L}\p{N}]+'))) AS w FROM t),
n AS (SELECT id, count(*) AS n FROM w GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM w a JOIN w b ON a.w = b.w AND a.train AND NOT b.train AND a.id <> b.id GROUP BY 1, 2)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE shared >= 0.7 * (x.n + y.n - shared)""",
}
