"""Word sets and the cell engine that the three word-share operators are built on.

A text becomes the sorted array of the 64-bit hashes of its distinct words. Texts with the same words are one *set*:
copies are collapsed before anything is compared, so a group of copies that holds a third of all rows costs one row.

``near_pairs`` compares the rows that meet in a cell. A row carries a 256-bit sketch of its set (one bit for each word),
and the bits in which two sketches differ never exceed the words in which the sets differ, so the sketch rejects
pairs without losing one. What is left is checked exactly by ``verify``.

Cells hold many times the bytes of the sets, so ``near_portions`` compares them a portion at a time, each cell in just one
of the portions, and ``verified`` checks the pairs likewise; the files of a portion are deleted before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textloom.plans.lineage import cut, release, spread

#: Rows of one cell that one task compares with each other; fuller cells are compared block by block in many tasks.
BLOCK = 4096
#: A word of more rows than this (and than HOT_SHARE of all) makes no cell alone, only together with a second word.
CELL = 2000
#: At most (mean words of a text / HOT_SHARE) words can be hot, which bounds what is sent to every task.
HOT_SHARE = 1 / 2000
#: Overfull cells that are sent to every task; if there are more, they are joined instead.
LISTED = 20_000
#: Parts in which the rows of a full cell are joined where full cells are too many to be sent.
SALTS = 64
#: Rows that a task compares, about; the number of tasks grows with the rows.
TASK = 500_000

#: Rows in the cells of one portion for each set, about, and how many a portion holds at least.
PORTION, LEAST_PORTION = 8, 1_500_000
#: Pairs for each set that are checked together, and how many at least.
CHECKED, LEAST_CHECKED = 0.5, 100_000

#: Cells of the sets that are put into cells together.
PIECE = 500_000

ROWS = "cell long, side byte, rid long, size int, s0 long, s1 long, s2 long, s3 long"
COUNTS = "cell long, n long"
SKETCH = ("s0", "s1", "s2", "s3")


def word_array(text):
    """Distinct words in lower case: the longest runs of Unicode letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def word_sets(df: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(members, sets) of ``df(id, text, *keep)``.

    members: (id, rec, *keep), one row for each distinct row of df whose text has a word; rec is the smallest id with
    the same words. sets: (rec, h), one row for each distinct word set; h is sorted. Null ids, null texts and texts
    without a word are in neither. Both are written once to the checkpoint folder.
    """
    hashed = spread(df.where("id IS NOT NULL AND text IS NOT NULL")).select(
        "id", *keep, F.array_sort(F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w))).alias("h")
    )
    hashed = hashed.where(F.size("h") > 0).withColumn("k", F.md5(F.concat_ws(",", F.col("h").cast("array<string>"))))
    firsts = hashed.groupBy("k").agg(F.min("id").alias("rec"), F.first("h").alias("h"))
    sets = cut(firsts)
    del firsts
    release(df.sparkSession)
    members = cut(hashed.drop("h").distinct().join(sets.select("k", "rec"), "k").drop("k"))
    release(df.sparkSession)
    return members, sets.drop("k")


def hot_words(sets: DataFrame) -> dict[int, int]:
    """Words of very many sets with their counts; their number is bounded by HOT_SHARE."""
    least = max(CELL, int(sets.count() * HOT_SHARE))
    counted = sets.select(F.explode("h").alias("w")).groupBy("w").count().where(F.col("count") >= least)
    return {r["w"]: r["count"] for r in counted.collect()}


def mixed(a, b):
    """One 64-bit key of two (arrays of) keys; the order counts."""
    a, b = np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15F39CC060))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


class Sets:
    """The word sets of a piece of a batch, one after another in flat arrays, so that numpy works on all of them at once."""

    def __init__(self, h: pa.ListArray):
        self.sizes = h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = h.flatten().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def sketches(self) -> np.ndarray:
        """(sets, 4): one bit of 256 for each word."""
        bits = np.zeros((len(self.sizes), 256), np.uint8)
        bits[self.row, self.words & 255] = 1
        return np.packbits(bits, axis=1).view(np.int64)

    def ordered(self, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each set, sorted before, in the order shared by all sets, uncommon words first, and how many of its words are not hot."""
        words, counts = hot
        n = np.zeros(len(self.words), np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, self.words), len(words) - 1)
            n = np.where(words[at] == self.words, counts[at], 0)
        return self.words[np.argsort(self.row * (n.max(initial=0) + 1) + n, kind="stable")], np.bincount(self.row, n == 0, len(self.sizes)).astype(np.int64)

    def prefix_cells(self, hot: tuple[np.ndarray, np.ndarray], t: float, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells in which a set must meet every set with a word share of at least t.

        Two such sets share at least ceil(t * n) of the n words of either, so their first shared word is among the first
        n - ceil(t * n) + 1 of each and their second among one more. A word that isn't hot is a cell; a hot one is
        divided by the shared word after it. Sets that must share only one word keep the hot word itself as well.
        Only the cells of one part of parts are given; a cell's part follows from its first word.
        """
        w, cold = self.ordered(hot)
        need = np.ceil(t * self.sizes - 1e-9).astype(np.int64)
        last = self.sizes - need + 1
        place = np.arange(len(w)) - self.starts[self.row]
        own = place < last[self.row]
        if parts > 1:
            own &= mixed(w, np.full(len(w), 3)).view(np.uint64) % np.uint64(parts) == part
        is_cold = place < cold[self.row]
        alone, kept = own & is_cold, own & ~is_cold & (need <= 1)[self.row]
        first = np.flatnonzero(own & ~is_cold)
        after = (np.minimum(last + 1, self.sizes)[self.row] - place - 1)[first]
        second = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after - first - 1, after)
        first = np.repeat(first, after)
        rows, cells = [self.row[alone], self.row[kept], self.row[first]], [w[alone], mixed(w[kept], np.full(kept.sum(), 1)), mixed(w[first], w[second])]
        return np.concatenate(rows), np.concatenate(cells)


def _homes(hot: dict[int, int]):
    known = hot_table(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = Sets(batch.column("h"))
            w, cold = sets.ordered(known)
            first, second = w[sets.starts], w[sets.starts + np.minimum(1, sets.sizes - 1)]
            home = np.where(cold > 0, first, mixed(first, second))
            yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array(home)], names=["rec", "home"])

    return run


def homes(sets: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(rec, home): the cell of each set's first word, which isn't hot where the set has another."""
    return sets.mapInArrow(_homes(hot), "rec long, home long")


def hot_table(hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The hot words in order and their counts."""
    words = np.array(sorted(hot), np.int64)
    return words, np.array([hot[w] for w in words.tolist()], np.int64)


def alike(rows: np.ndarray, *by: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in groups of equal values in all of by."""
    if len(rows):
        rows = rows[np.lexsort([x[rows] for x in by])]
        new = np.any([np.diff(x[rows]) != 0 for x in by], axis=0)
        yield from np.split(rows, np.flatnonzero(new) + 1)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose sets have about PIECE cells at most (or one set), as long sets have very many."""
    for batch in batches:
        if batch.num_rows:
            n = batch.column("h").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(n * n) // (4 * PIECE)
            starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                yield batch.slice(a, b - a)


def cell_rows(sets: Sets, rec: pa.Array, rows: np.ndarray, cells: np.ndarray, side: int = 0) -> pa.RecordBatch:
    """A batch of ROWS: each cell with the set that lies in it, set by set, as equal neighbours compress well."""
    order = np.argsort(rows, kind="stable")
    rows, cells = rows[order], cells[order]
    ids, s = rec.to_numpy(zero_copy_only=False), sets.sketches()
    columns = [cells, np.full(len(cells), side, np.int8), ids[rows], sets.sizes.astype(np.int32)[rows], *(s[rows, k] for k in range(len(SKETCH)))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "side", "rid", "size", *SKETCH])


def cell_counts(cells: np.ndarray) -> pa.RecordBatch:
    """A batch of COUNTS: each cell once with its rows."""
    cells, n = np.unique(cells, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["cell", "n"])


class Near:
    """Which of the pairs that meet may be near, judged from sizes and sketches alone; never rejects a near pair."""

    def __init__(self, t: float, sides: bool, unions: bool = False):
        self.t, self.sides, self.unions = t, sides, unions

    def __call__(self, left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> np.ndarray:
        """Both hold arrays of (cells, rows); the result is of (cells, rows of left, rows of right)."""
        t, words = self.t, range(len(SKETCH))
        na, nb = left["size"][:, :, None].astype(np.float32), right["size"][:, None, :].astype(np.float32)
        bits = np.zeros(np.broadcast_shapes(na.shape, nb.shape), np.int16)
        if self.unions:  # left is a query, right a group: the query's words that the group's token union can hold
            for k in words:
                bits += np.bitwise_count(left["s"][k][:, :, None] & right["s"][k][:, None, :])
            own = sum(np.bitwise_count(left["s"][k]).astype(np.int16) for k in words)[:, :, None]
            return bits + (na - own) + 1e-4 >= np.maximum(t * na, (na + nb) * np.float32(t / (1 + t)))
        for k in words:
            bits += np.bitwise_count(left["s"][k][:, :, None] ^ right["s"][k][:, None, :])
        return bits <= (na + nb) * np.float32((1 - t) / (1 + t)) + 1e-4


def _part(x: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {"size": x["size"][at], "s": [x[c].view(np.uint64)[at] for c in SKETCH]}


def meeting(x: dict[str, np.ndarray], starts: np.ndarray, lens: np.ndarray, near: Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): positions of the pairs of rows of one cell that may be near, compared in pieces of bounded size."""
    piece = 500_000
    for m in np.unique(lens[lens > 1]):
        cells = starts[lens == m]
        step = max(1, piece // int(m * m))
        for k in range(0, len(cells), step):
            at = cells[k : k + step, None] + np.arange(m)
            if near.sides and step == 1:
                left, right = at[:, x["mark"][at[0]] & 1 == 0], at[:, x["mark"][at[0]] & 1 == 1]
            else:
                left = right = at
            rows = max(1, piece // max(1, right.size))
            for r in range(0, left.shape[1], rows):
                other = right[:, r:] if right is left and not near.sides else right  # of one table against itself, the upper half
                own = left[:, r : r + rows]
                c, i, j = np.nonzero(near(_part(x, own), _part(x, other)))
                a, b = own[c, i], other[c, j]
                keep = (x["mark"][a] & 1 == 0) & (x["mark"][b] & 1 == 1) if near.sides else (a < b) & (x["rid"][a] != x["rid"][b])
                yield a[keep], b[keep]


def scan(near: Near):
    """Compares the rows of each cell, sorted by cell; output the pairs that may be near.

    mark is 4 * block + 2 * (whether the cell holds one block) + side."""

    def of(x: dict[str, np.ndarray], starts, lens) -> pa.RecordBatch | None:
        found = []
        for a, b in meeting(x, starts, lens, near):
            if not near.sides:
                keep = (x["mark"][a] & 2 > 0) | (x["mark"][a] >> 2 != x["mark"][b] >> 2)  # two blocks: only across them
                a, b = a[keep], b[keep]
            if not near.unions:
                na, nb = x["size"][a].astype(float), x["size"][b].astype(float)
                keep = np.minimum(na, nb) + 1e-9 >= near.t * np.maximum(na, nb)
                a, b = a[keep], b[keep]
            l, r = x["rid"][a], x["rid"][b]
            found.append(np.stack([l, r]) if near.sides else np.stack([np.minimum(l, r), np.maximum(l, r)]))
        if not found:
            return None
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["left", "right"]) if pairs.size else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "mark", "rid", "size", *SKETCH)}
            if not len(x["cell"]):
                continue
            if rest is not None:
                x = {n: np.concatenate([rest[n], v]) for n, v in x.items()}
            starts = np.concatenate([[0], np.flatnonzero(np.diff(x["cell"])) + 1])
            if len(starts) > 1:
                out = of(x, starts[:-1], np.diff(starts))
                if out is not None:
                    yield out
            rest = {n: v[starts[-1] :].copy() for n, v in x.items()}
        if rest is not None:
            out = of(rest, np.array([0]), np.array([len(rest["cell"])]))
            if out is not None:
                yield out

    return run


def full_cells(counts: DataFrame) -> tuple[int, list | DataFrame]:
    """The rows that counts(COUNTS) tells of, and the cells of more than BLOCK rows with the parts that they are divided in.

    counts may hold a cell in parts. Up to LISTED cells are a list, more a DataFrame."""
    seen = Observation()
    counted = counts.observe(seen, F.sum("n").alias("rows")).groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    counted = counted.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    listed = counted.limit(LISTED + 1).collect()
    try:
        n = seen.get["rows"] or 0
    except Py4JError:  # the optimizer saw that there are no rows, so nothing was observed
        n = 0
    return n, listed if len(listed) <= LISTED else counted


def in_blocks(rows: DataFrame, full: list | DataFrame, sides: bool, tasks: int) -> DataFrame:
    """rows with the full cells divided, the column mark of scan(), each cell in one of so many tasks."""
    if isinstance(full, list):
        placed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(full, "cell long, parts int")), "cell", "left")
    else:
        salted = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = rows.withColumn("salt", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(SALTS)).cast("int")).join(salted, ["cell", "salt"], "left").drop("salt")
    placed = placed.withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    if sides:
        b1, b2 = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    else:
        b1, b2 = F.least("own", "other"), F.greatest("own", "other")
    mark = F.col("own") * 4 + (F.col("own") == F.col("other")).cast("int") * 2 + (F.col("side") if sides else F.lit(0))
    cell = F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", b1, b2))  # should two be the same, more is compared
    return placed.select(cell.alias("cell"), mark.cast("int").alias("mark"), *[c for c in rows.columns if c != "cell"]).repartition(tasks, "cell")


def tasks_of(spark: SparkSession, n: int) -> int:
    """Tasks that compare n rows."""
    return max(spark.sparkContext.defaultParallelism * 4, n // TASK)


def divided(rows: DataFrame, counts: DataFrame, sides: bool) -> DataFrame:
    """rows with the cells of more than BLOCK rows divided, and the column mark of scan().

    A full cell is divided into blocks by the hash of rid, and each pair of blocks becomes a group of its own, so that no
    cell is one task's work, however full. counts(COUNTS) may hold a cell in parts. Full cells are sent to every task up to
    LISTED of them; beyond, they are joined by cell and one of SALTS parts of its rows, so that a full cell is never one
    task's rows before it is divided either. The number of tasks follows from the rows counted.
    """
    n, full = full_cells(counts)
    return in_blocks(rows, full, sides, tasks_of(rows.sparkSession, n))


def near_portions(rows: Callable[[int, int], DataFrame], near: Near, counts: DataFrame, n_sets: int) -> DataFrame:
    """(left, right), once each: pairs of rows that meet in a cell and may be near; written to the checkpoint folder.

    rows(part, parts) gives the ROWS of one part of the cells, counts(COUNTS) tells the rows of all. One part is shuffled
    at a time, of about PORTION rows for each of n_sets, so the disk holds a few times the sets, however many cells each
    lies in. Cells of more than BLOCK rows are divided as by divided(). With sides, left is of side 0 and right of side 1;
    without, left < right.
    """
    spark, found = counts.sparkSession, None
    n, full = full_cells(counts)
    if not isinstance(full, list):
        full = cut(full)
    parts = max(1, ceil(n / max(LEAST_PORTION, PORTION * n_sets)))
    if parts > 1:
        release(spark)
    for part in range(parts):
        placed = in_blocks(rows(part, parts), full, near.sides, tasks_of(spark, n // parts)).select("cell", "mark", "rid", "size", *SKETCH)
        pairs = placed.sortWithinPartitions("cell").mapInArrow(scan(near), "left long, right long")  # one key: a radix sort
        found = cut((pairs if found is None else found.unionByName(pairs)).distinct())
        del placed, pairs
        if parts > 1:
            release(spark)
    return found


def verify(pairs: DataFrame, sets: DataFrame, t: float, *keep: str) -> DataFrame:
    """(left, right, share, *keep) of the pairs of records whose word share is at least t."""
    a, b = sets.select(F.col("rec").alias("left"), F.col("h").alias("ha")), sets.select(F.col("rec").alias("right"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    joined = pairs.join(a, "left").join(b, "right").withColumn("both", both)
    joined = joined.withColumn("share", F.col("both") / (F.size("ha") + F.size("hb") - F.col("both")))
    return joined.where(F.col("share") >= t).select("left", "right", "share", *keep)


def by_portions(pairs: DataFrame, n: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(pairs), about n of the pairs at a time, those of a left record together; written to the checkpoint folder."""
    spark, found = pairs.sparkSession, []
    parts = max(1, ceil(pairs.count() / n))
    for part in range(parts):
        own = pairs.where(F.pmod(F.xxhash64("left", F.lit(2)), F.lit(parts)) == part)
        found.append(cut(work(own)))
        del own
        if parts > 1:
            release(spark)
    return reduce(DataFrame.unionByName, found)


def verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """verify(), a portion of the pairs at a time."""
    return by_portions(pairs, max(LEAST_CHECKED, int(CHECKED * sets.count())), lambda own: verify(own, sets, t))


def distinct_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs(a, b) once each, where only those can be repeated of which an id has more than one row in members(id)."""
    several = cut(members.groupBy("id").count().where("count > 1").select("id"))
    if several.isEmpty():
        return pairs
    a, b = pairs.columns
    marked = pairs.join(several.select(F.col("id").alias(a), F.lit(1).alias("sa")), a, "left").join(several.select(F.col("id").alias(b), F.lit(1).alias("sb")), b, "left")
    once, more = marked.where("sa IS NULL AND sb IS NULL"), marked.where("sa IS NOT NULL OR sb IS NOT NULL")
    return once.select(a, b).unionByName(more.select(a, b).distinct())
