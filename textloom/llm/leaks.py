"""Problem 8: documents that hold passages of evaluation items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.lineage import cut, spread, table

#: Consecutive words of an item that make a leak.
WORDS = 8
#: Words of items that one task searches at once; more items are searched in more passes over the stored arrays.
ITEM_WORDS = 4_000_000
#: Words of one shard, at least; a shard is never part of a document.
SHARD = 1_000_000

ARRAYS = "docs array<long>, starts array<int>, words array<long>, suffixes array<int>"
FOUND = "doc_id long, item_id long, n_words int, doc_word int, item_word int"
#: What ends a document or an item; no word has this hash, or it only ends matches early.
END = -1


def hashed_words(df: DataFrame) -> DataFrame:
    """(id, w): the hashes of the words of df(id, text) in the order of the text; rows without id or text are left out."""
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return df.where("id IS NOT NULL AND text IS NOT NULL").select("id", F.transform(word, lambda w: F.xxhash64(w)).alias("w"))


def joined(ids: pa.Array, w: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, words): texts one after another, each with an END."""
    sizes = w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.full(int(sizes.sum()) + len(sizes), END, np.int64)
    inside = np.ones(len(words), bool)
    inside[starts + sizes] = False
    words[inside] = w.flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy(zero_copy_only=False), starts, words


def whole(words: np.ndarray, depth: int) -> np.ndarray:
    """The places from which depth words follow in one text."""
    gap = np.concatenate([[0], np.cumsum(words == END)])
    at = np.arange(max(0, len(words) - depth + 1))
    return at[gap[at + depth] == gap[at]]


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """The places from which depth words follow in one text, in the order of those words.

    By doubling: the ranks of runs of 1, 2, 4, ... words give those of twice as many, and at the end of depth words."""
    rank, length = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while length < depth:
        more = min(length, depth - length)
        n = len(rank) - more
        if n <= 0:
            return np.zeros(0, np.int32)
        rank = np.unique(rank[:n] * (int(rank.max()) + 1) + rank[more:], return_inverse=True)[1].astype(np.int64)
        length += more
    at = whole(words, depth)
    return at[np.argsort(rank[at], kind="stable")].astype(np.int32)


def bounds(words: np.ndarray, suffixes: np.ndarray, items: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of items the first suffix that doesn't sort before its depth words, and the first that sorts after
    them: binary searches of all places at once."""
    out = []
    for after in (False, True):
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(suffixes), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            place, less, equal = suffixes[mid], np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k in range(depth):
                a, b = words[place + k], items[at[open_] + k]
                less |= equal & (a < b)
                equal &= a == b
            right = less | equal if after else less
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        out.append(low)
    return out[0], out[1]


def longest(docs: tuple[np.ndarray, np.ndarray, np.ndarray], suffixes: np.ndarray, items: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> pa.RecordBatch | None:
    """A batch of FOUND: the maximal verbatim matches of the items in the documents of a shard."""
    (ids, starts, words), (item_ids, item_starts, item_words) = docs, items
    at = whole(item_words, depth)
    if not len(suffixes) or not len(at):
        return None
    low, high = bounds(words, suffixes, item_words, at, depth)
    n = high - low
    i = np.repeat(at, n)
    p = suffixes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].astype(np.int64)
    before_i, before_p = np.where(i > 0, item_words[i - 1], END), np.where(p > 0, words[p - 1], END)
    first = (before_i != before_p) | (before_i == END)  # else it's part of the match that starts a word before
    i, p = i[first], p[first]
    if not len(i):
        return None
    length = np.full(len(i), depth, np.int64)
    grow = np.arange(len(i))
    while len(grow):  # the END of either stops it
        a, b = item_words[i[grow] + length[grow]], words[p[grow] + length[grow]]
        grow = grow[(a == b) & (a != END)]
        length[grow] += 1
    d, own = np.searchsorted(starts, p, "right") - 1, np.searchsorted(item_starts, i, "right") - 1
    columns = [ids[d], item_ids[own], length.astype(np.int32), (p - starts[d]).astype(np.int32), (i - item_starts[own]).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a task in shards of SHARD words, or more if one document has more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        first = 0
        for k, size in enumerate(batch.column("w").value_lengths().to_pylist(), 1):
            n += size
            if n >= SHARD:
                held.append(batch.slice(first, k - first))
                yield _joined(held)
                held, first, n = [], k, 0
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    return joined(t.column("id").combine_chunks(), t.column("w").combine_chunks())


def _build(depth: int):
    """The suffix arrays of the shards of a task, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, starts, words in _shards(batches):
            columns = [(ids, pa.int64()), (starts, pa.int32()), (words, pa.int64()), (suffix_array(words, depth), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(t)) for x, t in columns], names=["docs", "starts", "words", "suffixes"])

    return run


def _search(items: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int, stored: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays():
            if not stored:
                for shard in _shards(batches):
                    yield shard, suffix_array(shard[2], depth)
                return
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, starts, words, suffixes = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("docs", "starts", "words", "suffixes"))
                    yield (ids, starts.astype(np.int64), words), suffixes

        for shard, suffixes in arrays():
            found = longest(shard, suffixes, items, depth)
            if found is not None:
                yield found

    return run


def training_arrays(documents: DataFrame, depth: int = WORDS) -> DataFrame:
    """(ARRAYS): the suffix arrays of documents(id, text), one row for each shard of whole documents, written to the
    checkpoint folder. They don't depend on what is searched in them; write them to a table to use them again."""
    return cut(spread(hashed_words(documents)).mapInArrow(_build(depth), ARRAYS))


def find_leaks(documents: DataFrame, items: DataFrame, depth: int = WORDS, arrays: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): the maximal verbatim matches of items in documents.

    documents(id, text), items(id, text). The texts are shards of whole documents, each with the suffix array of its
    words; every suffix of every item is looked up in each by binary search, and what is found is extended to the longest
    match of depth words or more, with its places counted in words from 0. arrays: those of training_arrays, instead of
    documents. Items go to the tasks in portions of ITEM_WORDS words: if one portion has them all, each array is searched
    as soon as it is sorted; else the arrays are stored and each portion is read, searched and its matches stored in
    turn, so that neither the driver nor a task ever holds more items than a portion. The corpus never leaves its partition.

    Rows without an id and texts that are null or have fewer than depth words are in no match; items of the same text are
    all named; repeated documents are found each on its own; empty tables give no rows. Words are compared by 64-bit hashes.
    """
    words = hashed_words(items)
    sized = words.agg(F.sum(F.size("w"))).first()[0] or 0
    passes = max(1, -(-sized // ITEM_WORDS))

    def portion(k: int):
        own = words if passes == 1 else words.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k)
        got = own.toArrow().combine_chunks()  # about ITEM_WORDS words
        return joined(got.column("id").combine_chunks(), got.column("w").combine_chunks())

    if arrays is None and passes == 1:
        return spread(hashed_words(documents)).mapInArrow(_search(portion(0), depth, False), FOUND)
    arrays = training_arrays(documents, depth) if arrays is None else arrays
    out = documents.sparkSession.createDataFrame([], FOUND)
    for k in range(passes):
        out = out.unionByName(cut(arrays.mapInArrow(_search(portion(k), depth, True), FOUND)))
    return out


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return find_leaks(documents, table(spark, sf_dir, "eval_item").select(F.col("item_id").alias("id"), "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that hold at least 8 consecutive words of an item."""
    return _found(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_words): the longest match of each item in each document."""
    return _found(spark, sf_dir).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source): the documents that are left once those with a leak are removed."""
    leaked = _found(spark, sf_dir).select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(leaked, "doc_id", "left_anti")


_WORDS_OF = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
a AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS k FROM i)),
b AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d))
"""

ORACLES = {
    "p8_found": _WORDS_OF + "SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)",
    "p8_clean": _WORDS_OF + "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a JOIN b USING (g))",
}
