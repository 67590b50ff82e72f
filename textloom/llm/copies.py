"""Problem 4: records that are identical but for white space, letter case, punctuation or field order."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.lineage import checkpoint_dir, cut, spread, table

#: Keys of a bucket, about; the number of buckets of a new ledger follows from its first batch.
BUCKET_KEYS = 1_000_000
LEDGER = "bucket int, key string, copies long, kept_id long"
COMMITS = "version long, batch string, buckets int, touched array<int>"

_GAP = re.compile(r"[\W_]+")
_SPACE = re.compile(r"\s+")
_PIPE = re.compile(r"\s*\|\s*(?=[^\W\d][\w ]*:)")
_SEMI = re.compile(r"\s*;\s*(?=[^\W\d][\w ]*=)")
_COLON_FIELD = re.compile(r"\s*([^\W\d][\w ]*?)\s*:(.*)", re.S)
_EQUAL_FIELD = re.compile(r"\s*([^\W\d][\w ]*?)\s*=(.*)", re.S)


def canonical(text: str) -> str:
    """Letters and digits in lower case; what stands between two digits stays, its white space as one space."""
    text = unicodedata.normalize("NFC", text).lower()

    def gap(m: re.Match) -> str:
        a, b = m.start(), m.end()
        between = a and b < len(text) and text[a - 1].isdecimal() and text[b].isdecimal()
        return _SPACE.sub(" ", m[0]) if between else ""

    return _GAP.sub(gap, text)


def fields(text: str) -> list[tuple[str, str]] | None:
    """The named fields of a record in any of its layouts, or None for a plain text."""
    bare = text.strip().strip("﻿​").strip()
    if bare[:1] == "{":
        try:
            found = json.loads(bare, object_pairs_hook=list)
        except ValueError:
            return None
        pairs = found if isinstance(found, list) else []
        return [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in pairs] or None
    for cuts, one in ((_PIPE, _COLON_FIELD), (_SEMI, _EQUAL_FIELD)):
        found = [one.fullmatch(x) for x in cuts.split(bare)]
        if len(found) > 1 and all(found):
            return [(m[1], m[2]) for m in found]
    return None


def copy_key(text: str | None) -> str | None:
    """One key for all copies of a text; None for null and for texts without a letter or digit."""
    if text is None or not (plain := canonical(text)):
        return None
    named = fields(text)
    whole = "t" + plain if named is None else "r" + "\x1e".join(sorted(f"{canonical(k)}\x1f{canonical(v)}" for k, v in named))
    return hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "key": [copy_key(x) for x in pdf["text"]]})


def keyed(df: DataFrame) -> DataFrame:
    """(id, key) of df(id, text), for the rows that have a key."""
    return spread(df.select("id", "text").where("id IS NOT NULL AND text IS NOT NULL")).mapInPandas(_keys, "id long, key string").where("key IS NOT NULL")


def in_buckets(batch: DataFrame, buckets: int) -> DataFrame:
    """(id, bucket, key) of a batch of (id, key)."""
    return batch.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def update_ledger(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch of (id, bucket, key): counts added, the smallest id kept.

    The batch is aggregated before it is shuffled, so many copies of one key are one row for each task. Ledger rows of
    keys that the batch doesn't have stay as they are, and new keys are added.
    """
    new = batch.groupBy("bucket", "key").agg(F.count("*").alias("more"), F.min("id").alias("first_id"))
    joined = ledger.join(new, ["bucket", "key"], "full_outer")
    copies = F.coalesce("copies", F.lit(0)) + F.coalesce("more", F.lit(0))
    return joined.select("bucket", "key", copies.alias("copies"), F.least("kept_id", "first_id").alias("kept_id"))


class Ledger:
    """A ledger of copies in a shared folder, which lasts over sessions.

    Rows are Parquet files by version and bucket; a batch reads the buckets it touches, joins them with its own counts and
    writes them as a new version. A version counts once its commit, a single file, is there: a batch that was lost on
    the way leaves the ledger as it was, and a batch whose name is already committed is not counted again. Each bucket is
    read from its newest version; compact() writes all into one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """buckets: of a new ledger, else BUCKET_KEYS and its first batch decide."""
        self.spark, self.path, self.wanted = spark, path.rstrip("/"), buckets

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).json(f"{self.path}/commits")
        except Exception as e:  # no batch yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], COMMITS)

    def _versions(self) -> DataFrame:
        """(bucket, version): the newest of each bucket."""
        return self.commits().select("version", F.explode("touched").alias("bucket")).groupBy("bucket").agg(F.max("version").alias("version"))

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """(LEDGER) of the given buckets or of all."""
        newest = self._versions()
        if touched is not None:
            newest = newest.where(F.col("bucket").isin(touched))
        by: dict[int, list[int]] = {}
        for r in newest.collect():  # one row for each bucket
            by.setdefault(r["version"], []).append(r["bucket"])
        out = self.spark.createDataFrame([], LEDGER)
        for version, buckets in sorted(by.items()):
            out = out.unionByName(self.spark.read.schema(LEDGER).parquet(f"{self.path}/v{version}").where(F.col("bucket").isin(buckets)))
        return out

    def _commit(self, rows: DataFrame, batch: str, buckets: int, touched: list[int], version: int) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        self.spark.createDataFrame([(version, batch, buckets, touched)], COMMITS).coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def add(self, name: str, batch: DataFrame) -> bool:
        """Counts a batch of (id, key); False if a batch of this name was counted before."""
        known = self.commits().agg(F.max("version"), F.max("buckets"), F.count_if(F.col("batch") == name)).first()
        if known[2]:
            return False
        buckets = known[1] or self.wanted or max(1, -(-batch.count() // BUCKET_KEYS))
        placed = in_buckets(batch, buckets)
        touched = sorted(r[0] for r in placed.select("bucket").distinct().collect())  # one for each bucket
        if touched:
            self._commit(update_ledger(self.read(touched), placed), name, buckets, touched, (known[0] or 0) + 1)
        return True

    def compact(self) -> None:
        """Writes the newest version of all buckets into one version."""
        known = self.commits().agg(F.max("version"), F.max("buckets")).first()
        if known[0]:
            self._commit(self.read(), f"compact-{known[0] + 1}", known[1], list(range(known[1])), known[0] + 1)


def collapse(df: DataFrame, path: str | None = None, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, ledger) of df(id, text): rows (id, key), ledger (bucket, key, copies, kept_id).

    The rows go to the ledger at path in batches by ranges of id, as they would arrive; without a path to a new one in the
    checkpoint folder. Null ids, null texts and texts without a letter or digit are in neither result; an empty df gives
    empty ones; rows repeated with the same id count each time.
    """
    rows = cut(keyed(df))
    ends = rows.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    ends = [None, *ends, None] if ends else [None, None]
    ledger = Ledger(df.sparkSession, path or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    for low, high in zip(ends, ends[1:], strict=False):
        batch = rows
        if low is not None:
            batch = batch.where(F.col("id") > low)
        if high is not None:
            batch = batch.where(F.col("id") <= high)
        ledger.add(f"{low} to {high}", batch)
    return rows, ledger.read()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "seq_1_aug_0").select(F.col("row_id").alias("id"), F.col("Text").alias("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kept_id, row_id): each row of seq_1_aug_0 that is a copy, and the smallest id of its group."""
    rows, ledger = collapse(_texts(spark, sf_dir))
    several = ledger.where("copies > 1").select("key", "kept_id")
    return rows.join(several, "key").where("id > kept_id").select("kept_id", F.col("id").alias("row_id")).distinct()


def p4_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kept_id, copies): one row for each text of seq_1_aug_0, with the number of rows that it stands for."""
    return collapse(_texts(spark, sf_dir))[1].select("kept_id", "copies")
