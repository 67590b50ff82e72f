"""Cutting lineage and spreading work in a way that survives the loss of executors."""

from __future__ import annotations

import gc
import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where the session names none, a temporary one is set if all runs in one process;
    on a cluster that is an error, as executors don't see the driver's disk."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="textloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder once and go on from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle and checkpoint files of DataFrames that nothing refers to any more.

    Spark deletes them when the driver's JVM collects its garbage, which may be long after the disk is full. What Python let
    go of waits in a queue that is only emptied once a second, so it's emptied here; what the first collection lets go of is
    deleted after the second.
    """
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    for _ in range(2):
        gc.collect()
        for _ in range(len(waiting)):
            try:
                client, target = waiting.pop()
            except (IndexError, TypeError, ValueError):  # emptied by its own thread, or the sign to end
                break
            client.garbage_collect_object(target, False)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def spread(df: DataFrame) -> DataFrame:
    """Give a small scan at least one partition for each core, so that a Python stage uses them all.

    Round robin moves every row once; files that are large enough for Spark to split them for all cores are left alone, as
    judged by the size that the optimizer knows, without running anything.
    """
    spark = df.sparkSession
    wanted = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    return df if size >= wanted * split else df.repartition(wanted)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
