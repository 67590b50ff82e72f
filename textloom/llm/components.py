"""Connected components of a table of links, without sending links or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.lineage import cut, release


#: Nodes of the local clusters that a task holds at once.
NODES = 1_000_000
#: Links from which what a round shuffled is deleted before the next.
MANY = 100_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a task as a forest: each node with the smallest node of its local cluster.

    A task with very many nodes gives several forests, which are merged like those of several tasks."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def out() -> pd.DataFrame:
        nodes = list(up)
        found = pd.DataFrame({"u": nodes, "v": [root(x) for x in nodes]}, dtype="int64")
        return found[found.u != found.v]

    for pdf in batches:
        for a, b in zip(pdf["left"].tolist(), pdf["right"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > NODES:
            yield out()
            up.clear()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node linked with node through any chain of links(left, right).

    Each task first merges its own links into local clusters (links are best partitioned so that a cluster's lie together);
    then every round hangs each node's neighbours under the
    smallest of them, from both sides, until nothing changes: a number of rounds in the logarithm of the longest chain.
    Each round is written to the checkpoint folder, so a lost executor costs one round at most, and what many links shuffled is deleted. Empty links give an
    empty result; loops and repeated links change nothing.
    """
    edges = cut(links.mapInPandas(_forest, "u long, v long").distinct())  # u > v
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v != m").toDF("u", "v")
        edges = cut(small.unionByName(least.toDF("u", "v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        del both, least, large, small
        if now[0] > MANY:
            release(links.sparkSession)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.toDF("node", "label").unionByName(roots.withColumn("label", F.col("node")))
