"""Filters and reports over unit vectors: nearest references, class gap, diversity, overlap, mean similarities.

Vectors are arrays of double of one length. Similarity is the dot product, which for unit vectors is the cosine. Means of
similarities never need pairs: the mean over pairs of two groups is the dot product of their mean vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reference vectors that one pass compares every row with; a larger reference set takes several passes.
BLOCK = 4096



def dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, squares, mean): of each group the size, the sum of squared norms and the mean vector."""
    dims = df.select(*groups, F.posexplode("v").alias("i", "x")).groupBy(*groups, "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    packed = dims.groupBy(*groups).agg(F.max("n").alias("n"), F.sum("q").alias("squares"), F.array_sort(F.collect_list(F.struct("i", F.col("s") / F.col("n")))).alias("m"))
    return packed.select(*groups, "n", "squares", F.transform("m", lambda x: x["col2"]).alias("mean"))


def pair_mean(mean: Column, n: Column, squares: Column) -> Column:
    """Mean similarity of the n * (n - 1) ordered pairs of a group; null for a single vector."""
    return F.try_divide(n * n * dot(mean, mean) - squares, n * (n - 1))


def _blocks(refs: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """The references in blocks of at most BLOCK vectors, by ranges of their ids."""
    last = None
    while True:
        part = refs if last is None else refs.where(F.col("id") > last)
        rows = part.orderBy("id").limit(BLOCK).select("id", "class_label", "v").collect()
        if not rows:
            return
        yield [r["class_label"] for r in rows], np.array([r["v"] for r in rows]), np.array([r["id"] for r in rows])
        last = rows[-1]["id"]


def _reduced(labels: list[str], m: np.ndarray):
    """Per row the maximum, sum and count of its similarities to the block's vectors of its own and of the other classes."""
    marks = np.array(labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sims = np.stack(pdf["v"].to_numpy()) @ m.T
            own = pdf["class_label"].to_numpy()[:, None] == marks
            out = {"id": pdf["id"], "class_label": pdf["class_label"]}
            for name, use in (("own", own), ("other", ~own)):
                out[f"{name}_max"] = np.where(use, sims, -np.inf).max(axis=1)
                out[f"{name}_sum"] = np.where(use, sims, 0.0).sum(axis=1)
                out[f"{name}_n"] = use.sum(axis=1)
            yield pd.DataFrame(out)

    return run


def reference_scores(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, class_label, own_max, own_mean, other_max, other_mean) of candidates(id, class_label, v): the greatest and the mean
    similarity to the references(id, class_label, v) of the own class and of the others, null where there are none.

    References go to the tasks in blocks of bounded size, so candidates never move; each block is one matrix product, and
    all four measures come from one pass. Only with several blocks are their results brought together."""
    schema = "id long, class_label string, " + ", ".join(f"{x}_max double, {x}_sum double, {x}_n long" for x in ("own", "other"))
    parts = [candidates.select("id", "class_label", "v").mapInPandas(_reduced(labels, m), schema) for labels, m, _ in _blocks(refs)]
    if not parts:
        none = F.lit(None).cast("double")
        return candidates.select("id", "class_label", *[none.alias(f"{x}_{y}") for x in ("own", "other") for y in ("max", "mean")])
    whole = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            whole = whole.unionByName(p)
        whole = whole.groupBy("id", "class_label").agg(*[f(f"{x}_{y}").alias(f"{x}_{y}") for x in ("own", "other") for y, f in (("max", F.max), ("sum", F.sum), ("n", F.sum))])
    found = []
    for x in ("own", "other"):
        found += [F.when(F.col(f"{x}_n") > 0, F.col(f"{x}_max")).alias(f"{x}_max"), F.try_divide(f"{x}_sum", f"{x}_n").alias(f"{x}_mean")]
    return whole.select("id", "class_label", *found)


def reference_similarity(candidates: DataFrame, refs: DataFrame, own: bool = True, how: str = "max") -> DataFrame:
    """(id, class_label, sim) of candidates: the max or mean similarity to the references of the own class, or of the others;
    see reference_scores. A candidate whose class has no reference has a null sim."""
    return reference_scores(candidates, refs).select("id", "class_label", F.col(f"{'own' if own else 'other'}_{how}").alias("sim"))


def top_scored(scored: DataFrame, groups: list[str], score: str, keep: int, row_id: str = "id") -> DataFrame:
    """The keep rows of the highest score in each group, ties to the smaller id; null scores are left out."""
    w = Window.partitionBy(*groups).orderBy(F.desc(F.round(score, 9)), row_id)
    return scored.where(F.col(score).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def class_gap(candidates: DataFrame, refs: DataFrame, how: str = "mean", weight: float = 1.0) -> DataFrame:
    """(id, class_label, gap): similarity to the own class less weight times that to the other; how is 'mean' or 'max'."""
    if how not in ("mean", "max"):
        raise ValueError(f"unknown aggregate {how}")
    gap = F.col(f"own_{how}") - weight * F.coalesce(F.col(f"other_{how}"), F.lit(0.0))
    return reference_scores(candidates, refs).select("id", "class_label", gap.alias("gap"))


def gap_pipeline(candidates: DataFrame, refs: DataFrame, target: int, how: str = "mean", weight: float = 1.0) -> DataFrame:
    """(class_label, id, place): of each class the candidates of the greatest gap, down to halfway between their number and
    target, then the most diverse target of them. The midpoint isn't bounded by the number of candidates, so a class
    of fewer candidates than target keeps all."""
    n = candidates.groupBy("class_label").agg(F.count("*").alias("n"))
    keep = n.select("class_label", (F.lit(target) + F.floor((F.col("n") - target) / 2)).alias("mid"))
    scored = class_gap(candidates, refs, how, weight).withColumnRenamed("gap", "sim").join(F.broadcast(keep), "class_label")  # one row a class
    near = candidates.join(nearest_half(scored).select("id"), "id", "left_semi")
    return diverse(near, ["class_label"], target)


def _farthest(chosen: dict[str, tuple[np.ndarray, set]]):
    """Of each group of a task the row farthest from the chosen ones, ties to the smaller id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for pdf in batches:
            for g, at in pdf.groupby("_g").indices.items():
                part = pdf.iloc[at]
                if g in chosen:
                    m, ids = chosen[g]
                    part = part[~part["id"].isin(ids)]
                    if not len(part):
                        continue
                    least = np.round(np.minimum(1.0, 1 - (np.stack(part["v"].to_numpy()) @ m.T).max(axis=1)), 9)
                else:
                    least = np.ones(len(part))
                i = np.lexsort((part["id"].to_numpy(), -least))[0]
                one = (-least[i], part["id"].iloc[i], part["v"].iloc[i])
                best[g] = min(best.get(g, one), one, key=lambda x: x[:2])
        yield pd.DataFrame([(g, x[1], -x[0], x[2]) for g, x in best.items()], columns=["_g", "id", "least", "v"])

    return run


def diverse(df: DataFrame, groups: list[str], keep: int) -> DataFrame:
    """(groups, id, place): a greedy diverse choice of keep rows of each group of df(groups, id, v): first the smallest
    id, then always the vector farthest from all chosen, where 1 - cosine counts as 1 at most and ties go to the smaller id.

    The choice goes in rounds: every task compares its rows with the vectors chosen so far, in one matrix product, and
    gives its farthest of each group, of which the best is chosen. Rows stay where they are, the lineage is cut once and
    does not grow, and the driver holds keep vectors of each group. A group of no more than keep rows is taken by id."""
    from textloom.plans.lineage import cut

    base = cut(df.select(*groups, "id", "v", F.to_json(F.struct(*groups)).alias("_g")))
    small = {r["_g"] for r in base.groupBy("_g").count().where(F.col("count") <= keep).collect()}
    chosen: dict[str, tuple[np.ndarray, set]] = {}
    rows = []
    for place in range(1, keep + 1):
        got = base.where(~F.col("_g").isin(*small)).mapInPandas(_farthest(chosen), "_g string, id long, least double, v array<double>")
        best = got.groupBy("_g").agg(F.max_by(F.struct("id", "v"), F.struct("least", -F.col("id"))).alias("x")).collect()
        for g, (i, v) in best:
            m, ids = chosen.get(g, (np.empty((0, len(v))), set()))
            chosen[g] = np.vstack([m, v]), ids | {i}
            rows.append((g, i, place))
    picked = df.sparkSession.createDataFrame(rows, "_g string, id long, place int")
    few = base.where(F.col("_g").isin(*small)).withColumn("place", F.row_number().over(Window.partitionBy("_g").orderBy("id")))  # keep rows of a group at most
    return base.join(F.broadcast(picked), ["_g", "id"]).select(*groups, "id", "place").unionByName(few.select(*groups, "id", "place"))


def nearest_half(scored: DataFrame) -> DataFrame:
    """Of scored(class_label, id, sim, mid) the mid rows of the greatest sim of each class, ties to the smaller id; all where
    mid is negative. A row's place is that within its narrow range of sim plus the rows of all ranges above."""
    binned = scored.withColumn("_bin", F.coalesce(F.floor(F.round("sim", 9) * 10_000), F.lit(-(1 << 40))))
    sizes = binned.groupBy("class_label", "_bin").agg(F.count("*").alias("_n"))  # some 20,000 rows a class
    above = Window.partitionBy("class_label").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("class_label", "_bin", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    w = Window.partitionBy("class_label", "_bin").orderBy(F.desc(F.round("sim", 9)), "id")
    placed = binned.join(F.broadcast(before), ["class_label", "_bin"]).where("mid < 0 OR _before < mid").withColumn("_in", F.row_number().over(w))
    return placed.where("mid < 0 OR _before + _in <= mid").drop("_bin", "_before", "_in")


def filter_pipeline(candidates: DataFrame, refs: DataFrame, target: int) -> DataFrame:
    """(class_label, id, place): the candidates nearest to their references, halfway down to target, then the most
    diverse target of them. Fewer candidates than target are all kept."""
    n = candidates.groupBy("class_label").agg(F.count("*").alias("n"))
    keep = n.select("class_label", F.least("n", F.lit(target) + F.floor((F.col("n") - target) / 2)).alias("mid"))
    scored = reference_similarity(candidates, refs).join(F.broadcast(keep), "class_label")  # one row a class
    near = candidates.join(nearest_half(scored).select("id"), "id", "left_semi")
    return diverse(near, ["class_label"], target)


def _nearest(ids: np.ndarray, m: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sims = np.round(m @ np.stack(pdf["v"].to_numpy()).T, 9)
            own = pdf["id"].to_numpy()
            sims[ids[:, None] == own] = -np.inf  # nobody is their own neighbour
            for q in range(0, len(ids), 256):
                part = sims[q : q + 256]
                order = np.lexsort((np.broadcast_to(own, part.shape), -part), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(part)), order.shape[1])
                got = part[rows, order.ravel()]
                ok = got > -np.inf
                yield pd.DataFrame({"q": ids[q + rows][ok], "id": own[order.ravel()][ok], "sim": got[ok]})

    return run


def nearest_neighbours(df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, id, sim, place): for each query the k nearest rows of df(id, class_label, v), the query itself left out.

    Queries go to the tasks in blocks; each task keeps k of each of its batches, and the best k are chosen of those."""
    parts = None
    for _, m, ids in _blocks(queries):
        one = df.mapInPandas(_nearest(ids, m, k), "q long, id long, sim double")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return df.sparkSession.createDataFrame([], "q long, id long, sim double, place int")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return parts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def overlap_scores(df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, class_label, score): the share of the k nearest neighbours of each query that have another label."""
    near = nearest_neighbours(df, queries, k).join(df.select("id", F.col("class_label").alias("other")), "id")
    near = near.join(queries.select(F.col("id").alias("q"), "class_label"), "q")
    return near.groupBy(F.col("q").alias("id"), "class_label").agg(F.avg((F.col("other") != F.col("class_label")).cast("double")).alias("score"))


def drop_lowest(scored: DataFrame, share: float) -> DataFrame:
    """scored(id, class_label, score) without the round(share * n) rows of the lowest score in each class."""
    w = Window.partitionBy("class_label")
    placed = scored.withColumns({"n": F.count("*").over(w), "low": F.row_number().over(w.orderBy(F.round("score", 9), "id"))})
    return placed.where(F.col("low") > F.bround(F.col("n") * share)).drop("n", "low")


def _most_distant(labels: np.ndarray, m: np.ndarray, ids: np.ndarray):
    """Of each group of a batch its most distant pair (a, b), a < b, with a vector of the block as a."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = {}
            for g, at in pdf.groupby("class_label").indices.items():
                mine = np.flatnonzero(labels == g)
                for k in range(0, len(at) if len(mine) else 0, 1024):
                    part = pdf.iloc[at[k : k + 1024]]
                    own = part["id"].to_numpy()
                    far = np.round(1 - m[mine] @ np.stack(part["v"].to_numpy()).T, 9)
                    far[ids[mine][:, None] >= own] = -np.inf
                    top = far.max()
                    if top > -np.inf:
                        i, j = np.nonzero(far == top)
                        best[g] = min([*([best[g]] if g in best else []), *zip([-top] * len(i), ids[mine][i].tolist(), own[j].tolist(), strict=True)])
            yield pd.DataFrame([(g, x[1], x[2], -x[0]) for g, x in best.items()], columns=["class_label", "a", "b", "distance"])

    return run


def farthest_pair(df: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, a, b, distance): the two most distant vectors of each group, ties to the smaller ids.

    With a group's mean vector c and r the distance of a vector to it, 1 - a.b is at most 1 + c.c - c.a - c.b + r_a * r_b.
    The vector least like c and the one farthest from it give a distance; vectors that can't reach it with any other are
    left out. The remaining ones are compared block by block, each block one matrix product with every batch, of which
    only the most distant pair is kept."""
    from textloom.plans.lineage import cut

    v = F.col("v")
    base = cut(df.dropna(subset=groups).select("id", "v", F.to_json(F.struct(*groups)).alias("class_label")))
    mean = centroids(base, ["class_label"]).select("class_label", "mean", dot(F.col("mean"), F.col("mean")).alias("_c"))
    x = base.join(F.broadcast(mean), "class_label").withColumn("_ca", dot(v, F.col("mean")))  # one mean for each group
    x = cut(x.withColumn("_r", F.sqrt(F.greatest(dot(v, v) - 2 * F.col("_ca") + F.col("_c"), F.lit(0.0)))).drop("mean"))
    most = x.groupBy("class_label").agg(F.max(-F.col("_ca")).alias("_m"), F.max("_r").alias("_far"), F.min_by(F.struct("id", "v"), F.struct("_ca", "id")).alias("_p"))
    reached = x.join(F.broadcast(most), "class_label").where("id <> _p.id").groupBy("class_label").agg(F.max(1 - dot(v, F.col("_p.v"))).alias("_d"))
    bound = 1 + F.col("_c") - F.col("_ca") + F.col("_m") + F.col("_r") * F.col("_far")
    able = cut(x.join(F.broadcast(most.drop("_p").join(reached, "class_label")), "class_label").where(bound >= F.col("_d") - 1e-6).select("id", "class_label", "v"))
    best: dict = {}
    for labels, m, ids in _blocks(able):
        pairs = able.where(F.col("id") > int(ids[0])).mapInPandas(_most_distant(np.array(labels), m, ids), "class_label string, a long, b long, distance double")
        for g, one in pairs.groupBy("class_label").agg(F.min(F.struct(-F.col("distance"), "a", "b")).alias("x")).collect():
            best[g] = min(best.get(g, tuple(one)), tuple(one))
    found = df.sparkSession.createDataFrame([(g, x[1], x[2], -x[0]) for g, x in best.items()], "class_label string, a long, b long, distance double")
    named = df.dropna(subset=groups).select(*groups, F.to_json(F.struct(*groups)).alias("_g")).distinct()
    return named.join(F.broadcast(found.withColumnRenamed("class_label", "_g")), "_g").select(*groups, "a", "b", "distance")


def contrast(df: DataFrame, label: str) -> DataFrame:
    """(same, other, gap): mean similarity of pairs of one label and of two labels, over all ordered pairs of df(v, label).

    All from one row for each label: sums of vectors give sums over pairs."""
    c = centroids(df, [label])
    dims = c.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg(F.sum(F.col("n") * F.col("m")).alias("s"))
    whole = dims.agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    own = c.agg(F.sum(F.col("n") * F.col("n") * dot(F.col("mean"), F.col("mean"))).alias("own"), F.sum("squares").alias("q"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    x = own.join(F.broadcast(whole))  # one row each
    same = F.try_divide(F.col("own") - F.col("q"), F.col("n2") - F.col("n"))
    other = F.try_divide(F.col("all") - F.col("own"), F.col("n") * F.col("n") - F.col("n2"))
    return x.select(same.alias("same"), other.alias("other"), (same - other).alias("gap"))


def _range(labels: np.ndarray, m: np.ndarray, ids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sims = m @ np.stack(pdf["v"].to_numpy()).T
            own, group = pdf["id"].to_numpy(), pdf["class_label"].to_numpy()
            for g in np.unique(labels):
                use = (labels == g)[:, None] & (group == g) & (ids[:, None] != own)
                if use.any():
                    x = sims[use]
                    yield pd.DataFrame({"class_label": [g], "least": [x.min()], "most": [x.max()], "total": [x.sum()], "n": [x.size]})

    return run


def separation(df: DataFrame, group: str, side: str) -> DataFrame:
    """(group, separation): in each group the squared distance of the mean vectors of the two sides; null with one side only."""
    c = centroids(df, [group, side])
    m = F.array_sort(F.collect_list(F.struct(F.col(side).alias("s"), "mean")))
    diff = F.zip_with(F.col("m")[0]["mean"], F.col("m")[1]["mean"], lambda x, y: x - y)
    by = c.groupBy(group).agg(m.alias("m"))  # two rows each
    return by.select(group, F.when(F.size("m") == 2, F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)).alias("separation"))


def similarity_range(df: DataFrame, queries: DataFrame) -> DataFrame:
    """(class_label, least, most, mean): of the similarities of each query to the other rows of df(id, class_label, v) of its class.

    Queries go to the tasks in blocks; a task gives one row for each label of a batch."""
    parts = None
    for labels, m, ids in _blocks(queries):
        one = df.mapInPandas(_range(np.array(labels), m, ids), "class_label string, least double, most double, total double, n long")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return df.sparkSession.createDataFrame([], "class_label string, least double, most double, mean double")
    by = parts.groupBy("class_label").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return by.select("class_label", "least", "most", (F.col("total") / F.col("n")).alias("mean"))


def contrastive_loss(df: DataFrame, batch: str, label: str, temperature: float) -> DataFrame:
    """(batch, loss): supervised contrastive loss of each batch of df(id, v, batch, label), which has a bounded number of rows.

    Of each row with another of its label in the batch, the mean over those of the negative log of its share of the
    exponentials of the similarities to all other rows; then the mean over the rows."""
    x = df.select(F.col("id").alias("i"), batch, F.col(label).alias("li"), F.col("v").alias("vi"))
    y = df.select(F.col("id").alias("j"), batch, F.col(label).alias("lj"), F.col("v").alias("vj"))
    pairs = x.join(y, batch).where("i <> j").select(batch, "i", (F.col("li") == F.col("lj")).alias("own"), (dot(F.col("vi"), F.col("vj")) / temperature).alias("s"))
    one = pairs.groupBy(batch, "i").agg(F.log(F.sum(F.exp("s"))).alias("all"), F.avg(F.when(F.col("own"), F.col("s"))).alias("mean"))
    return one.where("mean IS NOT NULL").groupBy(batch).agg(F.avg(F.col("all") - F.col("mean")).alias("loss"))


def _best(ids: np.ndarray, m: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sims = m @ np.stack(pdf["v"].to_numpy()).T
            for label, at in pdf.groupby("class_label").indices.items():
                yield pd.DataFrame({"q": ids, "class_label": label, "sim": sims[:, at].max(axis=1)})

    return run


def best_in_groups(df: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, class_label, sim): for each query and each label of df(id, class_label, v) the greatest similarity.

    Queries go to the tasks in blocks; a task gives one row for each query and label of a batch. Null labels are left out."""
    parts = None
    for _, m, ids in _blocks(queries):
        one = df.where("class_label IS NOT NULL").mapInPandas(_best(ids, m), f"q long, class_label {df.schema['class_label'].dataType.simpleString()}, sim double")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("q", "class_label").agg(F.max("sim").alias("sim")) if parts is not None else df.sparkSession.createDataFrame([], "q long, class_label string, sim double")
