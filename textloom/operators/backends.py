"""Interchangeable ways to compare texts: each turns rows into unit vectors of terms, fitted on one set and used on another."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import corpus as co
from textloom.operators import similarity as sim


class Backend(Protocol):
    """What a filter needs of a backend."""

    def fit(self, real: DataFrame) -> Backend:
        """Learns from real(id, class_label, text or v)."""

    def nearest(self, candidates: DataFrame, refs: DataFrame) -> DataFrame:
        """(id, sim): of each candidate the greatest similarity to a reference; 0 where nothing is shared."""


def tfidf_terms(df: DataFrame) -> DataFrame:
    """(id, w) of df(id, text): words of two characters or more and their neighbouring pairs; rows without a text are left out.

    The words are a column of their own before they are paired, as the pairs would else cut the text anew for each."""
    w = df.where("text IS NOT NULL").select("id", F.filter(co.words(F.col("text")), lambda x: F.length(x) > 1).alias("w"))
    return w.select("id", F.concat("w", co.bigrams(F.col("w"))).alias("w"))


class TfIdf:
    """Sublinear TF-IDF over the most frequent terms of the real texts (ties in the order of the terms)."""

    def __init__(self, max_features: int | None = 20_000):
        self.max_features, self.real = max_features, None

    def fit(self, real: DataFrame) -> TfIdf:
        self.real = tfidf_terms(real)
        return self

    def nearest(self, candidates: DataFrame, refs: DataFrame) -> DataFrame:
        rows = [tfidf_terms(df) for df in (candidates, refs)]
        if self.max_features:
            kept = [r["term"] for r in co.frequent_terms(self.real, F.col("w"), self.max_features).collect()]
            near = co.nearest_numbered(*rows, self.real, "id", F.col("w"), kept)
        else:
            a, b = (co.tfidf_of(x, "id", F.col("w"), self.real) for x in rows)
            near = co.nearest_text(a, b, "id")
        return candidates.select("id").join(near, "id", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


class Vectors:
    """Stored unit vectors v; there is nothing to fit."""

    def fit(self, real: DataFrame) -> Vectors:
        return self

    def nearest(self, candidates: DataFrame, refs: DataFrame) -> DataFrame:
        one = F.lit("all").alias("class_label")
        found = sim.reference_similarity(candidates.select("id", one, "v"), refs.select("id", one, "v"))
        return found.select("id", F.coalesce("sim", F.lit(0.0)).alias("sim"))


BACKENDS: dict[str, Callable[[], Backend]] = {"tfidf": TfIdf, "embedding": Vectors}


def backends(name: str) -> dict[str, Backend]:
    """The backend of a name, or all for 'all'; an unknown name is an error."""
    if name == "all":
        return {n: make() for n, make in BACKENDS.items()}
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}")
    return {name: BACKENDS[name]()}
