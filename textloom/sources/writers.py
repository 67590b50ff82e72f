"""Writing data sets, sequences and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.lineage import cut


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, overwrite: bool = False) -> None:
    """The columns as CSV with a header; a path that exists is an error unless it is to be overwritten."""
    df.select(*(columns or df.columns)).write.mode("overwrite" if overwrite else "errorifexists").options(header=True, quote='"', escape='"').csv(path)


def write_sequence(df: DataFrame, path: str, keys: tuple[str, ...] = ("seq", "aug")) -> None:
    """A tree of data sets, one folder for each value of the keys; only the folders of df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Rows added to what is there."""
    df.write.mode("append").parquet(path)


def write_epochs(df: DataFrame, path: str) -> None:
    """Training dynamics as JSON lines, one folder for each epoch."""
    df.write.mode("overwrite").partitionBy("epoch").json(path)


def write_predictions(df: DataFrame, path: str, keys: tuple[str, ...] = ("aug", "seq", "seed")) -> None:
    """Logits and labels of runs, one folder for each run; only the runs of df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_artifact(df: DataFrame, path: str, name: str, version: int) -> None:
    """A version of a named data set with a manifest row; an empty one is refused, and a version is never replaced."""
    df = cut(df)  # read twice
    if df.isEmpty():
        raise ValueError(f"{name} has no rows")
    df.write.mode("errorifexists").parquet(f"{path}/{name}/v{version}")
    rows = df.sparkSession.read.parquet(f"{path}/{name}/v{version}").agg(F.count("*").alias("rows"))
    rows.select(F.lit(name).alias("name"), F.lit(version).alias("version"), "rows").write.mode("append").json(f"{path}/manifest")


def write_splits(df: DataFrame, path: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> None:
    """The same rows in every split; df is computed once."""
    df = cut(df)
    for s in splits:
        df.write.mode("overwrite").parquet(f"{path}/{s}")
