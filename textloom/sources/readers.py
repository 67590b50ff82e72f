"""Reading the files that data sets, runs and predictions come in, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: What a CSV cell means null with.
NULLS = ("", "NA", "nan", "NaN", "null", "None")


def _nulls(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.when(~F.col(f.name).isin(*NULLS), F.col(f.name)) for f in df.schema.fields if f.dataType.simpleString() == "string"})


def delimited(spark: SparkSession, path: str | list[str], schema: StructType | str, sep: str = ",", tolerant: bool = False, recursive: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a header and quoted cells; NULLS become null.

    multi_line: cells may hold line breaks, which makes each file one task's work; without it files are split.

    tolerant: lines that don't fit are dropped instead of giving nulls. recursive: all files below the path."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = StructType([*schema.fields, StructField("_bad", StringType())]) if tolerant else schema
    r = spark.read.schema(wide).options(header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, columnNameOfCorruptRecord="_bad")
    df = r.option("recursiveFileLookup", recursive).csv(path)
    if tolerant:  # every column is read, so that a line is judged by all its cells even for a count
        df = df.where(F.col("_bad").isNull() & (F.length(F.concat_ws("", *[F.col(c).cast("string") for c in schema.names])) >= 0)).drop("_bad")
    return _nulls(df)


def by_extension(spark: SparkSession, folder: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """All .csv and .tsv files of a folder, each with its own delimiter, with the file they came from; see delimited."""
    out = None
    for ext, sep in (("csv", ","), ("tsv", "\t")):
        one = spark.read.schema(schema).options(header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, pathGlobFilter=f"*.{ext}", recursiveFileLookup=True)
        one = one.csv(folder).withColumn("file", F.col("_metadata.file_name"))
        out = one if out is None else out.unionByName(one)
    return _nulls(out)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON file that holds one list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON objects, one a line; a malformed line gives nulls."""
    return spark.read.schema(schema).json(path)


def isolated(spark: SparkSession, folder: str, schema: StructType | str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(rows, failed): the rows of the files of a folder that fit the schema, with their file, and of each file that has lines
    which don't its name and how many. A broken file never spoils the others; its good lines are kept."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    r = spark.read.schema(wide).options(header=True, sep=sep, quote='"', escape='"', columnNameOfCorruptRecord="_bad", recursiveFileLookup=True)
    df = r.csv(folder).withColumn("file", F.col("_metadata.file_name"))
    df = df.where(F.length(F.concat_ws("", *[F.col(c).cast("string") for c in schema.names])) >= 0)  # every column is read
    bad = df.where("_bad IS NOT NULL").groupBy("file").agg(F.count("*").alias("lines"))
    return _nulls(df.where("_bad IS NULL").drop("_bad")), bad


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text): each text file of a folder whole, as prompt templates are kept."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(category, name, features) of a JSON file {category: {name: [feature, ...]}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    return raw.select(F.explode("m").alias("category", "x")).select("category", F.explode("x").alias("name", "features"))


def splits(spark: SparkSession, paths: dict[str, str], schema: StructType | str) -> DataFrame:
    """One table of the CSV files of several splits, with the column split."""
    out = None
    for name, path in paths.items():
        one = delimited(spark, path, schema).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def sequence_files(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All seq_I_real_N_aug_J.csv below a folder with their keys seq, base and aug; other files are left out."""
    from textloom.operators.corpus import sequence_file

    df = by_extension(spark, folder, schema).withColumn("_k", sequence_file(F.col("file"))).where("_k IS NOT NULL")
    return df.select("*", "_k.seq", "_k.base", "_k.aug").drop("_k")


def arrays(spark: SparkSession, folder: str, column: str = "values") -> DataFrame:
    """(file, row_id, values): the rows of all .npy files of a folder, read by the tasks as binary files.

    A file is one task's work, as the format can't be split; convert large ones to Parquet once."""
    import pandas as pd

    def load(batches):
        import io

        import numpy as np

        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(float)
                yield pd.DataFrame({"file": name, "row_id": range(len(a)), column: list(a)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    return files.select(F.col("_metadata.file_name").alias("file"), "content").mapInPandas(load, f"file string, row_id long, `{column}` array<double>")


def run_catalogue(runs: DataFrame, group: str | None = None, state: str | None = "finished", names: list[str] | None = None) -> DataFrame:
    """Runs of a group, state and list of names, the first of each (seq, aug, seed) by its creation."""
    cond: Column = F.lit(True)
    for column, value in (("grp", group), ("state", state)):
        cond = cond & (F.col(column) == value) if value is not None else cond
    cond = cond & F.col("name").isin(*names) if names is not None else cond
    from textloom.operators.curate import dedup_first

    return dedup_first(runs.where(cond), ["seq", "aug", "seed"], ["created", "name"])
