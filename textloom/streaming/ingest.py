"""Texts that arrive while they are generated: validation, deduplication and appending in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def valid_texts(stream: DataFrame, least: int = 10) -> DataFrame:
    """Rows whose Text has at least ``least`` characters, no line break and no lone capital between spaces."""
    return stream.where((F.length("Text") >= least) & ~F.contains("Text", F.lit("\n")) & ~F.col("Text").rlike(r"\s[A-Z]\s"))


def first_seen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once; the state of a key is dropped once the watermark has passed it by ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, width: str, delay: str, by: str) -> DataFrame:
    """(start, end, by, n) of each tumbling window, given out once it is closed."""
    c = stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return c.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all rows that are there now to Parquet files, exactly once over restarts, and end."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
