"""Windowed aggregates over an unbounded table of events, by Structured Streaming.

The same function serves a finite table: on it watermarks do nothing and the result is the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as they appear, with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def windowed(events: DataFrame, time: str, width: str, aggregates: list[Column], keys: list[str] = (), slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Aggregates by event-time window and keys; rows later than ``late`` may be left out of a stream."""
    window = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(time, late)
    return timed.groupBy(window.alias("window"), *keys).agg(*aggregates)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there to Parquet, exactly once, and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
