"""Counts of events by time, for a table or a stream of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def counts_by_window(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, event_type, n of every window of event time; over a stream, `late` is how far events may lag behind."""
    if late is not None:
        events = events.withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
