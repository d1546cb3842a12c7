"""Sessions with the settings that the engine's semantics and plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Checked arithmetic, UTC, adaptive plans and run-time Bloom filters.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "larkspur", cores: int | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session; with `cores` a local one (driver memory 8 GB), else on the master that spark-submit names.

    `shuffle_partitions` is where adaptive execution begins to coalesce: on a cluster give it two to four times the cores,
    and enough that a partition of the largest exchange (input over partitions) fits in a task's memory.
    """
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
