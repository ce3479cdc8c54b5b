"""Sessions with the settings that the engine's results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session in UTC with adaptive execution; an existing one is reused."""
    builder = (
        SparkSession.builder.appName("quirelake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
    )
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
