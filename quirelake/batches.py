"""Bounds of what Spark hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes in one Arrow batch handed to Python: a batch ends at the row that reaches them.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch; the bound stays with the session, as plans are run after they are made."""
    bound = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b")
    if not bound.isdigit() or not 0 < int(bound) <= ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
