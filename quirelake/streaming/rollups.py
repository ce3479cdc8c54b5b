"""Structured Streaming: live queries, daily totals, windows and resumable batches.

Daily totals keep state by (day, key) and drop days behind the watermark; the
watermark, event-time windows and sessions are additions of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_totals(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """events(ts, keys, seconds) -> day, keys, seconds."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(day, *keys).agg(F.sum("seconds").alias("seconds")).select(F.to_date("window.start").alias("day"), *keys, "seconds")


def windowed(events: DataFrame, size: str, slide: str | None, keys: list[str], late: str) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str) -> DataFrame:
    """Runs of a key's events with gaps of less than gap; events that come later than late after the newest are left out."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", key, "n")


def write_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there and stop: each batch's rows in a folder of its own number, overwritten if the batch is run again: once each, whatever is lost."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drain(df: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """The state of an updating stream after all that is there: for each key the row of the last batch that changed it.

    Batches are files in path, not rows in the driver. An empty stream gives an empty table."""
    write_batches(df, path, checkpoint, "update")
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    others = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def live(events: DataFrame, table: DataFrame, key: str, checkpoint: str, out: str) -> StreamingQuery:
    """A view that is made anew with each change: every batch of changes joins the static table."""

    def put(batch: DataFrame, number: int) -> None:
        touched = batch.select(key).distinct()
        table.join(touched, key, "left_semi").write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
