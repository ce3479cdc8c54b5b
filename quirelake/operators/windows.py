"""Sequential computations as window expressions, and range lookups.

Every window is partitioned by a document, chapter or conversation; where an
order over a whole table is asked for, it is computed per part and put
together with the parts' sums (``running_total``), so no single task sorts all
rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes or characters that one reading position covers.
POSITION = 512


def positions(length: Column, per: int = POSITION) -> Column:
    return F.greatest(F.lit(1), F.ceil(length / per)).cast("long")


def before(keys: Sequence, order: Sequence):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: Sequence, order: Sequence):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def within_budget(df: DataFrame, keys: Sequence, order: Sequence, text: str, budget: int, mark: str = "…") -> DataFrame:
    """Rows while their texts fit in budget characters by key; the last is cut and marked."""
    used = F.coalesce(F.sum(F.length(text)).over(before(keys, order)), F.lit(0))
    rows = df.withColumn("_used", used).where(F.col("_used") < budget)
    room = (F.lit(budget) - F.col("_used")).cast("int")
    cut = F.when(F.length(text) > room, F.concat(F.substring(F.col(text), F.lit(1), room), F.lit(mark))).otherwise(F.col(text))
    return rows.withColumn(text, cut).drop("_used")


def islands(df: DataFrame, keys: Sequence, order: Sequence, starts: Column, name: str = "island") -> DataFrame:
    """Number the runs that begin at rows where starts holds; rows before the first start join it."""
    run = F.sum(starts.cast("int")).over(upto(keys, order))
    return df.withColumn(name, F.greatest(F.lit(1), F.coalesce(run, F.lit(0))))


def merge_runs(df: DataFrame, keys: Sequence, start: str, end: str, gap: int, least: int) -> DataFrame:
    """Intervals of at least ``least``, after those with gaps of at most ``gap`` between them became one."""
    reach = F.max(end).over(before(keys, [start, end]))
    marked = islands(df, keys, [start, end], reach.isNull() | (F.col(start) - reach > gap), "_run")
    merged = marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
    return merged.where(F.col(end) - F.col(start) >= least)


def running_total(df: DataFrame, order: str, value: str, parts: int = 64, name: str = "before") -> DataFrame:
    """The sum of value over all rows that come earlier in the numeric column order, without a window over the whole table.

    Bounds of parts are estimated once and become literals, so every reader of
    a row finds the same part; a window runs inside a part, and one row for
    each part carries the sums of the parts before. Rows without an order come first."""
    bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts)))  # parts numbers at most
    part = F.when(F.col(order).isNull(), -1).otherwise(sum((F.col(order) > b).cast("int") for b in bounds) if bounds else F.lit(0))
    ranged = df.withColumn("_part", part)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    inside = F.coalesce(F.sum(value).over(before(["_part"], [order])), F.lit(0))
    # starts: a row for each part
    return ranged.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_base", "_in")


def last_at_or_before(points: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """For each row of targets (keys, at) the value of the last point at or before it: one sort of both together."""
    both = points.select(*keys, at, F.lit(0).alias("_kind"), F.col(value).alias("_v"), F.lit(None).cast("long").alias("_id")).union(
        targets.select(*keys, at, F.lit(1).alias("_kind"), F.lit(None).cast(points.schema[value].dataType).alias("_v"), F.col("target_id").alias("_id"))
    )
    last = F.last("_v", ignorenulls=True).over(upto(keys, [at, "_kind", "_id"]))
    return both.withColumn(value, last).where("_kind = 1").select(*keys, F.col("_id").alias("target_id"), at, value)
