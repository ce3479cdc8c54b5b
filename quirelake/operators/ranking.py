"""Orders, quotas and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key: an aggregate, so that rows combine before the shuffle."""
    names = [c for c in df.columns if c not in keys]
    marks = [F.col(o) if isinstance(o, str) else o for o in order]
    row = F.min_by(F.struct(*names), F.struct(*[m.alias(f"_{i}") for i, m in enumerate(marks)])).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(df.columns)


def cap_by(df: DataFrame, keys: Sequence, order: Sequence, most) -> DataFrame:
    """At most ``most`` rows (a number or a column; null: all) of each key, in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fits = F.col("_n") <= most
    return df.withColumn("_n", n).where(fits if isinstance(most, int) else F.coalesce(fits, F.lit(True))).drop("_n")


def mixed_quota(online: DataFrame, local: DataFrame, total: int, least: int, most: int) -> DataFrame:
    """The best of both: most online rows at most, local ones fill up to total (least online places are kept if there is any)."""
    order = [F.desc("score"), "id"]
    best = online.orderBy(*order).limit(most)
    n = best.count()
    places = 0 if not n else max(least, min(most, n))
    return best.withColumn("origin", F.lit("online")).unionByName(local.orderBy(*order).limit(total - places).withColumn("origin", F.lit("local")))


def _uniform(key: str, seed: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, in proportion to positive weights: the least of exponential keys -ln(u) / w."""
    return df.where(F.col(weight) > 0).orderBy(-F.log(_uniform(key, seed)) / F.col(weight), key).limit(n)
