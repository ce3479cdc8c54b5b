"""Rights that are used up: copies and prints left of a licence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def use_up(licences: DataFrame, uses: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """licences(id, column) after uses(id, n), and which uses were granted.

    A null amount is without limit; a use over what is left is refused whole
    and takes nothing. One use of a licence in each call; repeated ones add up."""
    asked = uses.groupBy("id").agg(F.sum("n").alias("_n"))
    both = licences.join(asked, "id", "left")
    ok = F.col(column).isNull() | (F.col("_n") <= F.col(column))
    left = both.withColumn(column, F.when(F.col("_n").isNotNull() & ok, F.col(column) - F.col("_n")).otherwise(F.col(column))).select(licences.columns)
    granted = asked.join(licences.select("id", column), "id").select("id", F.col("_n").alias("n"), ok.alias("granted"))
    return left, granted


def by_user(licences: DataFrame, user: str) -> DataFrame:
    return licences.where(F.col("user") == user)


def passphrases(licences: DataFrame, provider: str | None = None) -> DataFrame:
    rows = licences if provider is None else licences.where(F.col("provider") == provider)
    return rows.select("passphrase").where("passphrase is not null").distinct()
