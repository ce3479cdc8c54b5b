"""Backups: a set of tables in a folder, with a manifest of their rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _safe(name: str) -> str:
    if not name or name.startswith((".", "/")) or "/" in name or "\\" in name:
        raise ValueError(f"a table's name can't be a path: {name}")
    return name


def back_up(spark: SparkSession, tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None) -> DataFrame:
    rows = []
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if (partition_by or {}).get(name):
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{folder}/{_safe(name)}")
        rows.append((name, spark.read.parquet(f"{folder}/{name}").count(), df.schema.json()))
    manifest = spark.createDataFrame(rows, "name string, n long, schema string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    out = {}
    for row in spark.read.schema("name string, n long, schema string").json(f"{folder}/manifest").collect():  # a row per table
        df = spark.read.parquet(f"{folder}/{_safe(row['name'])}")
        if df.count() != row["n"]:
            raise ValueError(f"{row['name']} doesn't hold {row['n']} rows")
        out[row["name"]] = df
    return out


def decoded_vectors(blobs: DataFrame, dim: str = "dim", blob: str = "vector") -> DataFrame:
    """Little-endian 32-bit floats as arrays, without Python: four bytes are read as sign, exponent and fraction."""
    at = F.sequence(F.lit(0), F.col(dim) - 1)
    word = F.transform(at, lambda i: _little(F.col(blob), i))
    return blobs.withColumn(blob, F.transform(word, _single))


def _little(blob, i):
    byte = lambda k: F.conv(F.hex(F.substring(blob, i * 4 + 1 + k, F.lit(1))), 16, 10).cast("long")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def _single(word):
    sign = F.when(word >= 2147483648, -1.0).otherwise(1.0)
    exponent = F.floor(word / 8388608).cast("long") % 256
    fraction = (word % 8388608).cast("double")
    value = F.when(exponent == 0, fraction * 2.0**-149).otherwise((1 + fraction / 8388608) * F.pow(F.lit(2.0), (exponent - 127).cast("double")))
    return (sign * value).cast("float")
