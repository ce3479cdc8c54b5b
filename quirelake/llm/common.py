"""Shared plumbing of the training-data operators: the shared folder, written
intermediate tables, size-checked joins and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..batches import small_batches  # noqa: F401  the operators take it from here

#: Rows of a narrow (at most about 48 bytes a row) table up to which it is broadcast;
#: above, the same join shuffles both sides.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves in local mode (driver and
    executors are one process) and the warehouse on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="quirelake-")
            spark.conf.set("spark.checkpoint.dir", folder)
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quirelake/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting has the value within."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, so that
    a lost executor costs a re-read instead of a recomputation. The write's
    shuffle files go when it ends, as nothing reads them again."""
    path = scratch(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``written`` wrote and that no later plan reads."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/quirelake/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has at most BROADCAST_ROWS rows, else df."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def joined_by_count(left: DataFrame, right: DataFrame, key: str, total: int, rows: int = 1000) -> DataFrame:
    """left joined with right by key, of which right has each value once, with n, how many of left's total rows it has.

    Keys with more than a rows-th of them, of which there are at most so many,
    are broadcast; left's other rows are shuffled, and none of their keys is hot."""
    hot = right.where(F.col("n") > total // rows)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).union(rest.join(right.where(F.col("n") <= total // rows), key))


def lowest_by_hash(df: DataFrame, key: str, n: int, by: str | None = None) -> DataFrame:
    """A fixed sample: the n rows with the least hashes of key, of each value of by if given.

    Rows whose hash can't be among the n least, by four times the share that
    n is of the count, are left out where they are read; so what is sorted and
    numbered stays about 4 n rows, however many tasks there are."""
    span = 1 << 40
    hashed = df.withColumn("_u", F.pmod(F.xxhash64(key), F.lit(span)))
    if by is None:
        total = df.count()
        return hashed.where(F.col("_u") <= span * min(1.0, 4 * n / max(total, 1))).orderBy("_u", key).limit(n).drop("_u")
    total = df.groupBy(by).agg(F.count("*").alias("_total"))
    few = hashed.join(sized(total), by).where(F.col("_u") <= F.least(F.lit(1.0), F.lit(4.0 * n) / F.col("_total")) * span)
    order = F.row_number().over(Window.partitionBy(by).orderBy("_u", key))
    return few.withColumn("_n", order).where(F.col("_n") <= n).drop("_u", "_n", "_total")


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in dropped(doc_id)."""
    return docs.join(sized(dropped.select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return joined_by_count(both, least, "a", 2 * n).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    near = joined_by_count(down, least, "a", n).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for each end of edges(a, b): the smallest id reachable.

    Alternating large-star and small-star rounds; each writes its edges to the
    shared folder. Nodes with very many edges are joined by broadcast. Only a row count and a checksum reach the driver."""
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        large = written(spark, _large_star(now, seen[0]), "large-star")
        now = written(spark, _small_star(large, seen[0]), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
