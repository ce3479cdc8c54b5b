"""Operator 1: near-duplicate vectors by random-hyperplane sign hashing.

Vectors are hashed by the signs of their products with random hyperplanes, in
several tables. All pairs that share a bucket in any table are verified by
cosine in double precision, block by block as matrix products; a pair counts
in the first table in which it meets, so that counts need no pair rows.
The number of bits follows log2 of the number of vectors (buckets keep their
size as the input grows), and the number of tables follows from the bits: a
pair at exactly the threshold is missed with probability MISS at most.

Large buckets are cut into blocks; each pair of blocks is its own group, so no
task holds more than two blocks. Links leave a task as counts by vector and as
one edge from each vector to the least vector of its cluster in the block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, read, sized, written

THRESHOLD = 0.95
MISS = 1e-6
#: Rows that a bucket of unrelated vectors is meant to hold, and rows of a block.
OCCUPANCY, BLOCK = 256, 1024
SEED = 20_231


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / OCCUPANCY))) if n > OCCUPANCY else 4
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _hasher(bits: int, tables: int, kind: str):
    """kind: bytes of a vector's component, as numpy names it. Arrow batches (vec_id, weight, embedding) -> a row per vector and table."""
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(rows["embedding"]):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                vectors = np.array([rows["embedding"][i] for i in at], dtype="<f8")
                signs = (vectors @ _planes(dim, bits, tables)) > 0
                codes = signs.reshape(len(at), tables, bits) @ powers
                n = len(at)
                ids = np.repeat(np.array([rows["vec_id"][i] for i in at], dtype="i8"), tables)
                weights = np.repeat(np.array([rows["weight"][i] for i in at], dtype="i8"), tables)
                raw = [v.tobytes() for v in vectors.astype(kind)]
                packed = [c.astype("<u4").tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(tables, dtype="i4"), n)),
                        pa.array(np.full(n * tables, dim, dtype="i4")),
                        pa.array(codes.reshape(-1)),
                        pa.array(ids),
                        pa.array(weights),
                        pa.array([r for r in raw for _ in range(tables)], pa.binary()),
                        pa.array([p for p in packed for _ in range(tables)], pa.binary()),
                    ],
                    ["t", "dim", "code", "vec_id", "weight", "vec", "codes"],
                )

    return run


_HASHED = "t int, dim int, code long, vec_id long, weight long, vec binary, codes binary"


def _verifier(threshold: float, kind: str):
    """One group: a bucket, or two blocks of a large bucket."""

    def run(group: pa.Table) -> pa.Table:
        n, t = group.num_rows, group["t"][0].as_py()
        ids, weights = group["vec_id"].to_numpy(), group["weight"].to_numpy()
        block = group["block"].to_numpy()
        vectors = np.frombuffer(b"".join(group["vec"].to_pylist()), kind).reshape(n, -1).astype("f8")
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        codes = np.frombuffer(b"".join(group["codes"].to_pylist()), "<u4").reshape(n, -1)[:, :t]
        across = group["lo"][0].as_py() != group["hi"][0].as_py()
        linked = np.zeros((n, n), bool)
        counts = np.zeros(n, "i8")
        for a in range(0, n, 256):
            near = unit[a : a + 256] @ unit.T >= threshold
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            if across:
                near &= block[a : a + 256, None] != block[None, :]
            linked[a : a + 256] = near
            i, j = np.nonzero(near)
            for s in range(0, len(i), 100_000):
                x, y = i[s : s + 100_000] + a, j[s : s + 100_000]
                new = ~(codes[x] == codes[y]).any(axis=1)
                np.add.at(counts, x[new], weights[y[new]])
        label = np.arange(n)
        while True:
            near = np.where(linked, label[None, :], n).min(axis=1)
            new = np.minimum(label, near)
            new = new[new]
            if (new == label).all():
                break
            label = new
        # the representative of a cluster is its least id, so that edges point down
        least = np.full(n, np.iinfo("i8").max)
        np.minimum.at(least, label, ids)
        out = linked.any(axis=1)
        return pa.table({"vec_id": ids[out], "links": counts[out], "root": least[label][out]}, schema=pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept.

    A vector that is null, empty or all zero, or holds a null, NaN or infinity,
    has no link and is its own component; so has a row without a vec_id.
    Vectors of different length never link. Repeated rows are vectors of their
    own and link with each other; rows that share a vec_id but not the vector
    form one node (their links add up). An empty table gives an empty result.
    Other columns are ignored."""
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    distinct = rows.where("fit").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    distinct = written(spark, distinct, "vectors")
    n = distinct.count()
    bits, tables = plan(n, threshold, miss)
    hashed = distinct.select("vec_id", "weight", "embedding").mapInArrow(_hasher(bits, tables, kind), _HASHED)

    large = hashed.groupBy("t", "dim", "code").count().where(F.col("count") > 2 * BLOCK).select("t", "dim", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = written(spark, large, "large-buckets")
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    dealt = (
        hashed.join(sized(large), ["t", "dim", "code"], "left")
        .withColumn("block", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(own))
        .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .select("t", "dim", "code", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "vec_id", "weight", "vec", "codes")
    )
    found = written(spark, dealt.groupBy("t", "dim", "code", "lo", "hi").applyInArrow(_verifier(threshold, kind), "vec_id long, links long, root long"), "links")

    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    members = connected_components(spark, found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    copies = distinct.where("weight > 1").select("embedding", F.col("vec_id").alias("rep"), "weight")
    one = rows.where("fit").join(copies, "embedding", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce(F.col("weight") - 1, F.lit(0)).alias("copies"))
    stats = counts.join(members.withColumnRenamed("node", "vec_id"), "vec_id", "full").select(F.col("vec_id").alias("rep"), "links", "component")
    result = one.join(stats, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies")).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE
ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(node, root) AS (
  SELECT vec_id, vec_id FROM ok
  UNION
  SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node WHERE r.root < p.b),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.root, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN deg d ON d.a = e.vec_id LEFT JOIN comp c ON c.node = e.vec_id
"""
