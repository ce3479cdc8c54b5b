"""Operator 4: exact duplicates through immutable snapshots.

Documents that came before form an immutable snapshot: a table of distinct
digests in hash buckets and, for each bucket, a static binary-fuse filter.
An incoming batch is grouped by digest on its own; its distinct digests are
screened by the filters, and only positives meet the snapshot's buckets in an
exact join. Digests that occur more than once are then grouped again by the
bytes of their texts, so that no hash decides that texts are equal. Texts move
only for such digests, and copies are combined before they move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sized, without_ids, written

#: Digests that one filter (one bucket of the snapshot) is meant to hold.
BUCKET = 100_000
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class BinaryFuse:
    """A 3-wise binary-fuse filter with 16-bit fingerprints over 64-bit digests.

    It has no false negatives and about one false positive in 65,536. Keys are
    peeled in rounds: all slots that one key alone maps to are peeled together,
    and fingerprints are set round by round from the last to the first."""

    def __init__(self, seed: int, segment: int, length: int, prints: np.ndarray):
        self.seed, self.segment, self.length, self.prints = seed, segment, length, prints

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys.astype("u8") + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))

    @classmethod
    def _slots(cls, h: np.ndarray, segment: int, length: int) -> np.ndarray:
        start = ((h >> np.uint64(32)) * np.uint64(length - 2)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        base = start * np.uint64(segment)
        return np.stack([base + (h & mask), base + np.uint64(segment) + ((h >> np.uint64(18)) & mask), base + np.uint64(2 * segment) + ((h >> np.uint64(9)) & mask)]).astype("i8")

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(29))).astype("u2")

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, dtype="u8"))
        n = len(keys)
        segment = min(1 << 16, 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 32
        length = max(3, -(-size // segment) + 2)
        for seed in range(1, 200):
            if seed % 20 == 0:
                length += length // 8 + 1
            h = cls._mix(keys, seed)
            slots = cls._slots(h, segment, length)
            rounds = cls._peel(slots, segment * length)
            if rounds is not None:
                prints = np.zeros(segment * length, "u2")
                mark = cls._print(h)
                for who, where in reversed(rounds):
                    # the slot itself still holds 0, so all three can be taken
                    prints[where] = mark[who] ^ prints[slots[0, who]] ^ prints[slots[1, who]] ^ prints[slots[2, who]]
                return cls(seed, segment, length, prints)
        raise ValueError("no seed gives a filter")

    @staticmethod
    def _peel(slots: np.ndarray, size: int):
        n = slots.shape[1]
        count = np.bincount(slots.reshape(-1), minlength=size)
        owner = np.zeros(size, "i8")  # xor of the keys at a slot
        numbers = np.arange(n)
        for row in slots:
            np.bitwise_xor.at(owner, row, numbers)
        rounds, left = [], n
        ready = np.flatnonzero(count == 1)
        while left:
            ready = ready[count[ready] == 1]
            if not len(ready):
                return None
            who, first = np.unique(owner[ready], return_index=True)
            where = ready[first]
            rounds.append((who, where))
            left -= len(who)
            touched = slots[:, who]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, who)
            ready = np.unique(touched)
        return rounds

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], "u8"))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = self._mix(np.asarray(keys, dtype="u8"), self.seed)
        a, b, c = self._slots(h, self.segment, self.length)
        return self._print(h) == self.prints[a] ^ self.prints[b] ^ self.prints[c]

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.length], "<u4").tobytes() + self.prints.astype("<u2").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> BinaryFuse:
        seed, segment, length = np.frombuffer(raw[:12], "<u4").tolist()
        return cls(seed, segment, length, np.frombuffer(raw[12:], "<u2"))


def _build(group: pa.Table) -> pa.Table:
    keys = group["h64"].to_numpy().view("u8")
    return pa.table({"bucket": pa.array([group["bucket"][0].as_py()], pa.int32()), "filter": pa.array([BinaryFuse.build(keys).dump()], pa.binary())})


def _screen(key, digests: pa.Table, filters: pa.Table) -> pa.Table:
    if not digests.num_rows or not filters.num_rows:
        return digests.slice(0, 0).select(["h64", "sha", "keep", "n"])
    fuse = BinaryFuse.load(filters["filter"][0].as_py())
    return digests.filter(pa.array(fuse.has(digests["h64"].to_numpy().view("u8")))).select(["h64", "sha", "keep", "n"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, sha (SHA-256 of the normalised text), h64 for each row of docs."""
    text = normalised(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha")).withColumn("h64", F.xxhash64("sha"))


def snapshot(spark: SparkSession, rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The immutable snapshot of digest rows: distinct digests (h64, sha, keep, n, bucket) and their filters (bucket, filter)."""
    table = rows.groupBy("h64", "sha").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))
    table = written(spark, table.withColumn("bucket", F.pmod("h64", F.lit(buckets)).cast("int")), "snapshot")
    filters = table.select("h64", "bucket").groupBy("bucket").applyInArrow(_build, "bucket int, filter binary")
    return table, written(spark, filters, "filters")


def ingest(spark: SparkSession, known: tuple[DataFrame, DataFrame], batch: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests of the batch (h64, sha, keep, n), with old_keep and old_n where the snapshot holds them."""
    table, filters = known
    new = batch.groupBy("h64", "sha").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))
    new = written(spark, new, "batch")
    dealt = new.withColumn("bucket", F.pmod("h64", F.lit(buckets)).cast("int"))
    positive = dealt.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, "h64 long, sha binary, keep long, n long")
    held = positive.join(table.select("h64", "sha", F.col("keep").alias("old_keep"), F.col("n").alias("old_n")), ["h64", "sha"])
    return new.join(held.select("h64", "sha", "old_keep", "old_n"), ["h64", "sha"], "left")


def exact_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256, one row per document.

    Texts are equal when identical after each run of spaces, tabs and line
    breaks becomes one space; null counts as empty. The row with the smallest
    doc_id stays; rows without a doc_id come after all others and have
    keep_id null if none of the group has one. Rows that repeat the kept
    doc_id with the same text are all marked kept. Other columns are ignored;
    an empty table gives an empty result.

    The older half of the ids is the snapshot, the rest the incoming batch;
    any other division gives the same groups."""
    rows = written(spark, digests(docs), "digests")
    n, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    pivot = (low + high) // 2 if n and low is not None else 0
    buckets = max(1, -(-n // BUCKET))
    older = F.col("doc_id").isNotNull() & (F.col("doc_id") <= pivot)
    known = snapshot(spark, rows.where(older), buckets)
    new = ingest(spark, known, rows.where(~older), buckets)
    met = new.select("sha", F.least("keep", "old_keep").alias("keep"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"))
    alone = known[0].join(new.where("old_n is not null").select("sha"), "sha", "left_anti").select("sha", "keep", "n")
    several = written(spark, met.where("n > 1").union(alone.where("n > 1")), "repeated")

    # byte check: texts of repeated digests are grouped by their bytes
    texts = docs.select(normalised(F.col("text")).alias("norm")).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    repeated = sized(several.select("sha"))
    by_bytes = texts.join(repeated, "sha", "left_semi").groupBy("sha", "norm").agg(F.count("*").alias("n"))
    clash = by_bytes.groupBy("sha").count().where("count > 1").limit(1).count()
    if clash:
        raise ValueError("different texts share a SHA-256 digest")
    out = rows.join(sized(several), "sha", "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the copies; rows without a doc_id stay."""
    gone = exact_groups(spark, docs).where("not kept and doc_id is not null").select("doc_id")
    return without_ids(docs, written(spark, gone, "copies"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark, read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.n::BIGINT AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
