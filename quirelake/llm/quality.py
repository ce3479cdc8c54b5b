"""Operator 5: quality by importance resampling.

Hashed n-gram generative models (words and pairs of words over BUCKETS
buckets) are counted for target text (documents labelled good) and for the raw
corpus (all documents). A document's importance is the logarithm of the ratio
of its likelihoods. Resampling without replacement draws the documents with
the k largest keys, importance plus Gumbel noise hashed from the doc_id.

Texts are counted in numpy over bytes, without a Python object for each word;
a task yields one count vector. The k-th largest key is found by counting
digits of its bits, 16 at a time, so no key is gathered or sorted in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest_by_hash, read, small_batches, written
from .words import ODD, WHITE_SPACE, word_hashes

BUCKETS = 1 << 14
#: Labelled good documents that the target model is counted from, at most.
TARGET_DOCS = 20_000
SEED = 5
#: Bytes of text turned into arrays at once.
SLICE = 1 << 20
def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document's number, bucket) for each word and pair of adjacent words of the texts."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", "u1")
    bounds = np.cumsum([len(t) + 1 for t in texts])
    words, at = word_hashes(joined, WHITE_SPACE)
    doc = np.searchsorted(bounds, at, side="right")
    with np.errstate(over="ignore"):
        pair = (words[:-1] * np.uint64(3)) ^ (words[1:] * ODD)
        pair ^= pair >> np.uint64(29)
    same = doc[:-1] == doc[1:] if len(doc) else np.array([], bool)
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([doc, doc[:-1][same]]), np.concatenate([words & mask, pair[same] & mask]).astype("i8")


def slices(texts):
    """Runs of texts of about SLICE bytes: (first number, texts)."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        run.append(t)
        size += len(t)
        if size >= SLICE:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def _bytes(column) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _count(batches):
    raw, target = np.zeros(BUCKETS, "i8"), np.zeros(BUCKETS, "i8")
    for batch in batches:
        good = np.array(batch.column("good").to_pylist(), bool)
        for first, run in slices(_bytes(batch.column("text"))):
            doc, bucket = features(run)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[first + doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _weigh(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, texts in slices(_bytes(batch.column("text"))):
                doc, bucket = features(texts)
                out[first : first + len(texts)] = np.bincount(doc, weights=ratio[bucket], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "log_weight"])

    return run


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest value of the long column key: counts by 16 bits at a time."""
    high = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift) - F.lit(high << 16) if shift != 48 else F.shiftright("key", 48)
        rows = keys if shift == 48 else keys.where(F.shiftright("key", shift + 16) == F.lit(high))
        counts = {r["digit"]: r["count"] for r in rows.select(digit.alias("digit")).groupBy("digit").count().collect()}  # 65,536 at most
        for d in sorted(counts, reverse=True):
            if k <= counts[d]:
                high = d if shift == 48 else (high << 16) + d
                break
            k -= counts[d]
    return high


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, log_weight, gumbel_key, kept.

    share is the part of the documents drawn; by default the part of good ones
    among the labelled. Null and empty texts have log_weight 0, like a text
    that is as likely under both models. Ties at the last key are all kept;
    repeated rows share their noise. With no good label all weights are 0.
    Other columns are ignored; an empty table gives an empty result."""
    small_batches(spark)
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values())) if share is None else share
    good = written(spark, lowest_by_hash(known.where("quality = 1"), "doc_id", TARGET_DOCS).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("good")), "good")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = rows.join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))  # good: TARGET_DOCS rows at most
    counts = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if n.get(1) else np.zeros(BUCKETS)
    weighed = rows.mapInArrow(_weigh(ratio), "doc_id long, log_weight double")
    u = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = written(spark, weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "keys")
    total = keyed.count()
    k = round(share * total)
    if k <= 0 or k >= total:
        return keyed.withColumn("kept", F.lit(k > 0))
    last = kth_largest(keyed.select((F.floor(F.col("gumbel_key") * float(1 << 32))).cast("long").alias("key")), k)
    return keyed.withColumn("kept", F.floor(F.col("gumbel_key") * float(1 << 32)).cast("long") >= F.lit(last))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
