"""Operator 2: mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order drawn by hash, are cut into blocks of
about BLOCK_BYTES. The ideal mix is fluid: all sources that have blocks left
run side by side in the ratio of their weights, and one that runs out leaves
its share to the others. Block i of a source (from 1) is released when the
ideal has given the source i - 1 blocks, and due when it has given it i, both
rounded outwards to whole slots; earliest deadline first gives every slot to
one block. The ideal itself fits each block between its two times, so unit
blocks can all be on time, and then are: at every slot, from the first to the
last, each source is less than a block away from the ideal. Times are exact.

No document is dropped or repeated. What reaches the driver is one row for
each source; it schedules a slot for each block: 4000 for a GB, and BLOCKS at
most for any size, as blocks of more than 256 GiB in all grow with the
documents.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, sized, written

BLOCK_BYTES = 256 * 1024
#: Blocks of the whole mix, about: beyond, blocks grow with the documents, so that the driver's schedule doesn't.
BLOCKS = 1 << 20
#: Blocks of a source in a row of the schedule.
FRAME = 256
#: Rows that a part of a source holds: parts are numbered on their own, so a hot source is no single task.
PART_ROWS = 4096
#: Weight of a source without a given one: its bytes to this power.
POWER = 0.5


def whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly the same ratio."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * common) for s, x in exact.items()}


class Ideal:
    """The fluid mix: when has a source got its first i blocks?

    While the sum of the shares of those that run is W, a source with share w
    gets w / W of each slot. All that run are at the same i / w; a source
    leaves when its blocks / w are reached."""

    def __init__(self, blocks: dict[str, int], shares: dict[str, int]):
        self.shares = shares
        leave = sorted((Fraction(n, shares[s]), n, shares[s]) for s, n in blocks.items() if n)
        self.at, self.near = [x for x, _, _ in leave], [float(x) for x, _, _ in leave]
        self.gone, self.running = [0], [sum(w for _, _, w in leave)]
        for _, n, w in leave:
            self.gone.append(self.gone[-1] + n)
            self.running.append(self.running[-1] - w)

    def time(self, source: str, i: int) -> tuple[int, int]:
        """The time at which source has got i blocks, as slots rounded down and up."""
        w = self.shares[source]
        k = bisect_left(self.near, i / w)
        while k < len(self.at) and self.at[k] * w < i:
            k += 1
        while k and self.at[k - 1] * w >= i:
            k -= 1
        whole, part = divmod(i * self.running[k], w)
        return self.gone[k] + whole, self.gone[k] + whole + bool(part)


def pfair(blocks: dict[str, int], weights: dict[str, float]) -> list[str]:
    """The source of each slot, by earliest deadline first among released blocks; ties by the sources' names."""
    ideal = Ideal(blocks, whole_shares({s: weights[s] for s, n in blocks.items() if n}))
    waiting = [(0, s, 1) for s, n in sorted(blocks.items()) if n]
    ready: list[tuple[int, str, int]] = []
    out: list[str] = []
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (ideal.time(s, i)[1], s, i))
        deadline, s, i = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline is missed")
        out.append(s)
        if i < blocks[s]:
            heapq.heappush(waiting, (ideal.time(s, i)[0], s, i + 1))
    return out


def mix(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, block, slot, seat, plus the columns in keep.

    slot orders the blocks of the mix, seat the documents in a block. A null
    source is a source of its own, "" included; a null or empty text takes one
    byte; rows without a doc_id sort as id null. Repeated rows each keep a
    place. A source without a weight gets its bytes to the power of POWER;
    weights must be positive; sources whose deadlines tie go by name. A very long text is longer than a block and moves
    whole, in the slot of the block it starts in. An empty table gives an empty
    result."""
    rows = docs.select("doc_id", "text", "source", *keep).withColumn("_key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))
    rows = rows.withColumn("_size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).drop("text")
    sizes = {r["_key"]: (r["n"], r["bytes"]) for r in rows.groupBy("_key").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes")).collect()}
    block_bytes = max(block_bytes, -(-sum(b for _, b in sizes.values()) // BLOCKS))
    parts = spark.createDataFrame([(k, max(1, -(-n // PART_ROWS))) for k, (n, _) in sorted(sizes.items())], "_key string, _parts long")
    place = F.xxhash64(F.lit(2), "doc_id", "_size")
    rows = rows.join(sized(parts, len(sizes)), "_key").withColumn("_part", F.pmod(F.xxhash64("doc_id", "_size"), "_parts").cast("int")).drop("_parts")
    by_part = rows.groupBy("_key", "_part").agg(F.sum("_size").alias("bytes"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(spark, by_part.select("_key", "_part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_start")), "parts")
    inside = Window.partitionBy("_key", "_part").orderBy(place, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sized(starts), ["_key", "_part"]).withColumn("_at", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = placed.withColumn("block", F.floor(F.col("_at") / block_bytes).cast("long"))

    names = {k: (None if k == "n" else k[1:]) for k in sizes}
    blocks = {k: -(-b // block_bytes) for k, (_, b) in sizes.items()}
    wanted = {k: (weights or {}).get(names[k], sizes[k][1] ** POWER) for k in sizes}
    if any(w <= 0 for w in wanted.values()):
        raise ValueError("weights must be positive")
    slots: dict[str, list[int]] = {k: [] for k in blocks}
    for at, k in enumerate(pfair(blocks, wanted)):
        slots[k].append(at)
    # a row for FRAME blocks of a source
    plan = [(k, i // FRAME, at[i : i + FRAME]) for k, at in slots.items() for i in range(0, len(at), FRAME)]
    table = spark.createDataFrame(plan, "_key string, _frame long, _slots array<long>")
    out = placed.withColumn("_frame", F.floor(F.col("block") / FRAME).cast("long")).join(sized(table, sum(blocks.values())), ["_key", "_frame"])
    slot = F.element_at("_slots", (F.col("block") % FRAME + 1).cast("int"))
    return out.select("doc_id", "source", "block", slot.cast("long").alias("slot"), F.col("_at").alias("seat"), *keep)


def mixed(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows and columns of docs, dealt and sorted in the order of the mix."""
    clear = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    got = mix(spark, clear, weights, keep=("_row",))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return got.repartitionByRange(n, "slot", "seat").sortWithinPartitions("slot", "seat").select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
