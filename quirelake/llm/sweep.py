"""Operator 13: peak concurrency sweep.

Starts and ends of intervals become deltas; equal moments of a group are
summed before anything is ordered. The deltas are dealt by ranges of (group,
moment) and sorted. Pass one writes them as segments, each with what the rows
of its group before it in the same range add up to, and collects one row for
each range and group: its sums and its prefix maxima. The driver scans these
into carries and broadcasts them; there are at most as many as ranges and
groups. Pass two adds the carry to numpy's running sums of each segment.

A segment is one row, so it doesn't matter how pass two's scan splits files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written

#: Moments in a segment.
SEGMENT = 8192
#: The group that holds all rows, and that of rows without a group.
ALL, UNKNOWN = -2, -1
#: Days that a sale stays open after its first shipment.
OPEN_DAYS = 7
#: A key with more than this share of the rows is joined by broadcast: there are at most HOT_KEYS.
HOT_KEYS = 1000

_SEGMENT = "part int, nation_id int, first_s long, next_s long, sum_n long, sum_c long, top_n long, top_c long, before_n long, before_c long, before_top long, at array<long>, dn array<long>, dc array<long>"
_ROW = "nation_id int, from_s long, to_s long, n_open long, open_cents long, high_open long, is_peak boolean"
_LOW = -(1 << 62)


def minute(c: str | F.Column) -> F.Column:
    """UTC seconds since 1970 of a timestamp's fields, rounded down to the minute; needs no zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _segments(batches):
    """Pass one: a range's sorted deltas as segments, each with what stands before it in the range."""
    part, schema = TaskContext.get().partitionId(), _arrow(_SEGMENT)
    held: dict | None = None  # waits for the moment after it
    nation, sum_n, sum_c, top = None, 0, 0, _LOW

    def out(next_s):
        lists = {k: [held[k]] for k in ("at", "dn", "dc")}
        return pa.RecordBatch.from_pydict({k: [v] for k, v in held.items() if k not in lists} | lists | {"next_s": [next_s]}, schema=pa.schema([schema.field(n) for n in schema.names])).select(schema.names)

    for batch in batches:
        group, at, dn, dc = (batch.column(c).to_numpy() for c in ("nation_id", "from_s", "dn", "dc"))
        cuts = {0, len(at), *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), *range(0, len(at), SEGMENT)}
        cuts = sorted(cuts)
        for a, b in zip(cuts, cuts[1:]):
            g = int(group[a])
            if held is not None:
                yield out(int(at[a]) if g == nation else None)
            if g != nation:
                nation, sum_n, sum_c, top = g, 0, 0, _LOW
            run_n, run_c = np.cumsum(dn[a:b]), np.cumsum(dc[a:b])
            held = {"part": part, "nation_id": g, "first_s": int(at[a]), "sum_n": int(run_n[-1]), "sum_c": int(run_c[-1]), "top_n": int(run_n.max()), "top_c": int(run_c.max()), "before_n": sum_n, "before_c": sum_c, "before_top": top, "at": at[a:b], "dn": dn[a:b], "dc": dc[a:b]}
            top = max(top, sum_n + held["top_n"])
            sum_n, sum_c = sum_n + held["sum_n"], sum_c + held["sum_c"]
    if held is not None:
        yield out(None)


def carries(ranges: list[tuple]) -> list[tuple]:
    """(part, nation, first_s, sum_n, sum_c, top_n, top_c) of each range and group ->
    (part, nation, carry_n, carry_c, carry_top, after_s, peak_c): what comes
    before the range, the group's first moment after it, the group's largest sum of cents."""
    out, at = [], {}
    for part, nation, first, sum_n, sum_c, top_n, top_c in sorted(ranges, key=lambda r: (r[1], r[2])):
        n, c, top, peak, mine = at.get(nation, (0, 0, _LOW, _LOW, []))
        if mine:
            mine[-1][5] = first
        mine.append([part, nation, n, c, top, None])
        at[nation] = n + sum_n, c + sum_c, max(top, n + top_n), max(peak, c + top_c), mine
    for *_, peak, mine in at.values():
        out += [(*row, peak) for row in mine]
    return out


def _finish(batches):
    """Pass two: segments with their carries -> the rows."""
    schema = _arrow(_ROW)
    for batch in batches:
        for s in batch.to_pylist():
            at = np.array(s["at"], "i8")
            n = np.cumsum(np.array(s["dn"], "i8")) + (s["carry_n"] + s["before_n"])
            cents = np.cumsum(np.array(s["dc"], "i8")) + (s["carry_c"] + s["before_c"])
            top = max(s["carry_top"], s["carry_n"] + s["before_top"] if s["before_top"] > _LOW else _LOW)
            high = np.maximum(np.maximum.accumulate(n), top)
            after = s["next_s"] if s["next_s"] is not None else s["after_s"]
            to = pa.array([*at[1:].tolist(), after], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s["nation_id"], "i4")), pa.array(at), to, pa.array(n), pa.array(cents), pa.array(high), pa.array(cents == s["peak_c"])], schema=schema)


def sweep(spark: SparkSession, intervals: DataFrame) -> DataFrame:
    """intervals(nation_id, start_s, end_s, cents) -> nation_id, from_s, to_s,
    n_open, open_cents, high_open, is_peak: a row for each group and moment at
    which the number of open intervals or the sum of their cents changes.

    Each interval counts for its nation_id (null: -1) and again for -2. It is
    open from start_s (included) to end_s (excluded; null: for ever); without
    a start, or with an end not after it, it takes no part. Null cents are 0.
    Repeated rows count each; starts and ends at one moment are taken
    together. Other columns are ignored; an empty table gives an empty result."""
    open_ = intervals.where("start_s is not null and (end_s is null or end_s > start_s)")
    open_ = open_.select(F.coalesce("nation_id", F.lit(UNKNOWN)).cast("int").alias("nation_id"), F.col("start_s").cast("long").alias("start_s"), F.col("end_s").cast("long").alias("end_s"), F.coalesce("cents", F.lit(0)).cast("long").alias("cents"))
    both = F.array(F.struct(F.col("start_s").alias("from_s"), F.lit(1).cast("long").alias("dn"), F.col("cents").alias("dc")), F.struct(F.col("end_s").alias("from_s"), F.lit(-1).cast("long").alias("dn"), (-F.col("cents")).alias("dc")))
    deltas = open_.select("nation_id", F.inline(both)).where("from_s is not null")
    summed = [F.sum("dn").alias("dn"), F.sum("dc").alias("dc")]
    by_nation = deltas.groupBy("nation_id", "from_s").agg(*summed)
    all_ = by_nation.groupBy("from_s").agg(*summed).select(F.lit(ALL).alias("nation_id"), "from_s", "dn", "dc")
    moments = by_nation.union(all_).where("dn <> 0 or dc <> 0")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = moments.repartitionByRange(n, "nation_id", "from_s").sortWithinPartitions("nation_id", "from_s")
    segments = written(spark, dealt.mapInArrow(_segments, _SEGMENT), "segments")
    ranges = segments.groupBy("part", "nation_id").agg(F.min("first_s"), F.sum("sum_n"), F.sum("sum_c"), F.max(F.col("before_n") + F.col("top_n")), F.max(F.col("before_c") + F.col("top_c"))).collect()
    table = spark.createDataFrame(carries([tuple(r) for r in ranges]), "part int, nation_id int, carry_n long, carry_c long, carry_top long, after_s long, peak_c long")
    return segments.drop("first_s", "sum_n", "sum_c", "top_n", "top_c").join(F.broadcast(table), ["part", "nation_id"]).mapInArrow(_finish, _ROW)


def with_nation(spark: SparkSession, rows: DataFrame, clients: DataFrame) -> DataFrame:
    """rows(client_id, ...) with the nation_id of clients(client_id, nation_id), null if none.

    Of several rows of a client the least nation_id counts. Clients with more
    than a HOT_KEYS-th of the rows, of which there are at most HOT_KEYS, are
    joined by broadcast; all others by a shuffle, in which those rows, and the
    rows without a client, are dealt at random."""
    nations = clients.where("client_id is not null").groupBy("client_id").agg(F.min("nation_id").alias("nation_id"))
    counts = rows.where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("_n"))
    counts = written(spark, counts, "clients")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > max(1, total // HOT_KEYS)).select("client_id")
    hot = written(spark, hot.join(nations, "client_id", "left").select(F.col("client_id").alias("_hot"), F.col("nation_id").alias("_hot_nation")), "hot-clients")
    found = rows.drop("nation_id").join(F.broadcast(hot), F.col("client_id") == F.col("_hot"), "left")
    spread = F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string"))
    key = F.when(F.col("client_id").isNull() | F.col("_hot").isNotNull(), spread).otherwise(F.concat(F.lit("c"), F.col("client_id").cast("string")))
    side = nations.select(F.concat(F.lit("c"), F.col("client_id").cast("string")).alias("_key"), "nation_id")
    out = found.withColumn("_key", key).join(side, "_key", "left")
    return out.withColumn("nation_id", F.coalesce("nation_id", "_hot_nation")).drop("_key", "_hot", "_hot_nation")


def open_sales(spark: SparkSession, sales: DataFrame, sale_lines: DataFrame, clients: DataFrame) -> DataFrame:
    """The sales as intervals: nation_id, start_s, end_s, cents.

    A sale ends OPEN_DAYS after the earliest shipment of its lines; sales and
    lines without a sale_id have no such line and no such sale."""
    ends = sale_lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg((F.min(minute("shipped_at")) + OPEN_DAYS * 86400).alias("end_s"))
    cents = F.floor(F.coalesce(F.col("total").cast("double"), F.lit(0.0)) * 100 + 0.5).cast("long")
    rows = sales.where("sold_at is not null").select("sale_id", "client_id", minute("sold_at").alias("start_s"), cents.alias("cents"))
    rows = rows.join(ends, "sale_id", "left").where("end_s is null or end_s > start_s").select("client_id", "start_s", "end_s", "cents")
    return with_nation(spark, rows, clients)


def op13_open_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spark, open_sales(spark, read(spark, sf_dir, "sales"), read(spark, sf_dir, "sale_lines"), read(spark, sf_dir, "clients")))


ORACLE_SQL = """
WITH ends AS (
  SELECT sale_id, (epoch(date_trunc('minute', min(shipped_at)))::BIGINT + 7 * 86400) AS end_s
  FROM sale_lines WHERE sale_id IS NOT NULL AND shipped_at IS NOT NULL GROUP BY sale_id),
nations AS (SELECT client_id, min(nation_id) AS nation_id FROM clients WHERE client_id IS NOT NULL GROUP BY client_id),
spans AS (
  SELECT coalesce(c.nation_id, -1)::INTEGER AS nation_id, epoch(date_trunc('minute', s.sold_at))::BIGINT AS start_s, e.end_s,
         floor(100 * coalesce(s.total, 0) + 0.5)::BIGINT AS cents
  FROM sales s LEFT JOIN ends e ON e.sale_id = s.sale_id LEFT JOIN nations c ON c.client_id = s.client_id
  WHERE s.sold_at IS NOT NULL),
taking AS (SELECT * FROM spans WHERE end_s IS NULL OR end_s > start_s),
both_ AS (SELECT * FROM taking UNION ALL SELECT -2, start_s, end_s, cents FROM taking),
deltas AS (
  SELECT nation_id, start_s AS from_s, 1 AS dn, cents AS dc FROM both_
  UNION ALL SELECT nation_id, end_s, -1, -cents FROM both_ WHERE end_s IS NOT NULL),
moments AS (
  SELECT nation_id, from_s, sum(dn) AS dn, sum(dc) AS dc FROM deltas GROUP BY ALL HAVING sum(dn) <> 0 OR sum(dc) <> 0),
running AS (
  SELECT nation_id, from_s, lead(from_s) OVER w AS to_s, sum(dn) OVER w AS n_open, sum(dc) OVER w AS open_cents
  FROM moments WINDOW w AS (PARTITION BY nation_id ORDER BY from_s))
SELECT nation_id, from_s, to_s, n_open::BIGINT AS n_open, open_cents::BIGINT AS open_cents,
       max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s)::BIGINT AS high_open,
       open_cents = max(open_cents) OVER (PARTITION BY nation_id) AS is_peak
FROM running
"""
