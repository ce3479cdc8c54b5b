"""Operator 13 against a plain sweep in Python."""

import datetime
import random

from pyspark.sql import functions as F

from quirelake.llm import sweep

T = datetime.datetime(2024, 1, 1)


def brute(intervals):
    moves = {}
    for nation, start, end, cents in intervals:
        if start is None or (end is not None and end <= start):
            continue
        for g in (-1 if nation is None else nation, -2):
            for at, sign in ((start, 1), (end, -1)):
                if at is not None:
                    n, c = moves.setdefault(g, {}).get(at, (0, 0))
                    moves[g][at] = n + sign, c + sign * (cents or 0)
    out = []
    for g, at in moves.items():
        rows, n, c, high = [], 0, 0, 0
        for t in sorted(t for t, d in at.items() if d != (0, 0)):
            n, c = n + at[t][0], c + at[t][1]
            high = n if not rows else max(high, n)
            rows.append([g, t, None, n, c, high])
            if len(rows) > 1:
                rows[-2][2] = t
        peak = max((r[4] for r in rows), default=0)
        out += [(*r, r[4] == peak) for r in rows]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("nation_id", "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak").collect()), key=str)


def intervals_of(spark, rows):
    return spark.createDataFrame([(*r, 7, 8) for r in rows], "nation_id int, start_s long, end_s long, cents long, part int, at long")


def test_sweep_equals_brute_force(spark):
    rng = random.Random(13)
    rows = [(rng.choice([None, 1, 2, 3, 3, 3, 3]), rng.randrange(0, 6000, 60), None if rng.random() < 0.1 else rng.randrange(0, 9000, 60), rng.choice([None, 0, 5, 100, -30])) for _ in range(3000)]
    rows += [(4, None, 60, 5), (4, 120, 120, 5), (5, 60, 120, 1), (5, 120, 180, 1), (6, -120, None, 0)] + [(7, 600, 1200, 10)] * 40
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert got(sweep.sweep(spark, intervals_of(spark, rows))) == brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_segments_of_one_group_carry_over(spark):
    rows = [(1, 60 * i, 60 * (i + 500), i % 90) for i in range(30_000)]
    assert got(sweep.sweep(spark, intervals_of(spark, rows))) == brute(rows)


def test_cents_that_stay_below_zero_and_counts_that_stay(spark):
    rows = [(1, 0, None, -5), (1, 60, None, -7), (2, 0, 60, 3), (2, 60, 120, 4), (2, 120, 180, 4)]
    assert got(sweep.sweep(spark, intervals_of(spark, rows))) == brute(rows)


def test_open_sales(spark):
    at = lambda minutes, seconds=0: T + datetime.timedelta(minutes=minutes, seconds=seconds)
    sales = [(1, 10, 1.005, at(0, 59)), (2, 10, None, at(5)), (2, 10, 2.5, at(6)), (None, 11, 3.0, at(7)), (3, None, 4.0, at(8)), (4, 99, 5.0, None), (5, 12, 0.29, at(99999)), (6, 13, 1.0, at(9))]
    lines = [(1, at(3, 30)), (1, at(4)), (1, None), (2, None), (None, at(1)), (5, at(0)), (77, at(0))]
    clients = [(10, 3), (10, 8), (11, None), (12, 4), (None, 9)]
    ntz = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    s = ntz(spark.createDataFrame([(*r, "x", 1) for r in sales], "sale_id long, client_id long, total double, sold_at timestamp, nation_id string, cents int"), "sold_at")
    lo = ntz(spark.createDataFrame(lines, "sale_id long, shipped_at timestamp"), "shipped_at")
    c = spark.createDataFrame(clients, "client_id long, nation_id int")
    base = int(T.replace(tzinfo=datetime.timezone.utc).timestamp())
    want = [(3, base, base + 180 + 7 * 86400, 100), (3, base + 300, None, 0), (3, base + 360, None, 250), (None, base + 420, None, 300), (None, base + 480, None, 400), (None, base + 540, None, 100)]
    found = sweep.open_sales(spark, s, lo, c)
    assert sorted((tuple(r) for r in found.select("nation_id", "start_s", "end_s", "cents").collect()), key=str) == sorted(want, key=str)
    assert got(sweep.sweep(spark, found)) == brute(want)


def test_hot_client_and_no_client(spark, monkeypatch):
    monkeypatch.setattr(sweep, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(1 if i % 3 == 0 else None if i % 3 == 1 else i, i) for i in range(900)], "client_id long, v long")
    clients = spark.createDataFrame([(i, i % 7) for i in range(1, 900, 2)], "client_id long, nation_id int")
    found = {r["v"]: r["nation_id"] for r in sweep.with_nation(spark, rows, clients).collect()}
    assert found == {i: (1 if i % 3 == 0 else None if i % 3 == 1 or i % 2 == 0 else i % 7) for i in range(900)}


def test_empty_tables(spark):
    assert got(sweep.sweep(spark, intervals_of(spark, []))) == []
