"""Every query with SQL against DuckDB on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

from quirelake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def canon(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canon, value)) + "]"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(canon(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["scan_books"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in read.split(",")} <= set(spark.read.parquet(f"{DATA}/documents.parquet").columns) and len(read.split(",")) < 6
    counted = registry.QUERIES["format_distribution"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string>" in counted
    plan = registry.QUERIES["lookup_by_id"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,42)" in plan
