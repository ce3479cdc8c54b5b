"""Costs and results of retrieval that the fixtures and SQL don't show."""

from pyspark.sql import functions as F

from quirelake.operators import retrieval as r

TEXTS = ["", "  ", "One two, TWO-three_4", "9 lives; nine", "\tx\n", "caf\xe9 noir", "你好世 ok", None]


def test_bm25_splits_a_text_once(spark):
    """No filter splits texts a second time, no shuffle deals hits by term, and few terms are broadcast."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    queries = spark.createDataFrame([(1, "two nine"), (2, "你好 noir")], "query_id long, text string")
    found = r.bm25(docs, queries, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and ("split(" in x or "regexp_extract_all(" in x) and "size(" in x]
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {(x["query_id"], x["id"]) for x in found.collect()} == {(1, 2), (1, 3), (2, 5), (2, 6)}


def test_ascii_texts_have_the_tokens_of_the_general_rule(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    mixed = F.concat("text", F.lit(" \xe9"))  # takes the general rule, and is a token of its own
    got = rows.select(r.tokens(F.col("text")).alias("a"), r.tokens(mixed).alias("b")).collect()
    for a, b in got[:5]:
        assert a == [x for x in b if x != "\xe9"]
    assert got[2]["a"] == ["one", "two", "two", "three", "4"] and got[7]["a"] is None
