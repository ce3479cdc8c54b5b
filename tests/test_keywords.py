import math

from quirelake.operators import keywords as k
from quirelake.operators import recommend as rc


def test_ranked_gives_python_a_row_for_each_book(spark):
    rows = [(1, "alpha", 1.0), (1, "alphabet", 0.95), (1, "gamma", 0.5), (1, "beta", 0.5), (1, "far", 0.1), (2, "one", 0.3), (2, None, None), (3, "nan", math.nan), (3, "plain", 0.2)]
    scored = spark.createDataFrame([r for r in rows if r[1]], "book_id long, keyword string, score double")
    out = k.ranked(scored, 2)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = {(r["book_id"], r["rank"]): (r["keyword"], r["weight"]) for r in out.collect()}
    # alphabet holds a chosen keyword, so the first of equal scores comes before it
    assert got[1, 0] == ("alpha", 1.0) and got[1, 1] == ("beta", 0.5) and got[2, 0] == ("one", 1.0)
    assert {x for (b, _), (x, _) in got.items() if b == 3} == {"nan", "plain"} and len(got) == 5


def test_simple_keywords_calls_python_once(spark):
    """Books without keywords, null texts and a null id as before."""
    texts = spark.createDataFrame([(1, "Banana banana orange"), (2, "no"), (3, None), (4, "")], "book_id long, text string")
    out = k.simple_keywords(texts)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {tuple(r) for r in out.collect()} == {(1, "banana", 1.0, 0), (1, "orange", 0.5, 1)}


def test_expand_takes_no_pass_for_each_kind_of_seed(spark):
    """Weak seeds are no neighbours, and neither they nor strong ones need a pass of their own: two passes for pairs, two for sizes, which Spark shares."""
    rows = [(b, w, 1.0) for b, words in enumerate(["s a", "s a w", "s w", "a b", "b w", "b"]) for w in words.split()]
    keywords = spark.createDataFrame([*rows, (9, None, 1.0)], "book_id long, keyword string, weight double").where("weight > 0.1234")
    seeds = spark.createDataFrame([("s", 1.0), ("w", 0.1)], "keyword string, weight double")
    out = rc.expand(keywords, seeds)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("0.1234") == 4
    assert {r["keyword"]: round(r["weight"], 6) for r in out.collect()} == {"s": 1.0, "w": 0.1, "a": 0.2}
