"""n-grams, cohesion, entropy and keyword ranks over the documents' letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywords as k
from .registry import query

#: Runs of letters stand in for Chinese runs, which the driver's documents lack.
RUNS = "[a-z]{5,}"


def _texts(t):
    return t.raw("documents").where("doc_id is not null").select((F.col("doc_id") % 20).alias("book_id"), F.lower("text").alias("text"))


GRAMS = f"""r AS (SELECT doc_id % 20 AS book_id, unnest(regexp_extract_all(lower(text), '{RUNS}')) AS run FROM documents),
p AS (SELECT book_id, run, unnest(range(1, length(run) + 1)) AS i FROM r),
g AS (SELECT book_id, run, i, unnest(range(1, least(3, length(run) - i + 1) + 1)) AS n FROM p),
grams AS (SELECT book_id, substr(run, i, n) AS gram, CASE WHEN i = 1 THEN chr(10) ELSE substr(run, i - 1, 1) END AS l, CASE WHEN i + n > length(run) THEN chr(10) ELSE substr(run, i + n, 1) END AS r FROM g),
counts AS (SELECT book_id, gram, count(*) AS n FROM grams GROUP BY ALL)"""


@query("keyword_counts", "keywords", "SELECT book_id, keyword, weight, rank::BIGINT AS rank FROM keywords")
def _(t):
    return t.keywords.select("book_id", "keyword", "weight", F.col("rank").cast("long").alias("rank"))


@query("ngram_counts", "", f"WITH {GRAMS} SELECT book_id, gram, n FROM counts WHERE n >= 3")
def _(t):
    return k.gram_counts(k.ngrams(_texts(t), 3, RUNS), 3)


@query("ngram_cohesion", "", f"""WITH {GRAMS}, tot AS (SELECT book_id, sum(n) AS total FROM counts WHERE length(gram) = 1 GROUP BY 1),
s AS (SELECT book_id, gram, n, unnest(range(1, length(gram))) AS j FROM counts WHERE length(gram) > 1)
SELECT s.book_id, s.gram, s.n, round(min(ln(s.n * tot.total::DOUBLE / (a.n * b.n::DOUBLE))), 6) AS pmi FROM s JOIN counts a ON a.book_id = s.book_id AND a.gram = substr(s.gram, 1, j)
JOIN counts b ON b.book_id = s.book_id AND b.gram = substr(s.gram, j + 1) JOIN tot ON tot.book_id = s.book_id GROUP BY ALL""")
def _(t):
    return k.cohesion(k.gram_counts(k.ngrams(_texts(t), 3, RUNS))).select("book_id", "gram", "n", F.round("pmi", 6).alias("pmi"))


@query("neighbour_entropy", "", f"""WITH {GRAMS}, a AS (SELECT book_id, gram, l, count(*) AS c FROM grams GROUP BY ALL), b AS (SELECT book_id, gram, r, count(*) AS c FROM grams GROUP BY ALL),
x AS (SELECT book_id, gram, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS e, count(*) AS d FROM a GROUP BY ALL), y AS (SELECT book_id, gram, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS e, count(*) AS d FROM b GROUP BY ALL)
SELECT book_id, gram, round(x.e, 5) + 0.0 AS left_entropy, x.d AS left_distinct, round(y.e, 5) + 0.0 AS right_entropy, y.d AS right_distinct FROM x JOIN y USING (book_id, gram)""")
def _(t):
    e = k.neighbour_entropy(k.ngrams(_texts(t), 3, RUNS))
    return e.select("book_id", "gram", (F.round("left_entropy", 5) + 0.0).alias("left_entropy"), "left_distinct", (F.round("right_entropy", 5) + 0.0).alias("right_entropy"), "right_distinct")


@query("swallowed_substrings", "", f"""WITH {GRAMS}, c AS (SELECT * FROM counts WHERE length(gram) >= 2 AND n >= 20)
SELECT book_id, gram, n FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.book_id = c.book_id AND length(b.gram) > length(c.gram) AND contains(b.gram, c.gram) AND c.n <= b.n)
AND NOT (c.n <= 2 * coalesce((SELECT sum(b.n) FROM c b WHERE b.book_id = c.book_id AND length(b.gram) > length(c.gram) AND starts_with(b.gram, c.gram)), 0)
  OR c.n <= 2 * coalesce((SELECT sum(b.n) FROM c b WHERE b.book_id = c.book_id AND length(b.gram) > length(c.gram) AND ends_with(b.gram, c.gram)), 0))""")
def _(t):
    cands = k.gram_counts(k.ngrams(_texts(t), 3, RUNS), 20).where(F.length("gram") >= 2)
    return k.without_substrings(cands, t.spark.createDataFrame([], "word string"))


@query("diverse_keywords")
def _(t):
    """Keywords ranked with a penalty for overlaps: a sequential choice, so there is no SQL."""
    return k.ranked(t.keywords.select("book_id", "keyword", F.col("weight").alias("score")), 5)


@query("books_without_keywords", "keywords", "SELECT doc_id AS book_id FROM documents WHERE doc_id NOT IN (SELECT book_id FROM keywords)")
def _(t):
    return k.missing(t.raw("documents").select(F.col("doc_id").alias("book_id")), t.keywords)


@query("max_normalised", "books", "SELECT id, round(greatest(0.05, least(1.0, reading_time / greatest(max(reading_time) OVER (PARTITION BY author), 1)::DOUBLE)), 6) AS weight FROM books")
def _(t):
    from pyspark.sql import Window

    largest = F.greatest(F.max("reading_time").over(Window.partitionBy("author")), F.lit(1))
    return t.books.select("id", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("reading_time") / largest)), 6).alias("weight"))
