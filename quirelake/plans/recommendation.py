"""Profiles, co-occurrence and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend as rc
from ..operators import similar_books
from .registry import query

SEEDS = (3, 14, 15, 92, 65)
POOL = f"pool AS (SELECT keyword, sum(weight / 2 + 0.5) AS pool FROM keywords WHERE book_id IN {SEEDS} GROUP BY 1)"


def _pool(t):
    return t.keywords.where(F.col("book_id").isin(*SEEDS)).groupBy("keyword").agg(F.sum(F.col("weight") / 2 + 0.5).alias("pool"))


@query("cooccurrence", "keywords", f"""WITH {POOL}, sz AS (SELECT keyword, count(*) AS n FROM keywords GROUP BY 1),
b AS (SELECT a.keyword AS seed, k.keyword, count(*) AS both FROM keywords a JOIN keywords k ON a.book_id = k.book_id AND a.keyword <> k.keyword WHERE a.keyword IN (SELECT keyword FROM pool) GROUP BY ALL),
j AS (SELECT b.seed, b.keyword, b.both / (x.n + y.n - b.both)::DOUBLE AS jaccard FROM b JOIN sz x ON x.keyword = b.keyword JOIN sz y ON y.keyword = b.seed WHERE y.n > 1)
SELECT seed, keyword, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY jaccard DESC, keyword) AS n FROM j WHERE jaccard >= 0.25) WHERE n <= 5""")
def _(t):
    return rc.neighbours(t.keywords, _pool(t)).select("seed", "keyword", F.round("jaccard", 6).alias("jaccard"))


@query("cooccurrence_expansion")
def _(t):
    """The pool with neighbours of strong seeds; checked on a fixture."""
    return rc.expand(t.keywords, _pool(t).withColumnRenamed("pool", "weight"))


@query("local_recommendation", "keywords books", f"""WITH {POOL}, df AS (SELECT keyword, count(*) AS df FROM keywords GROUP BY 1),
h AS (SELECT k.book_id, sum(p.pool * k.weight * ln(1 + d.df)) AS s FROM keywords k JOIN pool p USING (keyword) JOIN df d USING (keyword) GROUP BY 1)
SELECT book_id, round(score, 5) AS score FROM (SELECT h.book_id, (s + CASE WHEN author IN ('src3', 'src4') THEN 0.6 ELSE 0 END) * CASE WHEN h.book_id IN {SEEDS} THEN 0.2 ELSE 1 END AS score
FROM h JOIN books ON id = h.book_id) ORDER BY round(score, 5) DESC, book_id LIMIT 40""")
def _(t):
    books = t.books.select(F.col("id").alias("book_id"), "author")
    rows = rc.local_scores(t.keywords, _pool(t), books, ["src3", "src4"], SEEDS).withColumn("score", F.round("score", 5))
    return rows.orderBy(F.desc("score"), "book_id").limit(40)


FROM_SOURCE = "CASE id % 4 WHEN 0 THEN 'Google Books' WHEN 1 THEN '豆瓣' WHEN 2 THEN 'Pixiv' ELSE 'else' END"


@query("quality_scores", "books", f"""SELECT id, round(greatest(0, least(1, CASE id % 4 WHEN 0 THEN 0.60 WHEN 1 THEN 0.55 WHEN 2 THEN 0.55 ELSE 0.25 END
 + CASE WHEN id % 11 = 0 THEN 0 WHEN id % 4 = 0 THEN (id % 11) / 2.0 / 5 * greatest(0, least(1, log10(total_characters + 1) / log10(50))) * 0.35 WHEN id % 4 = 1 THEN (id % 11) / 2.0 / 10 * 0.35 ELSE 0 END
 + CASE WHEN id % 3 > 0 AND trim(title, ' ') <> '' THEN 0.05 ELSE 0 END)), 5)::DOUBLE AS score FROM books WHERE title IS NOT NULL""")
def _(t):
    rating = F.when(F.col("id") % 11 == 0, "none").otherwise(((F.col("id") % 11) / 2).cast("string"))
    told = F.when(F.col("id") % 3 > 0, F.col("title")).otherwise(" ")
    score = rc.quality(F.expr(FROM_SOURCE), rating, F.log10(F.col("total_characters") + 1.0), told)
    return t.books.where("title is not null").select("id", F.round(score, 5).alias("score"))


@query("relevance", "books keywords", """WITH k AS (SELECT book_id, list(keyword) AS kw, sum(weight) AS total FROM keywords GROUP BY 1), s AS (SELECT b.author, k.* FROM k JOIN books b ON b.id = k.book_id WHERE book_id = 12),
o AS (SELECT k2.book_id, sum(k1.weight * k2.weight) AS hit FROM keywords k1 JOIN keywords k2 USING (keyword) WHERE k1.book_id = 12 GROUP BY 1)
SELECT k.book_id, round(0.35 * len(list_intersect(k.kw, s.kw)) / len(list_distinct(list_concat(k.kw, s.kw)))::DOUBLE + CASE WHEN b.author = s.author THEN 0.2 ELSE 0 END
 + 0.15 * least(1.0, coalesce(o.hit, 0) / s.total), 6) AS score FROM k JOIN books b ON b.id = k.book_id LEFT JOIN o ON o.book_id = k.book_id, s WHERE k.book_id <> 12""")
def _(t):
    per = t.keywords.groupBy("book_id").agg(F.collect_list("keyword").alias("tags"), F.map_from_entries(F.collect_list(F.struct("keyword", "weight"))).alias("contents"))  # ten at most
    rows = per.join(t.books.select(F.col("id").alias("book_id"), "author"), "book_id")
    empty = F.array().cast("array<string>")
    side = lambda p: {"tags": F.col(f"{p}tags"), "author": F.col(f"{p}author"), "title": empty, "description": empty, "contents": F.col(f"{p}contents")}
    seed = rows.where("book_id = 12").select(*[F.col(c).alias(f"s_{c}") for c in ("tags", "author", "contents")])
    pairs = rows.where("book_id <> 12").crossJoin(F.broadcast(seed))  # one book
    return pairs.select("book_id", F.round(rc.relevance(side("s_"), side("")), 6).alias("score"))


@query("merged_sources", "books", """WITH a AS (SELECT title, author, format AS source, reading_time / 5000.0 + 0.25 AS score, 0 AS s FROM books WHERE id % 3 = 0), b AS (SELECT title, author, format AS source, reading_time / 5000.0 + 0.05, 1 FROM books WHERE id % 2 = 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) || '|' || lower(author) ORDER BY s, score DESC, source) AS n FROM u) WHERE n = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, title, author) AS k FROM o)
SELECT title, author, source, round(score, 6) AS score FROM c WHERE k <= CASE source WHEN 'en' THEN 8 WHEN 'fr' THEN 2 ELSE 1000000 END ORDER BY c.score DESC, title, author LIMIT 30""")
def _(t):
    of = lambda m: t.books.where(f"id % {m} = 0").select("title", "author", F.col("format").alias("source"), (F.col("reading_time") / 5000.0).alias("score"))
    return rc.merge_sources([of(3), of(2)], [0.25, 0.05], {"en": 8, "fr": 2}).withColumn("score", F.round("score", 6))


TOLD = "title || CASE id % 3 WHEN 0 THEN ' a FANTASY' WHEN 1 THEN '科幻' ELSE '' END"


@query("gate_and_genres", "books", f"""SELECT id, id % 4 <> 2 OR total_characters % 300 >= 100 AS passes,
CASE WHEN trim(t, ' ') = '' THEN 0 ELSE ((contains(t, '奇幻') OR contains(lower(t), 'fantasy') OR contains(lower(t), 'magic'))::INT + (contains(t, '科幻') OR contains(lower(t), 'sci-fi'))::INT) / 2.0 END::DOUBLE AS hits
FROM (SELECT *, {TOLD} AS t FROM books WHERE title IS NOT NULL)""")
def _(t):
    english = F.create_map(F.lit("奇幻"), F.lit("fantasy|magic"), F.lit("科幻"), F.lit("sci-fi"))
    words = F.array(F.lit("奇幻"), F.lit("科幻"))
    rows = t.books.where("title is not null")
    return rows.select("id", rc.passes_gate(F.expr(FROM_SOURCE), F.log10(F.col("total_characters") % 300 + 1.0)).alias("passes"), rc.keyword_hits(words, english, F.expr(TOLD)).alias("hits"))


@query("candidate_scores", "books", """SELECT id, round(CASE WHEN w = '' THEN 0 WHEN id % 2 = 0 THEN 1.0 ELSE -0.4 END + log10(total_characters + 1) * 0.15 + h1::INT * 1.0 + h2::INT * 0.5 + h3::INT * 0.25, 5)::DOUBLE AS score,
CASE WHEN h1 THEN '书' WHEN h2 THEN 'er' WHEN h3 THEN 'x' END AS reason
FROM (SELECT id, total_characters, title || CASE WHEN id % 2 = 0 THEN '书' ELSE '' END AS w, id % 2 = 0 AS h1, contains(title || author, 'er') AS h2, contains(title || author, 'x') AS h3 FROM books WHERE title IS NOT NULL AND author IS NOT NULL)""")
def _(t):
    text = F.concat("title", F.when(F.col("id") % 2 == 0, "书").otherwise(""))
    score, reason = rc.candidate_score(text, F.array("author"), F.log10(F.col("total_characters") + 1.0), [("书", 1.0, "")], [("er", 2.0), ("x", 1.0)], None)
    rows = t.books.where("title is not null and author is not null")
    return rows.select("id", F.round(score, 5).alias("score"), reason.alias("reason"))


@query("single_book", "books keywords book_tags", """WITH b AS (SELECT id, substr(trim(lower(title)), 1, 24) AS title, author, list_distinct(regexp_extract_all(substr(trim(lower(title)), 1, 24), '[a-z]{4,}')) AS tw,
  list_distinct(regexp_extract_all(lower(substr(title, 25, 60)), '[a-z]{6,}')) AS dw, coalesce(g.tags, []) AS tags FROM books LEFT JOIN (SELECT book_id, list(tag_id::VARCHAR) AS tags FROM book_tags GROUP BY 1) g ON g.book_id = id WHERE title IS NOT NULL),
df AS (SELECT keyword, ln(1 + count(*)) AS rare FROM keywords GROUP BY 1), k AS (SELECT book_id, keyword, weight * rare AS w FROM keywords JOIN df USING (keyword)),
tot AS (SELECT book_id, sum(w) AS total FROM k WHERE book_id % 20 = 0 GROUP BY 1),
h AS (SELECT x.book_id AS seed, y.book_id AS id, sum(x.w * y.w) AS hit FROM k x JOIN k y USING (keyword) WHERE x.book_id % 20 = 0 AND x.book_id <> y.book_id GROUP BY ALL),
p AS (SELECT x.id AS seed, y.id, 0.35 * coalesce(len(list_intersect(x.tags, y.tags))::DOUBLE / nullif(len(list_distinct(list_concat(x.tags, y.tags))), 0), 0)
  + CASE WHEN trim(x.author) NOT IN ('', '未知作者') AND lower(trim(x.author)) = lower(trim(y.author)) THEN 0.2 ELSE 0 END
  + 0.1 * coalesce(len(list_intersect(x.tw, y.tw))::DOUBLE / nullif(len(list_distinct(list_concat(x.tw, y.tw))), 0), 0)
  + 0.2 * coalesce(len(list_intersect(x.dw, y.dw))::DOUBLE / nullif(len(list_distinct(list_concat(x.dw, y.dw))), 0), 0)
  + 0.15 * least(1.0, coalesce(h.hit, 0) / coalesce(t.total, 1)) AS s,
  length(x.title) >= 2 AND length(y.title) >= 2 AND (contains(x.title, y.title) OR contains(y.title, x.title)) AS held
  FROM b x JOIN b y ON x.id <> y.id LEFT JOIN h ON h.seed = x.id AND h.id = y.id LEFT JOIN tot t ON t.book_id = x.id WHERE x.id % 20 = 0),
r AS (SELECT seed, id, round(CASE WHEN held THEN greatest(s, 0.4) ELSE s END, 6) AS score FROM p)
SELECT seed, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id)::INT AS rank FROM r WHERE score > 0) WHERE rank <= 10""")
def _(t):
    """The ten books most like each book whose id is divisible by 20; a title is the first 24 characters of a first line, a description what follows."""
    short = F.substring(F.trim(F.lower("title")), 1, 24)
    known = t.books.agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"), F.count_if(F.col("id") % 20 == 0).alias("asked")).first()  # ids alone
    # sales of ids that no book has go before they are joined
    tags = t.book_tags.where(F.col("book_id").between(known["least"], known["most"])).groupBy(F.col("book_id").alias("id")).agg(F.collect_list(F.col("tag_id").cast("string")).alias("tags"))  # 25 brands
    words = lambda c, n: F.regexp_extract_all(c, F.lit(f"[a-z]{{{n},}}"), F.lit(0))
    named = t.books.where("title is not null").select("id", short.alias("title"), "author", words(short, 4).alias("title_words"), words(F.lower(F.substring("title", 25, 60)), 6).alias("description_words"))
    books = named.join(tags, "id", "left")
    return similar_books.single_book(books, t.keywords, books.where("id % 20 = 0"), counts=(known["n"], known["asked"]))
