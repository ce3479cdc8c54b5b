"""Joins, and books by tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tagexpr
from ..operators import joins as j
from ..operators import ranking, tagging
from .registry import query

ORDERS = "SELECT DISTINCT l_orderkey AS book_id FROM lineitem"


def _orders(t):
    return t.raw("lineitem").select(F.col("l_orderkey").alias("book_id")).distinct()


def _names():
    return {f"Brand#{i}": i for i in range(1, 26)}


def _has(tag: int) -> str:
    return f"book_id IN (SELECT book_id FROM book_tags WHERE tag_id = {tag})"


@query("tag_all", "book_tags", "SELECT book_id FROM book_tags WHERE tag_id IN (1, 2, 3) GROUP BY book_id HAVING count(DISTINCT tag_id) = 3")
def _(t):
    return tagging.with_all_tags(t.book_tags, [1, 2, 3])


@query("tag_any", "book_tags", f"SELECT book_id FROM ({ORDERS}) WHERE book_id IN (SELECT book_id FROM book_tags WHERE tag_id IN (4, 5))")
def _(t):
    return tagging.with_any_tag(_orders(t), t.book_tags, [4, 5])


@query("tag_expression", "book_tags", f"SELECT book_id FROM ({ORDERS}) WHERE {_has(1)} AND ({_has(2)} OR {_has(3)}) AND NOT {_has(4)}")
def tag_expression(t):
    return tagging.search(_orders(t), t.book_tags, _names(), "brand#1 AND (Brand#2 OR Brand#3) AND NO Brand#4")


@query("tag_expression_or_and", "book_tags", f"SELECT book_id FROM ({ORDERS}) WHERE ({_has(1)} AND {_has(2)}) OR {_has(3)}")
def _(t):
    return tagging.search(_orders(t), t.book_tags, _names(), "(Brand#1 AND Brand#2) OR Brand#3")


@query("tag_expression_or_no", "book_tags", f"SELECT book_id FROM ({ORDERS}) WHERE NOT {_has(2)}")
def _(t):
    return tagging.search(_orders(t), t.book_tags, _names(), "Brand#1 OR NO Brand#2")


@query("tag_expression_no_group", "book_tags", f"SELECT book_id FROM ({ORDERS}) WHERE NOT {_has(1)} AND NOT {_has(2)}")
def _(t):
    return tagging.search(_orders(t), t.book_tags, _names(), "NO (Brand#1 AND Brand#2)")


@query("tag_flat_terms", "book_tags", f"SELECT book_id FROM ({ORDERS}) WHERE ({_has(1)} AND {_has(2)}) OR {_has(3)}")
def _(t):
    groups = tagexpr.flat_terms([(1, "AND"), (2, "AND"), (3, "OR")])
    sets = tagging.tag_sets(t.book_tags, [1, 2, 3])
    return sets.where(tagexpr.matches_any_group(groups, F.col("tag_ids"))).select("book_id")


@query("tag_sets", "book_tags", "SELECT book_id, list_sort(list(tag_id)) AS tag_ids FROM book_tags GROUP BY book_id")
def _(t):
    return tagging.tag_sets(t.book_tags).withColumn("tag_ids", F.sort_array("tag_ids"))


@query("related_books", "relations", "SELECT related_id AS id FROM relations WHERE book_id = 20 AND status <> 2 UNION SELECT book_id FROM relations WHERE related_id = 20 AND status <> 2")
def _(t):
    return j.related(t.relations, 20)


@query("tags_of_book", "tags book_tags", "SELECT id, name FROM tags WHERE id IN (SELECT tag_id FROM book_tags WHERE book_id = 7)")
def _(t):
    mine = t.book_tags.where("book_id = 7").select(F.col("tag_id").alias("id"))
    return t.tags.join(mine, "id", "left_semi")


@query("books_of_each_tag", "tags book_tags", "SELECT name, count(*) AS n FROM book_tags JOIN tags ON id = tag_id GROUP BY name")
def _(t):
    return t.book_tags.join(t.tags, F.col("tag_id") == F.col("id")).groupBy("name").agg(F.count("*").alias("n"))


@query("tag_names_by_book", "tags book_tags", "SELECT book_id, string_agg(name, ',' ORDER BY name) AS names FROM book_tags JOIN tags ON id = tag_id GROUP BY book_id")
def _(t):
    named = t.book_tags.join(t.tags, F.col("tag_id") == F.col("id"))
    return named.groupBy("book_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query("counts_with_titles", "books", """SELECT o.o_custkey AS id, coalesce(b.title, '未知书籍(' || o.o_custkey::VARCHAR || ')') AS title, o.n
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o LEFT JOIN books b ON b.id = o.o_custkey""")
def _(t):
    counts = t.raw("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return j.lookup_with_default(counts, t.books, "id", "title", F.concat(F.lit("未知书籍("), F.col("id").cast("string"), F.lit(")"))).select("id", "title", "n")


@query("top_readings_with_titles", "books readings", "SELECT b.id, b.author, s.seconds FROM (SELECT book_id, sum(seconds)::BIGINT AS seconds FROM readings GROUP BY 1) s JOIN books b ON b.id = s.book_id ORDER BY seconds DESC, id LIMIT 3")
def _(t):
    totals = t.readings.groupBy(F.col("book_id").alias("id")).agg(F.sum("seconds").alias("seconds"))
    return totals.join(t.books.select("id", "author"), "id").orderBy(F.desc("seconds"), "id").limit(3).select("id", "author", "seconds")


@query("week_spine", "readings", """SELECT strftime(d::DATE, '%m/%d') AS label, coalesce(sum(seconds), 0)::BIGINT AS seconds
FROM generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL 1 DAY) AS g(d) LEFT JOIN readings ON day = d::DATE GROUP BY 1""")
def _(t):
    totals = t.readings.where("day between date'2024-01-25' and date'2024-01-31'").groupBy("day").agg(F.sum("seconds").alias("seconds"))
    days = j.spine("2024-01-25", 7, t.spark)
    return days.join(F.broadcast(totals), "day", "left").select(F.date_format("day", "MM/dd").alias("label"), F.coalesce("seconds", F.lit(0)).cast("long").alias("seconds"))  # seven days at most


@query("json_array_join", "tags", """WITH g AS (SELECT conv_id, turn, unnest([conv_id % 60, turn + 11]) AS id FROM conversations WHERE conv_id % 9 > 0)
SELECT conv_id, turn, name FROM g JOIN tags USING (id)""")
def _(t):
    text = F.when(F.col("conv_id") % 9 > 0, F.format_string("[%d, %d]", F.col("conv_id") % 60, F.col("turn") + 11)).otherwise("not json")
    ids = t.raw("conversations").select("conv_id", "turn", F.explode(F.from_json(text, "array<bigint>")).alias("id"))
    return ids.join(t.tags, "id").select("conv_id", "turn", "name")


@query("author_links", "books", """WITH f AS (SELECT author, count(*) AS n FROM books WHERE trim(author) <> '' AND author NOT IN ('未知作者', '佚名', 'Unknown', 'anonymous') GROUP BY 1)
SELECT a.author, a.n AS books, b.author AS other, b.n AS other_books FROM f a JOIN f b ON contains(lower(b.author), lower(a.author))""")
def _(t):
    # pairs of author fields with their numbers of books: a hot author's pairs of books are its square
    books = t.books.select("id", "author")
    counts = books.groupBy("author").agg(F.count("*").alias("books"))
    hits = j.author_fields(books).join(counts, "author")
    return hits.join(counts.select(F.col("author").alias("whole"), F.col("books").alias("other_books")), "whole").select("author", "books", F.col("whole").alias("other"), "other_books")


@query("anti_join", "books", "SELECT id FROM books WHERE id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.books.select("id").join(t.raw("labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("keyword_overlap", "keywords", """SELECT k.book_id, round(sum(k.weight * s.weight), 6) AS score FROM keywords k
JOIN (SELECT keyword, weight FROM keywords WHERE book_id = 12) s USING (keyword) WHERE k.book_id <> 12 GROUP BY 1""")
def _(t):
    seed = t.keywords.where("book_id = 12").select("keyword", F.col("weight").alias("w"))
    return t.keywords.where("book_id <> 12").join(seed, "keyword").groupBy("book_id").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("score"))


@query("toc_by_file", "", """WITH k AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[#?].*$', ''), '[^/]*$')) AS key FROM pages),
f AS (SELECT key, min(page_id) AS first FROM k GROUP BY key) SELECT k.page_id, f.first FROM k JOIN f USING (key)""")
def _(t):
    keyed = t.raw("pages").select("page_id", j.file_key(F.col("url")).alias("key"))
    first = ranking.first_by(keyed, ["key"], ["page_id"]).withColumnRenamed("page_id", "first")
    return keyed.join(first, "key").select("page_id", "first")


@query("chunk_enrichment", "books chunks", "SELECT c.book_id, c.chunk_index, b.author FROM chunks c JOIN books b ON b.id = c.book_id")
def _(t):
    return t.chunks.select("book_id", "chunk_index").join(t.books.select(F.col("id").alias("book_id"), "author"), "book_id")


@query("link_selection", "books", "SELECT a.id AS book_id, b.id AS related_id, 1 AS status FROM books a JOIN books b ON a.id < b.id WHERE a.id < 20 AND b.id < 20")
def _(t):
    return j.link_all(t.books.where("id < 20").select("id"))


AUTHORS = """f AS (SELECT author, count(*) AS n, min(id) AS id FROM books WHERE trim(author) <> '' AND author NOT IN ('未知作者', '佚名', 'Unknown', 'anonymous') GROUP BY 1),
fit AS (SELECT DISTINCT x.author AS a, y.author AS b FROM f x JOIN f y ON contains(lower(y.author), lower(x.author)) OR contains(lower(x.author), lower(y.author)))"""


@query("auto_link_sync", "relations books", f"""WITH {AUTHORS},
k AS (SELECT books.id, f.id AS class FROM books JOIN f ON f.author = books.author),
c AS (SELECT DISTINCT least(x.id, y.id) AS book_id, greatest(x.id, y.id) AS related_id, CASE WHEN a = b THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS n FROM fit JOIN f x ON x.author = a JOIN f y ON y.author = b),
r AS (SELECT DISTINCT * FROM relations),
p AS (SELECT DISTINCT least(book_id, related_id) AS x, greatest(book_id, related_id) AS y FROM r WHERE status <> 0 AND book_id <> related_id),
o AS (SELECT least(a.class, b.class) AS book_id, greatest(a.class, b.class) AS related_id, count(*) AS own FROM p JOIN k a ON a.id = x JOIN k b ON b.id = y GROUP BY 1, 2)
SELECT book_id, related_id, status, false AS classes, 1::BIGINT AS n_links FROM r WHERE status <> 0
UNION ALL SELECT book_id, related_id, 0, true, (n - coalesce(own, 0))::BIGINT FROM c LEFT JOIN o USING (book_id, related_id) WHERE n > coalesce(own, 0)""")
def _(t):
    """Manual and blocked links, and links of whole classes (a class with itself, if it has several books) without the pairs that have a link of their own; author_classes has the books of each."""
    return j.sync_class_links(t.relations.distinct(), t.books)


@query("author_classes", "books", f"""WITH {AUTHORS}
SELECT k.id, f.id AS class_id, (SELECT sum(y.n) FROM fit JOIN f y ON y.author = fit.b WHERE fit.a = f.author)::BIGINT - 1 AS n_links FROM books k JOIN f ON f.author = k.author""")
def _(t):
    return j.link_classes(t.books)


@query("author_cube", "books", "SELECT format, author, grouping_id(format, author)::BIGINT AS level, count(*) AS n FROM books GROUP BY CUBE (format, author)")
def _(t):
    return t.books.cube("format", "author").agg(F.grouping_id("format", "author").cast("long").alias("level"), F.count("*").alias("n"))


@query("author_grouping_sets", "books", "SELECT format, author, sum(total_characters)::BIGINT AS chars FROM books GROUP BY GROUPING SETS ((format), (author), ())")
def _(t):
    b = t.books
    return b.groupingSets([("format",), ("author",), ()], "format", "author").agg(F.sum("total_characters").alias("chars"))


@query("labels_full_outer", "books", "SELECT coalesce(b.id, l.doc_id) AS id, b.id IS NOT NULL AS has_book, l.doc_id IS NOT NULL AS has_label FROM books b FULL JOIN labels l ON b.id = l.doc_id")
def _(t):
    left = t.books.select("id", F.lit(True).alias("b"))
    right = t.raw("labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("l"))
    return left.join(right, "id", "full").select("id", F.col("b").isNotNull().alias("has_book"), F.col("l").isNotNull().alias("has_label"))


@query("events_in_spans", "", """WITH s AS (SELECT user_id, ts AS start, ts + INTERVAL 30 MINUTE AS stop FROM events WHERE event_id % 20 = 0)
SELECT e.event_id, count(*) AS spans FROM events e JOIN s ON s.user_id = e.user_id AND e.ts >= s.start AND e.ts < s.stop GROUP BY 1""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    spans = t.raw("events").where("event_id % 20 = 0").select("user_id", ts.alias("start"), (ts + F.expr("interval 30 minutes")).alias("stop"))
    hits = j.points_in_spans(t.raw("events").select("event_id", "user_id", ts.alias("ts")), spans, ["user_id"], "ts", 1800)
    return hits.groupBy("event_id").agg(F.count("*").alias("spans"))


@query("link_changes", "relations", """WITH r AS (SELECT book_id, related_id, min(status) AS status FROM relations GROUP BY ALL)
SELECT book_id, related_id, CASE WHEN book_id % 5 = 0 THEN 2 ELSE status END AS status FROM r WHERE book_id % 7 <> 1 AND NOT (book_id % 5 = 0 AND status <> 0)
UNION ALL SELECT book_id, related_id, 1 FROM r WHERE book_id % 7 = 1""")
def _(t):
    rel = t.relations.groupBy("book_id", "related_id").agg(F.min("status").alias("status"))
    return j.change_links(rel, rel.where("book_id % 5 = 0 and book_id % 7 <> 1"), rel.where("book_id % 7 = 1"))
