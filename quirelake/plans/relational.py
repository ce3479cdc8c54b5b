"""Lookups, predicates, orders, set operations and writes over the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as r
from .registry import query

BOOK = "id, title, author, format"


@query("scan_books", "books", "SELECT id, author, format, total_characters FROM books")
def _(t):
    return t.books.select("id", "author", "format", "total_characters")


@query("lookup_by_id", "books", f"SELECT {BOOK} FROM books WHERE id = 42 LIMIT 1")
def _(t):
    return t.books.where("id = 42").select("id", "title", "author", "format").limit(1)


@query("lookup_by_name", "tags", "SELECT id, name FROM tags WHERE name = 'Brand#7' LIMIT 1")
def _(t):
    return t.tags.where("name = 'Brand#7'").limit(1)


@query("paged_chunks", "chunks", "SELECT book_id, chunk_index, length(content) AS n FROM chunks ORDER BY book_id, chunk_index LIMIT 200 OFFSET 400")
def _(t):
    return r.paged(t.chunks.select("book_id", "chunk_index", F.length("content").alias("n")), ["book_id", "chunk_index"], 200, 400)


@query("like_two_columns", "books", "SELECT id FROM books WHERE title ILIKE '%tion%' OR author ILIKE '%rc1%'")
def _(t):
    return t.books.where(r.like_any("tion", "title") | r.like_any("rc1", "author")).select("id")


@query("author_part_match", "books", "SELECT id, author FROM books WHERE id <> 5 AND lower(author) LIKE '%' || lower('SRC1') || '%'")
def _(t):
    return t.books.where((F.col("id") != 5) & r.contains_nocase("author", "SRC1")).select("id", "author")


@query("search_excluding", "books", "SELECT id, title FROM books WHERE id NOT IN (1, 2, 3) AND (lower(title) LIKE '%the%' OR lower(author) LIKE '%the%') ORDER BY lower(title), id LIMIT 50")
def _(t):
    hit = r.contains_nocase("title", "the") | r.contains_nocase("author", "the")
    return t.books.where(~F.col("id").isin(1, 2, 3) & hit).select("id", "title").orderBy(F.lower("title"), "id").limit(50)


@query("count_by_base_name", "", "SELECT count(*) AS n FROM pages WHERE url LIKE '%example.%' OR url LIKE '%example_fixed.%'")
def _(t):
    return t.raw("pages").where(F.col("url").like("%example.%") | F.col("url").like("%example_fixed.%")).agg(F.count("*").alias("n"))


@query("in_list", "chunks", "SELECT book_id, chunk_index FROM chunks WHERE book_id IN (3, 5, 8) AND chapter IN ('part 0', 'part 2')")
def _(t):
    return t.chunks.where(F.col("book_id").isin(3, 5, 8) & F.col("chapter").isin("part 0", "part 2")).select("book_id", "chunk_index")


@query("date_range", "readings", "SELECT day::VARCHAR AS day, sum(seconds)::BIGINT AS seconds FROM readings WHERE day >= DATE '2024-01-10' GROUP BY day")
def _(t):
    return t.readings.where(F.col("day") >= F.lit("2024-01-10").cast("date")).groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("seconds").alias("seconds"))


@query("empty_with_limit", "chunks", "SELECT book_id, chunk_index FROM chunks WHERE content = '' OR length(content) < 300 ORDER BY book_id, chunk_index LIMIT 10")
def _(t):
    return t.chunks.where((F.col("content") == "") | (F.length("content") < 300)).select("book_id", "chunk_index").orderBy("book_id", "chunk_index").limit(10)


@query("slash_titles", "", "SELECT page_id, url FROM pages WHERE url LIKE '%/en/%'")
def _(t):
    return t.raw("pages").where(F.col("url").contains("/en/")).select("page_id", "url")


@query("pair_lookup", "relations", "SELECT * FROM relations WHERE (book_id = 3 AND related_id = 54) OR (book_id = 54 AND related_id = 3)")
def _(t):
    return t.relations.where(r.same_pair("book_id", "related_id", 54, 3))


@query("all_terms_search", "books", "SELECT id FROM books WHERE (lower(title) LIKE '%the%' OR lower(author) LIKE '%the%' OR lower(format) LIKE '%the%') AND (lower(title) LIKE '%en%' OR lower(author) LIKE '%en%' OR lower(format) LIKE '%en%')")
def _(t):
    return t.books.where(r.all_terms("The EN", "title", "author", "format")).select("id")


@query("unfinished_books", "books book_tags", "SELECT id FROM books WHERE id NOT IN (SELECT book_id FROM book_tags WHERE tag_id = 7) AND NOT (total_pages > 0 AND current_page >= total_pages)")
def _(t):
    read = t.book_tags.where("tag_id = 7").select(F.col("book_id").alias("id"))
    return t.books.where("not (total_pages > 0 and current_page >= total_pages)").join(read, "id", "left_anti").select("id")


@query("exists_check", "book_tags", "SELECT count(*) > 0 AS found FROM (SELECT 1 FROM book_tags WHERE book_id = 7 LIMIT 1)")
def _(t):
    return t.book_tags.where("book_id = 7").limit(1).agg((F.count("*") > 0).alias("found"))


@query("order_by_recent", "books", "SELECT id, last_read FROM books ORDER BY last_read DESC, id LIMIT 100")
def _(t):
    return t.books.select("id", "last_read").orderBy(F.desc("last_read"), "id").limit(100)


@query("order_nocase", "", "SELECT s_suppkey, s_name FROM supplier ORDER BY lower(s_name), s_suppkey LIMIT 40")
def _(t):
    return t.raw("supplier").select("s_suppkey", "s_name").orderBy(r.nocase("s_name"), "s_suppkey").limit(40)


@query("order_composite", "keywords", "SELECT book_id, rank, keyword FROM keywords ORDER BY book_id, rank")
def _(t):
    return t.keywords.select("book_id", "rank", "keyword").orderBy("book_id", "rank")


@query("pinned_first", "books book_tags", """SELECT id, pinned, last_read FROM (SELECT id, last_read, id IN (SELECT book_id FROM book_tags WHERE tag_id = 3) AS pinned FROM books)
ORDER BY pinned DESC, last_read DESC, id LIMIT 60""")
def _(t):
    pins = t.book_tags.where("tag_id = 3").select(F.col("book_id").alias("id"), F.lit(True).alias("p"))
    rows = t.books.join(pins, "id", "left").select("id", F.coalesce("p", F.lit(False)).alias("pinned"), "last_read")
    return rows.orderBy(F.desc("pinned"), F.desc("last_read"), "id").limit(60)


@query("order_lower_title", "books", "SELECT id, title, author FROM books ORDER BY lower(title), lower(author), id LIMIT 30")
def _(t):
    return t.books.select("id", "title", "author").orderBy(F.lower("title"), F.lower("author"), "id").limit(30)


@query("top_k", "", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def _(t):
    return t.raw("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("fresh_then_seen", "books", "SELECT id, seen, score FROM (SELECT id, last_read % 3 = 0 AS seen, reading_time AS score FROM books) ORDER BY seen, score DESC, id LIMIT 8")
def _(t):
    rows = t.books.select("id", (F.col("last_read") % 3 == 0).alias("seen"), F.col("reading_time").alias("score"))
    return rows.orderBy("seen", F.desc("score"), "id").limit(8)


@query("mixed_quota", "books", """WITH o AS (SELECT id, reading_time AS score FROM books WHERE format <> 'en' ORDER BY score DESC, id LIMIT 6),
l AS (SELECT id, reading_time AS score FROM books WHERE format = 'en' ORDER BY score DESC, id LIMIT (SELECT 10 - CASE WHEN count(*) = 0 THEN 0 ELSE greatest(3, least(6, count(*))) END FROM o))
SELECT *, 'online' AS origin FROM o UNION ALL SELECT *, 'local' AS origin FROM l""")
def _(t):
    from ..operators.ranking import mixed_quota

    rows = t.books.select("id", F.col("reading_time").alias("score"), "format")
    return mixed_quota(rows.where("format <> 'en'").drop("format"), rows.where("format = 'en'").drop("format"), 10, 3, 6)


@query("seeded_sample")
def _(t):
    """Ten books by hash order; SQL has no such hash."""
    from ..operators.ranking import seeded_sample

    return seeded_sample(t.books.select("id"), "id", 10, seed=11)


@query("weighted_sample")
def _(t):
    """Ten distinct books, likelier by reading time; SQL has no such hash."""
    from ..operators.ranking import weighted_sample

    return weighted_sample(t.books.select("id", "reading_time"), "id", "reading_time", 10, seed=11)


@query("union_all", "books readings", "SELECT id AS key, 'book' AS kind FROM books UNION ALL SELECT book_id, 'reading' FROM readings")
def _(t):
    return t.books.select(F.col("id").alias("key"), F.lit("book").alias("kind")).unionByName(t.readings.select(F.col("book_id").alias("key"), F.lit("reading").alias("kind")))


@query("ordered_dedup", "books", "SELECT id, author, format FROM (SELECT *, row_number() OVER (PARTITION BY author, format ORDER BY added, id) AS n FROM books) WHERE n = 1")
def _(t):
    from ..operators.ranking import first_by

    return first_by(t.books.select("id", "author", "format", "added"), ["author", "format"], ["added", "id"]).select("id", "author", "format")


@query("intersect_except", "book_tags", """(SELECT book_id FROM book_tags WHERE tag_id = 1 INTERSECT SELECT book_id FROM book_tags WHERE tag_id = 2)
EXCEPT SELECT book_id FROM book_tags WHERE tag_id = 3""")
def _(t):
    of = lambda k: t.book_tags.where(F.col("tag_id") == k).select("book_id")
    return of(1).intersect(of(2)).exceptAll(of(3))


@query("upsert_replace", "books", "SELECT id, author, reading_time FROM books WHERE id >= 100 UNION ALL SELECT id, 'new', 0 FROM books WHERE id < 100")
def _(t):
    table = t.books.select("id", "author", "reading_time")
    rows = table.where("id < 100").select("id", F.lit("new").alias("author"), F.lit(0).cast("long").alias("reading_time"))
    return r.upsert(table, rows, ["id"], [F.desc("reading_time")])


@query("insert_ignore", "book_tags", "SELECT book_id, tag_id FROM book_tags UNION SELECT book_id, 99 FROM book_tags WHERE tag_id = 4")
def _(t):
    rows = t.book_tags.where("tag_id = 4").select("book_id", F.lit(99).cast("long").alias("tag_id"))
    return r.insert_ignore(t.book_tags, rows, ["book_id", "tag_id"])


@query("update_columns", "books", "SELECT id, CASE WHEN id % 10 = 0 THEN 'renamed' ELSE author END AS author, current_page + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS current_page FROM books")
def _(t):
    table = t.books.select("id", "author", "current_page")
    changes = table.where("id % 10 = 0").select("id", F.lit("renamed").alias("author"), (F.col("current_page") + 1).alias("current_page"))
    return r.update(table, changes, ["id"])


@query("accumulate_time", "books readings", "SELECT b.id, (b.reading_time + coalesce(s.seconds, 0))::BIGINT AS reading_time FROM books b LEFT JOIN (SELECT book_id, sum(seconds) AS seconds FROM readings GROUP BY 1) s ON s.book_id = b.id")
def _(t):
    deltas = t.readings.select(F.col("book_id").alias("id"), F.col("seconds").alias("reading_time"))
    return r.accumulate(t.books.select("id", "reading_time"), deltas, "id", "reading_time")


@query("delete_rows", "books", "SELECT id, author FROM books WHERE id NOT IN (SELECT id FROM books WHERE author = 'src3')")
def _(t):
    table = t.books.select("id", "author")
    return r.delete(table, table.where("author = 'src3'"), ["id"])


@query("cascade_delete", "", """WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS tab, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))""")
def _(t):
    tables = {"customer": t.raw("customer").select("c_custkey", "c_nationkey"), "orders": t.raw("orders").select("o_orderkey", "o_custkey"), "lineitem": t.raw("lineitem").select("l_orderkey")}
    parents = {"orders": ("customer", "c_custkey", "o_custkey"), "lineitem": ("orders", "o_orderkey", "l_orderkey")}
    gone = tables["customer"].where("c_nationkey = 3").select("c_custkey")
    left = r.cascade_delete(tables, parents, "customer", gone)
    count = lambda k: left[k].agg(F.lit(k).alias("tab"), F.count("*").alias("n"))
    return count("customer").union(count("orders")).union(count("lineitem"))


@query("replace_keywords", "keywords", "SELECT book_id, keyword, rank::BIGINT AS rank FROM keywords WHERE book_id <> 5 UNION ALL SELECT 5, 'fresh', 0")
def _(t):
    table = t.keywords.select("book_id", "keyword", F.col("rank").cast("long").alias("rank"))
    rows = t.spark.range(1).select(F.lit(5).cast("long").alias("book_id"), F.lit("fresh").alias("keyword"), F.lit(0).cast("long").alias("rank"))
    return r.replace_group(table, rows, "book_id")


@query("daily_rollup", "readings", "SELECT day::VARCHAR AS day, book_id, sum(seconds)::BIGINT AS seconds FROM readings GROUP BY ALL")
def _(t):
    half = F.col("book_id") % 2 == 0
    return r.daily_rollup(t.readings.where(half).groupBy("day", "book_id").agg(F.sum("seconds").alias("seconds")), t.readings.where(~half), ["day", "book_id"], "seconds").withColumn("day", F.col("day").cast("string"))


@query("done_ids", "", "SELECT DISTINCT o_custkey AS book_id FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return t.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("book_id")).distinct()


@query("batch_import", "", """WITH f AS (SELECT page_id, 'b' || (page_id % 40)::VARCHAR AS base, CASE WHEN page_id % 11 = 0 THEN 'bad file ' || page_id::VARCHAR END AS error FROM pages),
s AS (SELECT 'b' || (page_id % 40)::VARCHAR AS base FROM pages WHERE page_id < 10),
n AS (SELECT *, row_number() OVER (PARTITION BY base, error IS NULL ORDER BY page_id) AS n FROM f),
x AS (SELECT *, CASE WHEN base IN (SELECT base FROM s) OR (error IS NULL AND n > 1) THEN 'duplicate' WHEN error IS NOT NULL THEN 'failure' ELSE 'success' END AS status FROM n)
SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'failure') AS failure,
  arg_min(error, page_id) FILTER (status = 'failure') AS first_error FROM x""")
def _(t):
    base = F.concat(F.lit("b"), (F.col("page_id") % 40).cast("string")).alias("base")
    files = t.raw("pages").select("page_id", base, F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("bad file "), F.col("page_id").cast("string"))).alias("error"))
    return r.import_report(r.batch_import(files.where("page_id < 10").select("base"), files, "base", "page_id"), "page_id")


@query("batch_tagging", "book_tags", "SELECT book_id, tag_id FROM book_tags WHERE NOT (tag_id = 5 AND book_id % 2 = 0) UNION SELECT DISTINCT book_id, 6 FROM book_tags WHERE book_id % 2 = 0")
def _(t):
    books = t.book_tags.where("book_id % 2 = 0").select("book_id").distinct()
    return r.untag_books(r.tag_books(t.book_tags, books, 6), books, 5)


@query("conversation_export", "messages", "SELECT conversation_id, string_agg(concat_ws(': ', role, content), chr(10) ORDER BY turn) AS transcript, count(*) AS n_messages FROM messages GROUP BY 1")
def _(t):
    return r.export_conversation(t.messages)
