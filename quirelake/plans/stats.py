"""Counts, sums and reading statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators.joins import NO_AUTHOR
from .registry import query


@query("chunk_counts", "chunks", "SELECT book_id, count(*) AS n FROM chunks GROUP BY book_id")
def _(t):
    return t.chunks.groupBy("book_id").agg(F.count("*").alias("n"))


@query("total_chars", "chunks", "SELECT coalesce(sum(length(content)), 0)::BIGINT AS chars FROM chunks")
def _(t):
    return t.chunks.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars"))


@query("multi_column_chars", "", "SELECT coalesce(sum(length(c_name)) + sum(length(c_mktsegment)), 0)::BIGINT AS chars FROM customer")
def _(t):
    return t.raw("customer").agg(F.coalesce(F.sum(F.length("c_name")) + F.sum(F.length("c_mktsegment")), F.lit(0)).cast("long").alias("chars"))


@query("total_seconds", "readings messages", "SELECT coalesce(sum(seconds), 0)::BIGINT AS seconds, (SELECT coalesce(sum(length(content)), 0)::BIGINT FROM messages) AS chars FROM readings")
def _(t):
    seconds = t.readings.agg(F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"))
    return seconds.crossJoin(t.messages.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars")))  # one row each


@query("chapters_in_order", "chunks", "SELECT chapter, min(chunk_index) AS first FROM chunks WHERE book_id = 17 AND chapter <> '' GROUP BY chapter")
def _(t):
    return t.chunks.where("book_id = 17 and chapter <> ''").groupBy("chapter").agg(F.min("chunk_index").alias("first")).orderBy("first")


READ = "SELECT book_id FROM book_tags WHERE tag_id = 2"


@query("chars_read", "books book_tags", f"""WITH x AS (SELECT total_characters AS c, CASE WHEN id IN ({READ}) THEN total_characters WHEN total_characters <= 0 THEN 0
WHEN total_pages > 0 THEN total_characters * current_page // total_pages ELSE 0 END AS r FROM books)
SELECT sum(r)::BIGINT AS chars_read, sum(c)::BIGINT AS chars, (sum(r) * 100 // sum(c))::BIGINT AS percent FROM x""")
def _(t):
    read = t.book_tags.where("tag_id = 2").select(F.col("book_id").alias("id"), F.lit(True).alias("read"))
    rows = t.books.join(read, "id", "left")
    part = F.when(F.col("read"), F.col("total_characters")).when(F.col("total_characters") <= 0, 0).when(F.col("total_pages") > 0, s.div(F.col("total_characters") * F.col("current_page"), F.col("total_pages"))).otherwise(0)
    sums = rows.agg(F.sum(part).alias("chars_read"), F.sum("total_characters").alias("chars"))
    return sums.withColumn("percent", s.whole_percent(F.col("chars_read"), F.col("chars")))


@query("format_distribution", "books", "SELECT upper(format) AS format, count(*) AS n, (count(*) * 100 // (SELECT count(*) FROM books))::BIGINT AS percent FROM books GROUP BY 1")
def _(t):
    from pyspark.sql import Window

    counts = t.books.groupBy(F.upper("format").alias("format")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", s.whole_percent(F.col("n"), F.sum("n").over(Window.partitionBy())))  # a row per format


@query("top_authors", "books", "SELECT author, count(*) AS n FROM books WHERE trim(author) <> '' AND author NOT IN ('未知作者', '佚名', 'Unknown') GROUP BY 1 ORDER BY n DESC, author LIMIT 5")
def _(t):
    named = t.books.where((F.trim("author") != "") & ~F.col("author").isin(*NO_AUTHOR[:3]))
    return named.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(5)


@query("week_total_and_max", "readings", """WITH d AS (SELECT day, sum(seconds) AS s FROM readings WHERE day BETWEEN DATE '2024-01-25' AND DATE '2024-01-31' GROUP BY 1)
SELECT coalesce(sum(s), 0)::BIGINT AS total, greatest(coalesce(max(s), 0), 1)::BIGINT AS largest FROM d""")
def _(t):
    days = t.readings.where("day between date'2024-01-25' and date'2024-01-31'").groupBy("day").agg(F.sum("seconds").alias("s"))
    return days.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("total"), F.greatest(F.coalesce(F.max("s"), F.lit(0)), F.lit(1)).cast("long").alias("largest"))


@query("size_by_extension", "", "SELECT lower(regexp_extract(url, '/([a-z]{2})/', 1)) AS ext, count(*) AS files, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1")
def _(t):
    ext = F.lower(F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("ext")
    return t.raw("pages").groupBy(ext).agg(F.count("*").alias("files"), F.sum(F.octet_length("html")).alias("bytes"))


@query("document_frequency", "keywords", "SELECT keyword, count(DISTINCT book_id) AS df FROM keywords GROUP BY keyword")
def _(t):
    return t.keywords.groupBy("keyword").agg(F.countDistinct("book_id").alias("df"))


@query("keyword_profile", "books keywords", """SELECT keyword, round(sum(reading_time * weight), 4) AS score FROM keywords JOIN books ON id = book_id
WHERE reading_time > 0 AND keyword NOT IN ('thanth', 'onthat') GROUP BY 1 ORDER BY score DESC, keyword LIMIT 15""")
def _(t):
    from ..operators.recommend import keyword_profile

    return keyword_profile(t.keywords, t.books.select(F.col("id").alias("book_id"), "reading_time"), ["thanth", "onthat"], 15).select("keyword", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "keyword")


@query("author_profile", "books", "SELECT author, sum(reading_time)::BIGINT AS score FROM books WHERE reading_time > 0 GROUP BY 1 ORDER BY score DESC, author LIMIT 6")
def _(t):
    return t.books.where("reading_time > 0").groupBy("author").agg(F.sum("reading_time").alias("score")).orderBy(F.desc("score"), "author").limit(6)


@query("seed_pool", "keywords", "SELECT keyword, round(sum(weight / 2 + 0.5), 6) AS pool FROM keywords WHERE book_id IN (3, 14, 15, 92, 65) GROUP BY 1")
def _(t):
    seeds = t.keywords.where(F.col("book_id").isin(3, 14, 15, 92, 65))
    return seeds.groupBy("keyword").agg(F.round(F.sum(F.col("weight") / 2 + 0.5), 6).alias("pool"))


@query("inverted_index", "keywords", "SELECT keyword, (book_id // 4096)::BIGINT AS block, list_sort(list(DISTINCT book_id)) AS books FROM keywords GROUP BY 1, 2")
def _(t):
    # postings in blocks of ids, so that a frequent keyword's are bounded
    block = s.div(F.col("book_id"), 4096).cast("long").alias("block")
    return t.keywords.groupBy("keyword", block).agg(F.sort_array(F.collect_set("book_id")).alias("books"))


@query("positions_per_resource", "", """WITH p AS (SELECT page_id, greatest(1, ceil(strlen(html) / 1024.0))::BIGINT AS n FROM pages)
SELECT page_id, n, (SELECT sum(n)::BIGINT FROM p) AS total FROM p""")
def _(t):
    from ..operators.windows import positions

    rows = t.raw("pages").select("page_id", positions(F.octet_length("html"), 1024).alias("n"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("total"))))  # one row


@query("distinct_tags", "book_tags", "SELECT book_id, count(DISTINCT tag_id) AS n FROM book_tags GROUP BY 1")
def _(t):
    return t.book_tags.groupBy("book_id").agg(F.countDistinct("tag_id").alias("n"))


@query("token_estimate", "messages", "SELECT conversation_id, (sum(length(content)) // 2)::BIGINT AS tokens FROM messages GROUP BY 1")
def _(t):
    return t.messages.groupBy("conversation_id").agg(s.div(F.sum(F.length("content")), 2).alias("tokens"))


@query("rollup_by_format_author", "books", "SELECT format, author, count(*) AS n, sum(total_characters)::BIGINT AS chars FROM books GROUP BY ROLLUP (format, author)")
def _(t):
    return t.books.rollup("format", "author").agg(F.count("*").alias("n"), F.sum("total_characters").alias("chars"))


@query("elapsed", "", "SELECT event_id, (epoch_us(ts) // 1000 - 1704067200000) // 1000 AS seconds FROM events")
def _(t):
    return t.raw("events").select("event_id", s.elapsed_seconds(F.lit(1704067200000), F.unix_millis(F.col("ts").cast("timestamp"))).alias("seconds"))


@query("days_ago", "", "SELECT strftime(max(ts), '%Y-%m-%d') AS today, strftime(max(ts) - INTERVAL 6 DAY, '%Y-%m-%d') AS week_start FROM events")
def _(t):
    return t.raw("events").agg(F.max("ts").alias("m")).select(F.date_format("m", "yyyy-MM-dd").alias("today"), F.date_format(F.date_sub("m", 6), "yyyy-MM-dd").alias("week_start"))


@query("ttl_prune", "", "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY) AS shown, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 3 DAY) AS seeds FROM events")
def _(t):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return t.raw("events").agg(F.count_if(s.within_days(ts, now, 1)).alias("shown"), F.count_if(s.within_days(ts, now, 3)).alias("seeds"))


@query("number_formats", "books", """SELECT id, CASE WHEN n >= 10000000 THEN printf('%.3f', n / 1e8) || '亿' WHEN n >= 10000 THEN printf('%.1f', n / 1e4) || '万' ELSE n::VARCHAR END AS shown,
CASE WHEN r >= 3600 THEN (r // 3600)::VARCHAR || '小时' || (r % 3600 // 60)::VARCHAR || '分钟' WHEN r >= 60 THEN (r // 60)::VARCHAR || '分钟' ELSE r::VARCHAR || '秒' END AS time
FROM (SELECT id, (total_characters * 7919 % 30000001) // 1000 * 1000 + 3 AS n, reading_time AS r FROM books)""")
def _(t):
    return t.books.select("id", s.large_number(s.div(F.col("total_characters") * 7919 % 30000001, 1000) * 1000 + 3).alias("shown"), s.duration(F.col("reading_time")).alias("time"))


@query("storage_report", "chunks messages books", """SELECT (SELECT sum(length(content))::BIGINT FROM chunks) AS index_chars, (SELECT sum(length(content))::BIGINT FROM messages) AS message_chars,
(SELECT count(*) FROM books) AS books, (SELECT sum(strlen(html))::BIGINT FROM pages) AS page_bytes""")
def _(t):
    one = [t.chunks.agg(F.sum(F.length("content")).alias("index_chars")), t.messages.agg(F.sum(F.length("content")).alias("message_chars")), t.books.agg(F.count("*").alias("books")), t.raw("pages").agg(F.sum(F.octet_length("html")).alias("page_bytes"))]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # one row each
    return out


@query("vector_norms", "", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def _(t):
    v = F.col("embedding").cast("array<double>")
    unit = s.l2_normalised(F.transform(v, lambda x: x * 3))
    # the norm of the vector, as its product with three times itself brought back to unit length
    return t.raw("embeddings").select("vec_id", F.round(s.dot(v, unit), 6).alias("norm"))


@query("jaccard_pairs", "", """SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS j FROM (
SELECT doc_id, list_distinct(regexp_extract_all(lower(left(text, length(text) // 2)), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(right(text, length(text) - length(text) // 2)), '[a-z]+')) AS b FROM documents) WHERE len(a) > 0 AND len(b) > 0""")
def _(t):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    rows = t.raw("documents").select("doc_id", words(F.expr("left(text, length(text) div 2)")).alias("a"), words(F.expr("right(text, length(text) - length(text) div 2)")).alias("b")).where("size(a) > 0 and size(b) > 0")
    return rows.select("doc_id", F.round(s.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@query("text_hashes", "", """SELECT c_custkey, list_reduce(list_prepend(2166136261::HUGEINT, codes), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT AS fnv,
(list_reduce(list_prepend(0::HUGEINT, codes), lambda h, b: (h * 31 + b) % 4294967296)::BIGINT + 2147483648) % 4294967296 - 2147483648 AS hash
FROM (SELECT c_custkey, list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::HUGEINT) AS codes FROM customer)""")
def _(t):
    return t.raw("customer").select("c_custkey", s.fnv1a_32(F.col("c_name")).alias("fnv"), s.string_hash(F.col("c_name")).cast("long").alias("hash"))
