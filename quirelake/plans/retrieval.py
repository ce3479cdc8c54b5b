"""Chunks, keyword and vector retrieval, context assembly, search in books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import retrieval as r
from .registry import query


@query("chunk_index", "chunks", "SELECT book_id, chunk_index, chapter, char_offset, length(content) AS n FROM chunks")
def _(t):
    return t.chunks.select("book_id", "chunk_index", "chapter", "char_offset", F.length("content").alias("n"))


WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query("bm25", "", f"""WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', ' ', 'g') AS text FROM documents)),
q AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS})) AS term FROM (SELECT item_id, regexp_replace(text, '[^a-zA-Z]', ' ', 'g') AS text FROM benchmark WHERE item_id % 20 = 0)),
c AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
p AS (SELECT id, len(w) AS n, unnest(w) AS term FROM d), tf AS (SELECT id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT q.query_id, tf.id, sum(ln(1 + (c.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.n / c.a))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), c GROUP BY ALL)
SELECT query_id, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM sc) WHERE k <= 20""")
def _(t):
    ascii_only = F.regexp_replace("text", "[^a-zA-Z]", " ").alias("text")
    docs = t.raw("documents").select(F.col("doc_id").alias("id"), ascii_only)
    queries = t.raw("benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), ascii_only)
    return r.bm25(docs, queries, 20).select("query_id", "id", F.round("score", 4).alias("score"))


@query("vector_top", "", """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 10""")
def _(t):
    e = t.raw("embeddings")
    return r.vector_top(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


@query("rank_fusion", "books", """WITH a AS (SELECT id, row_number() OVER (ORDER BY reading_time DESC, id) AS n FROM books), b AS (SELECT id, row_number() OVER (ORDER BY last_read DESC, id) AS n FROM books),
u AS (SELECT id, sum(1.0 / (60 + n)) AS score FROM (SELECT * FROM a WHERE n <= 60 UNION ALL SELECT * FROM b WHERE n <= 60) GROUP BY 1) SELECT id, round(score, 6) AS score FROM u ORDER BY round(score, 9) DESC, id LIMIT 40""")
def _(t):
    of = lambda c: t.books.select(F.lit(0).alias("query_id"), "id", F.col(c).alias("score")).orderBy(F.desc("score"), "id").limit(60)  # noqa: E731  a search gives its 60 best
    return r.fuse([of("reading_time"), of("last_read")], 40).select("id", F.round("score", 6).alias("score"))


@query("chapter_filter", "chunks", "SELECT chunk_index, length(content) AS n FROM chunks WHERE book_id = 17 AND chapter IN ('part 0', 'part 1')")
def _(t):
    return t.chunks.where((F.col("book_id") == 17) & F.col("chapter").isin("part 0", "part 1")).select("chunk_index", F.length("content").alias("n"))


ASKED = "text || CASE (conv_id + turn) % 3 WHEN 0 THEN '什么时候认识的' WHEN 1 THEN '主题是什么' ELSE '' END"


@query("temporal_questions", "", f"SELECT conv_id, turn, regexp_matches({ASKED}, '{r.TEMPORAL}') AS temporal FROM conversations WHERE text IS NOT NULL")
def _(t):
    rows = t.raw("conversations").where("text is not null")
    return rows.select("conv_id", "turn", r.is_temporal(F.expr(ASKED)).alias("temporal"))


@query("chronological_order", "chunks", "SELECT book_id, chunk_index FROM (SELECT book_id, chunk_index FROM chunks ORDER BY length(content) DESC, book_id, chunk_index LIMIT 40) ORDER BY 1, 2")
def _(t):
    best = t.chunks.select("book_id", "chunk_index", F.length("content").alias("n")).orderBy(F.desc("n"), "book_id", "chunk_index").limit(40)
    return best.orderBy("book_id", "chunk_index").select("book_id", "chunk_index")


@query("rerank_fallback", "books", "SELECT id FROM books ORDER BY reading_time DESC, id LIMIT 40")
def _(t):
    rows = t.books.select(F.lit(0).alias("query_id"), "id", F.col("reading_time").alias("score"))
    return r.rerank(rows, None, 40).select("id")


@query("context_assembly", "chunks", """WITH b AS (SELECT book_id, chunk_index, '【' || chapter || '】' || content AS block FROM chunks),
u AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY book_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM b),
k AS (SELECT *, CASE WHEN length(block) > 3000 - used THEN substr(block, 1, 3000 - used) || '…' ELSE block END AS cut FROM u WHERE used < 3000)
SELECT book_id AS query_id, string_agg(cut, chr(10) ORDER BY chunk_index) AS context, count(*) AS passages FROM k GROUP BY 1""")
def _(t):
    rows = t.chunks.select(F.col("book_id").alias("query_id"), F.col("chunk_index").alias("position"), F.col("chapter").alias("label"), "content")
    return r.context(rows, 3000)


@query("preview", "", "SELECT doc_id, CASE WHEN length(text) <= 3500 THEN text ELSE left(text, 2000) || chr(10) || '…' || chr(10) || right(text, 1500) END AS preview FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", r.preview(F.col("text")).alias("preview"))


@query("hit_chapter_summaries", "chunks", """WITH h AS (SELECT DISTINCT book_id, chapter FROM chunks WHERE content LIKE '%tion%')
SELECT book_id, chapter, count(*) AS chunks FROM chunks WHERE (book_id, chapter) IN (SELECT book_id, chapter FROM h) GROUP BY ALL""")
def _(t):
    hits = t.chunks.where(F.col("content").contains("tion")).select("book_id", "chapter")
    return t.chunks.join(hits, ["book_id", "chapter"], "left_semi").groupBy("book_id", "chapter").agg(F.count("*").alias("chunks"))


@query("summary_fallback", "chunks", "SELECT book_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN 'done' ELSE left(content, 60) END AS summary FROM chunks")
def _(t):
    given = F.when(F.col("chunk_index") % 2 == 0, "done").otherwise(" ")
    return t.chunks.select("book_id", "chunk_index", r.summary_or_start(given, F.col("content")).alias("summary"))


@query("exact_search", "", """SELECT doc_id AS id, count(*) AS hits, min(start) AS first FROM (
SELECT doc_id, unnest(list_filter(range(0, length(text)), lambda i: lower(substr(text, i + 1, 5)) = 'tiont')) AS start FROM documents WHERE contains(lower(text), 'tiont')) GROUP BY 1""")
def _(t):
    found = r.find_all(t.raw("documents").select(F.col("doc_id").alias("id"), "text"), "tiont")
    return found.groupBy("id").agg(F.count("*").alias("hits"), F.min("start").alias("first"))


@query("search_snippet", "", """SELECT doc_id, replace(right(left(text, p), 25) || '「' || substr(text, p + 1, 4) || '」' || substr(text, p + 5, 25), chr(10), ' ') AS snippet
FROM (SELECT doc_id, text, instr(lower(text), 'tion') - 1 AS p FROM documents) WHERE p >= 0""")
def _(t):
    rows = t.raw("documents").select("doc_id", "text", (F.instr(F.lower("text"), "tion") - 1).alias("p")).where("p >= 0")
    return rows.select("doc_id", r.snippet(F.col("text"), F.col("p"), 4).alias("snippet"))


@query("collated_search", "", "SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'eleve')")
def _(t):
    return t.raw("documents").where(F.expr("contains(text COLLATE UNICODE_CI_AI, 'ELEVE' COLLATE UNICODE_CI_AI)")).select("doc_id")


@query("cosine_pairs", "", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    e = t.raw("embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(s.dot(F.col("embedding"), F.col("w")), 6).alias("cosine"))
