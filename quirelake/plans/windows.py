"""Caps, budgets, gaps, positions and range lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import ranking
from ..operators import windows as w
from .registry import query


@query("cap_per_chapter", "chunks", """SELECT book_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY book_id, CASE WHEN chapter = '' THEN chunk_index::VARCHAR ELSE chapter END
ORDER BY length(content) DESC, chunk_index) AS n FROM chunks) WHERE n <= 3""")
def _(t):
    from ..operators.retrieval import dedup_by_chapter

    return dedup_by_chapter(t.chunks, [F.desc(F.length("content")), "chunk_index"], 3).select("book_id", "chunk_index")


@query("cap_per_source", "books", """SELECT id, author FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY reading_time DESC, id) AS n FROM books)
WHERE n <= CASE WHEN author IN ('src0', 'src1') THEN 8 WHEN author = 'src2' THEN 2 WHEN author IN ('src3', 'src4') THEN 3 ELSE 1000000 END ORDER BY reading_time DESC, id LIMIT 30""")
def _(t):
    most = F.when(F.col("author").isin("src0", "src1"), 8).when(F.col("author") == "src2", 2).when(F.col("author").isin("src3", "src4"), 3).otherwise(1_000_000)
    return ranking.cap_by(t.books, ["author"], [F.desc("reading_time"), "id"], most).orderBy(F.desc("reading_time"), "id").limit(30).select("id", "author")


@query("character_budget", "chunks", """SELECT book_id, chunk_index, length(CASE WHEN length(content) > 4700 - used THEN substr(content, 1, (4700 - used)::BIGINT) || '…' ELSE content END) AS n FROM (
SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY book_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM chunks) WHERE used < 4700""")
def _(t):
    return w.within_budget(t.chunks, ["book_id"], ["chunk_index"], "content", 4700).select("book_id", "chunk_index", F.length("content").alias("n"))


@query("chapter_directory", "chunks", """WITH d AS (SELECT book_id, chapter, min(chunk_index) AS first FROM chunks GROUP BY ALL),
r AS (SELECT *, sum(length(chapter) + 1) OVER (PARTITION BY book_id ORDER BY first) AS used FROM d)
SELECT book_id, string_agg(chapter, chr(10) ORDER BY first) FILTER (used <= 30) || CASE WHEN max(used) > 30 THEN chr(10) || '…（其余章节略）' ELSE '' END AS listing FROM r GROUP BY book_id""")
def _(t):
    chapters = t.chunks.groupBy("book_id", "chapter").agg(F.min("chunk_index").alias("first"))
    used = F.sum(F.length("chapter") + 1).over(w.upto(["book_id"], ["first"]))
    rows = chapters.withColumn("used", used).groupBy("book_id").agg(F.sort_array(F.collect_list(F.when(F.col("used") <= 30, F.struct("first", "chapter")))).alias("c"), F.max("used").alias("all"))
    listing = F.array_join(F.transform("c", lambda x: x["chapter"]), "\n")
    return rows.select("book_id", F.concat(listing, F.when(F.col("all") > 30, "\n…（其余章节略）").otherwise("")).alias("listing"))


@query("gap_to_next", "chunks", "SELECT book_id, chunk_index, lead(char_offset, 1, char_offset + length(content)) OVER (PARTITION BY book_id ORDER BY chunk_index) - char_offset AS gap FROM chunks")
def _(t):
    by = Window.partitionBy("book_id").orderBy("chunk_index")
    nxt = F.coalesce(F.lead("char_offset").over(by), F.col("char_offset") + F.length("content"))
    return t.chunks.select("book_id", "chunk_index", (nxt - F.col("char_offset")).alias("gap"))


@query("first_per_title", "books", "SELECT title, min(id) AS id FROM books WHERE total_characters >= 100 GROUP BY title")
def _(t):
    return ranking.first_by(t.books.where("total_characters >= 100").select("title", "id"), ["title"], ["id"])


@query("absorb_hidden", "chunks", """WITH r AS (SELECT book_id, chunk_index, length(content) AS n, greatest(1, sum(CASE WHEN chunk_index % 3 <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY chunk_index)) AS island FROM chunks)
SELECT book_id, island::BIGINT AS island, min(chunk_index) AS first, sum(n)::BIGINT AS chars FROM r GROUP BY ALL""")
def _(t):
    rows = w.islands(t.chunks, ["book_id"], ["chunk_index"], F.col("chunk_index") % 3 != 1)
    return rows.groupBy("book_id", "island").agg(F.min("chunk_index").alias("first"), F.sum(F.length("content")).alias("chars"))


PAGES = """p AS (SELECT book_id, chunk_index, greatest(1, ceil(length(content) / 300.0))::BIGINT AS pages FROM chunks),
s AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY book_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p)"""


def _starts(t):
    rows = t.chunks.select("book_id", "chunk_index", w.positions(F.length("content"), 300).alias("pages"))
    return rows.withColumn("start", F.coalesce(F.sum("pages").over(w.before(["book_id"], ["chunk_index"])), F.lit(0)))


@query("page_offsets", "chunks", f"WITH {PAGES} SELECT book_id, chunk_index, start FROM s")
def _(t):
    return _starts(t).select("book_id", "chunk_index", "start")


@query("page_to_chapter", "chunks", f"""WITH {PAGES}, q AS (SELECT doc_id AS book_id, (doc_id * 13) % 40 AS page FROM documents),
m AS (SELECT q.book_id, q.page, max(s.start) AS start FROM q JOIN s ON s.book_id = q.book_id AND s.start <= q.page GROUP BY ALL)
SELECT m.book_id, m.page, s.chunk_index, least(m.page - s.start, s.pages - 1) AS rest FROM m JOIN s ON s.book_id = m.book_id AND s.start = m.start""")
def _(t):
    target = t.raw("documents").select(F.col("doc_id").alias("book_id"), ((F.col("doc_id") * 13) % 40).alias("start"), F.col("doc_id").alias("target_id"))
    points = _starts(t).withColumn("hit", F.struct("chunk_index", F.col("start").alias("at"), "pages"))
    found = w.last_at_or_before(points, target, ["book_id"], "start", "hit")
    return found.select("book_id", F.col("start").alias("page"), "hit.chunk_index", F.least(F.col("start") - F.col("hit.at"), F.col("hit.pages") - 1).alias("rest"))


@query("total_progression", "chunks", """WITH p AS (SELECT book_id, chunk_index, greatest(1, ceil(length(content) / 512.0))::BIGINT AS n FROM chunks),
e AS (SELECT book_id, chunk_index, i, row_number() OVER (PARTITION BY book_id ORDER BY chunk_index, i) AS position, count(*) OVER (PARTITION BY book_id) AS total FROM p, unnest(range(n)) AS u(i))
SELECT book_id, chunk_index, position, round((position - 1) / total::DOUBLE, 6) AS total_progression FROM e""")
def _(t):
    rows = t.chunks.select("book_id", "chunk_index", F.explode(F.sequence(F.lit(1), w.positions(F.length("content")))).alias("i"))
    by = Window.partitionBy("book_id")
    placed = rows.withColumn("position", F.row_number().over(by.orderBy("chunk_index", "i")).cast("long")).withColumn("total", F.count("*").over(by))
    return placed.select("book_id", "chunk_index", "position", F.round((F.col("position") - 1) / F.col("total"), 6).alias("total_progression"))


@query("closest_position", "readings", """SELECT r.event_id AS target_id, max(p.event_id) AS last_view FROM events r LEFT JOIN events p ON p.user_id = r.user_id AND p.event_type = 'view' AND p.event_id <= r.event_id
WHERE r.event_type = 'purchase' GROUP BY 1""")
def _(t):
    e = t.raw("events").select("user_id", "event_id", "event_type")
    points = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("last_view"))
    targets = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("target_id"))
    return w.last_at_or_before(points, targets, ["user_id"], "at", "last_view").select("target_id", "last_view")


@query("recency_popularity", "books", "SELECT id, least(6, 9 - n)::INT AS popularity FROM (SELECT id, row_number() OVER (PARTITION BY author ORDER BY last_read DESC, id) AS n FROM books) WHERE n <= 8")
def _(t):
    by = Window.partitionBy("author").orderBy(F.desc("last_read"), "id")
    return t.books.withColumn("n", F.row_number().over(by)).where("n <= 8").select("id", F.least(F.lit(6), F.lit(9) - F.col("n")).alias("popularity"))


@query("line_progress", "", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i - 1 AS line_no, round(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) / (sum(length(line) + 1) OVER (PARTITION BY doc_id))::DOUBLE, 6) AS progress FROM l""")
def _(t):
    lines = t.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n = F.length("line") + 1
    done = F.sum(n).over(w.upto(["doc_id"], ["line_no"])) / F.sum(n).over(Window.partitionBy("doc_id"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.round(done, 6).alias("progress"))


@query("silence_runs", "", """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + (value * 100)::BIGINT AS b FROM events),
r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, run HAVING max(b) - min(a) >= 2000""")
def _(t):
    e = t.raw("events").select("user_id", s.div(F.unix_millis(F.col("ts").cast("timestamp")), 1000).alias("a"), F.bround(F.col("value") * 100).cast("long").alias("v"))
    return w.merge_runs(e.select("user_id", "a", (F.col("a") + F.col("v")).alias("b")), ["user_id"], "a", "b", 3600, 2000)


@query("last_messages", "messages", "SELECT conversation_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS n FROM messages) WHERE n <= 4")
def _(t):
    return ranking.cap_by(t.messages, ["conversation_id"], [F.desc("turn")], 4).select("conversation_id", "turn")


@query("previous_context", "messages", "SELECT conversation_id, turn, right(lag(content) OVER (PARTITION BY conversation_id ORDER BY turn), 60) AS context FROM messages")
def _(t):
    by = Window.partitionBy("conversation_id").orderBy("turn")
    return t.messages.select("conversation_id", "turn", F.right(F.lag("content").over(by), F.lit(60)).alias("context"))


@query("interval_at_time", "messages", """WITH d AS (SELECT conversation_id, turn, length(content) AS n, coalesce(sum(length(content)) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(length(content)) OVER (PARTITION BY conversation_id) AS total FROM messages)
SELECT conversation_id, max(turn) AS turn FROM d WHERE start <= total // 2 GROUP BY 1""")
def _(t):
    by = Window.partitionBy("conversation_id")
    rows = t.messages.select("conversation_id", "turn", F.length("content").alias("n"))
    rows = rows.withColumn("start", F.coalesce(F.sum("n").over(w.before(["conversation_id"], ["turn"])), F.lit(0))).withColumn("total", F.sum("n").over(by))
    return rows.where(F.col("start") <= s.div(F.col("total"), 2)).groupBy("conversation_id").agg(F.max("turn").alias("turn"))


@query("running_characters", "books", "SELECT id, coalesce(sum(total_characters) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM books")
def _(t):
    return w.running_total(t.books.select("id", "total_characters"), "id", "total_characters", 16).select("id", "before")
