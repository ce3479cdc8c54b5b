"""Cleaning, markup, sentences and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions import text as x
from ..operators import chapters as ch
from .registry import query


@query("xml_safe", "", r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS clean FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", x.xml_safe(F.col("text")).alias("clean"))


@query("xml_escape", "", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS digest FROM pages""")
def _(t):
    return t.raw("pages").select("page_id", F.md5(x.xml_escape(F.col("html")).cast("binary")).alias("digest"))


@query("html_body", "", "SELECT page_id, md5(split_part(substr(html, instr(html, '<body>') + 6), '</body>', 1)) AS digest FROM pages")
def _(t):
    return t.raw("pages").select("page_id", F.md5(x.body(F.col("html")).cast("binary")).alias("digest"))


@query("cut_after_html", "", "SELECT page_id, length(regexp_replace(html || '<img/>', '(?is)(</html\\s*>).*', '\\1')) AS n FROM pages")
def _(t):
    return t.raw("pages").select("page_id", F.length(x.cut_after_html(F.concat("html", F.lit("<img/>")))).cast("long").alias("n"))


@query("html_plain_text", "", """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\\b.*?</head\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<script\\b.*?</script\\s*>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]+>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&') AS h FROM b)
SELECT page_id, md5(trim(regexp_replace(h, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM c""")
def _(t):
    return t.raw("pages").select("page_id", F.md5(x.plain_text(F.col("html")).cast("binary")).alias("digest"))


@query("block_texts")
def _(t):
    """Pages as text with a line for each block; needs a parser, so there is no SQL."""
    return t.raw("pages").select("page_id", x.block_texts("html").alias("text"))


@query("content_elements")
def _(t):
    """Pages as rows of content, in reading order; needs a parser, so there is no SQL."""
    return t.raw("pages").select("page_id", F.posexplode(x.elements("html")).alias("position", "e")).select("page_id", "position", "e.*")


@query("head_style", "", "SELECT page_id, length(regexp_replace(html, '(?i)(<head[^>]*>)', '\\1<style>p{margin:1em}</style>', 'g')) AS n FROM pages")
def _(t):
    return t.raw("pages").select("page_id", F.length(x.with_head_style(F.col("html"), "p{margin:1em}")).cast("long").alias("n"))


@query("stamp_prefix", "", "SELECT doc_id, regexp_replace((1700000000 + doc_id)::VARCHAR || '_' || source, '^[0-9]{10,}_', '') AS name FROM documents")
def _(t):
    stamped = F.concat((F.lit(1700000000) + F.col("doc_id")).cast("string"), F.lit("_"), F.col("source"))
    return t.raw("documents").select("doc_id", x.without_stamp(stamped).alias("name"))


@query("author_split", "", "SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[,，、&/;]'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM benchmark")
def _(t):
    from ..operators.joins import author_parts

    return t.raw("benchmark").select("item_id", author_parts(F.col("text")).alias("parts"))


@query("word_tokens", "", "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}]+(?:[''’][\\p{L}\\p{N}]+)*'))::BIGINT AS n FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.size(x.words(F.col("text"))).cast("long").alias("n"))


@query("sentence_counts")
def _(t):
    """Sentences of each document; the split looks behind, which the SQL's patterns can't."""
    return t.raw("documents").select("doc_id", F.size(x.sentences(F.col("text"))).alias("n"))


MARKED = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || '你好' WHEN 2 THEN text || '這' ELSE '' END"


@query("language_boost", "", f"""SELECT doc_id, CASE WHEN t = '' THEN 0 WHEN NOT regexp_matches(t, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN -0.4 WHEN contains(t, '這') THEN 0.5 ELSE 1 END::DOUBLE AS boost
FROM (SELECT doc_id, {MARKED} AS t FROM documents WHERE text IS NOT NULL)""")
def _(t):
    rows = t.raw("documents").where("text is not null").select("doc_id", F.expr(MARKED).alias("text"))
    return rows.select("doc_id", x.language_boost(F.col("text")).alias("boost"))


@query("page_label_percent", "books", "SELECT id, CASE WHEN id % 5 = 0 THEN 'chapter ' || id ELSE (least(current_page * 2, total_pages) * 100 // total_pages)::BIGINT::VARCHAR || '%' END AS shown FROM books")
def _(t):
    label = F.when(F.col("id") % 5 == 0, F.concat(F.lit("chapter "), F.col("id").cast("string"))).otherwise(F.format_string("%d / %d", F.col("current_page") * 2, F.col("total_pages")))
    return t.books.select("id", s.page_label_percent(label).alias("shown"))


@query("clock_values", "", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN n WHEN 1 THEN n % 3600 WHEN 2 THEN n WHEN 3 THEN n / 1000.0 WHEN 4 THEN n * 60 END::DOUBLE AS seconds
FROM (SELECT event_id, event_id * 7919 % 90000 AS n FROM events)""")
def _(t):
    n, k = (F.col("event_id") * 7919) % 90000, F.col("event_id") % 6
    minute, second = F.expr("(event_id * 7919 % 3600) div 60"), n % 60
    clock = F.when(k == 0, F.format_string("%d:%02d:%02d.0", F.expr("(event_id * 7919 % 90000) div 3600"), F.expr("(event_id * 7919 % 90000) % 3600 div 60"), second)).when(k == 1, F.format_string("%02d:%02d", minute, second))
    clock = clock.when(k == 2, F.format_string("%ds", n)).when(k == 3, F.format_string(" %dms ", n)).when(k == 4, F.format_string("%dmin", n)).otherwise("x")
    return t.raw("events").select("event_id", s.clock_seconds(clock).alias("seconds"))


LABELS = "CASE doc_id % 5 WHEN 0 THEN '长篇网文' WHEN 1 THEN '历史学术类' WHEN 2 THEN '短篇同人' WHEN 3 THEN '名著' ELSE '?' END"


@query("type_labels", "", f"SELECT doc_id, CASE {LABELS} WHEN '长篇网文' THEN 'webnovel' WHEN '历史学术类' THEN 'history_academic' WHEN '短篇同人' THEN 'collection_fanfic' WHEN '名著' THEN 'classic' ELSE 'general' END AS kind FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", s.type_of_label(F.concat(F.coalesce("source", F.lit("")), F.expr(LABELS))).alias("kind"))


@query("sections", "", """SELECT doc_id, '主角' AS label, regexp_replace(split_part(text, chr(10), 1), '^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$', '', 'g') AS body FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, '背景', coalesce(source, '') FROM documents WHERE text IS NOT NULL""")
def _(t):
    text = F.concat(F.lit("前言【主角】 "), F.substring_index("text", "\n", 1), F.lit("\n【背景】"), F.coalesce("source", F.lit("")), F.lit(" \n【主角】again"))
    rows = t.raw("documents").where("text is not null").select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.explode(x.sections(F.col("text"), ["主角", "背景"])).alias("label", "body"))


@query("traditional_to_simplified", "", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '这本书' ELSE '本' END || text AS text, doc_id % 2 = 0 AS traditional FROM documents WHERE text IS NOT NULL")
def _(t):
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, "這本書").otherwise("本"), "text")
    rows = t.raw("documents").where("text is not null").select("doc_id", text.alias("text"))
    return rows.select("doc_id", x.simplified(F.col("text"), "這書", "这书").alias("text"), x.is_traditional(F.col("text"), "這書", "这书").alias("traditional"))


def _novel(t):
    """Documents with a chapter title before every fifth line."""
    lines = F.transform(F.split("text", "\n"), lambda v, i: F.when(i % 5 == 2, F.concat(F.lit("Chapter "), (i + 1).cast("string"), F.lit("\n"), v)).otherwise(v))
    return t.raw("documents").where("text is not null").select(F.col("doc_id").alias("book_id"), F.array_join(lines, "\n").alias("text"))


@query("chapter_detection", "", """WITH n AS (SELECT doc_id AS book_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT book_id, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS i FROM n),
x AS (SELECT book_id, i, 0 AS k, 'Chapter ' || (i + 1)::VARCHAR AS line FROM e WHERE i % 5 = 2 UNION ALL SELECT book_id, i, 1, v FROM e),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY book_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  sum(length(line) + 1) OVER (PARTITION BY book_id)::BIGINT - 1 AS total FROM x),
g AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY book_id ORDER BY start), total) - start AS gap FROM o WHERE k = 0),
r AS (SELECT * FROM g WHERE gap >= 100)
SELECT book_id, line AS title, start, coalesce(lead(start) OVER (PARTITION BY book_id ORDER BY start), total) - start AS length FROM r""")
def _(t):
    return ch.detect(_novel(t)).select("book_id", "title", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))


@query("chapter_contents")
def _(t):
    """Chapters of the same books with their text; chapter_detection has the SQL of the offsets."""
    novel = _novel(t)
    return ch.materialise(novel, ch.detect(novel))
