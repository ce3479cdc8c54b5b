"""Document formats: written from the driver's documents and pages, and read again."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..batches import small_batches
from ..operators import outlines
from ..sources import archives, charset, feeds, kf8, lexicons, mobi, pdf, rules, sniff
from ..streaming import rollups
from .registry import query

LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL"
CLEAN = "trim(regexp_replace(line, '[ \\t\\r\\f\\x0B]+', ' ', 'g'))"


@F.pandas_udf(T.BinaryType())
def _epub(texts: pd.Series, source: pd.Series, lang: pd.Series) -> pd.Series:
    chapters = texts.map(lambda t: [(f"part {i}", x) for i, x in enumerate(t.split("\n"))])
    return pd.Series([archives.write_epub(c[0][1][:40] or "untitled", s, v, c) for c, s, v in zip(chapters, source, lang)])


@F.pandas_udf(T.BinaryType())
def _docx(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: archives.write_docx(t.split("\n")))


@F.pandas_udf(T.BinaryType())
def _mobi(texts: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([mobi.write_mobi("book", s, "<mbp:pagebreak/>".join(f"<h2>{i}</h2><p>{x}</p>" for i, x in enumerate(t.split("\n")))) for t, s in zip(texts, source)])


def _docs(t):
    small_batches(t.spark)  # files are several times their texts, and a batch of them is held whole
    return t.raw("documents").where("text is not null")


@query("epub_round_trip", "", f"SELECT doc_id, (i - 1)::BIGINT AS position, 'part ' || (i - 1)::VARCHAR AS title, {CLEAN} AS text FROM ({LINES})")
def _(t):
    files = _docs(t).select("doc_id", _epub("text", "source", "lang").alias("content"))
    return archives.read_epubs(files, "doc_id").where("error is null").select("doc_id", "position", "title", "text")


@query("epub_contents", "", f"SELECT doc_id, (i - 1)::BIGINT AS position, 0::BIGINT AS level, 'part ' || (i - 1)::VARCHAR AS title FROM ({LINES})")
def _(t):
    files = _docs(t).select("doc_id", _epub("text", "source", "lang").alias("content"))
    return archives.rows(files, archives.epub_toc, "position long, level long, title string, href string", "doc_id").select("doc_id", "position", "level", "title")


@query("epub_metadata", "", "SELECT doc_id, source AS author, lang AS language, len(string_split(text, chr(10)))::BIGINT AS items FROM documents WHERE text IS NOT NULL")
def _(t):
    files = _docs(t).select("doc_id", _epub("text", "source", "lang").alias("content"))
    kind = "title string, author string, language string, identifier string, subjects array<string>, items long"
    return archives.rows(files, archives.epub_metadata, kind, "doc_id").select("doc_id", "author", "language", "items")


@query("zip_entries", "", "SELECT doc_id, (len(string_split(text, chr(10))) + 5)::BIGINT AS entries FROM documents WHERE text IS NOT NULL")
def _(t):
    files = _docs(t).select("doc_id", _epub("text", "source", "lang").alias("content"))
    return archives.read_zips(files, "doc_id").groupBy("doc_id").agg(F.count("*").alias("entries"))


@query("docx_round_trip", "", f"SELECT doc_id, count(*) FILTER (trim(line) <> '') AS paragraphs, coalesce(sum(length(trim(line))), 0)::BIGINT AS chars FROM ({LINES}) GROUP BY 1")
def _(t):
    got = archives.read_docx(_docs(t).select("doc_id", _docx("text").alias("content")), "doc_id")
    per = got.groupBy("doc_id").agg(F.count("text").alias("paragraphs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return _docs(t).select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("paragraphs", F.lit(0)).cast("long").alias("paragraphs"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))


@query("mobi_round_trip", "", "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS chapters, source AS author FROM documents WHERE text IS NOT NULL")
def _(t):
    files = _docs(t).select("doc_id", _mobi("text", "source").alias("content"))
    return mobi.read_mobi(files, "doc_id").groupBy("doc_id", "author").agg(F.count("*").alias("chapters"))


@F.pandas_udf(T.BinaryType())
def _kf8(texts: pd.Series, source: pd.Series) -> pd.Series:
    """Two lines are a chapter of two pieces, each but the first with a link to the first piece of the one before."""

    def chapters(text: str) -> list[tuple[str, list[str]]]:
        lines, out, pieces = text.split("\n"), [], 0
        for i in range(0, len(lines), 2):
            back = f'<a href="{kf8.link(pieces - len(out[-1][1]))}">x</a>' if out else ""
            out.append((f"this is chapter number {i // 2}", [f'<p id="p{i + j}">{escape(x)}</p>{back if not j else ""}' for j, x in enumerate(lines[i : i + 2])]))
            pieces += len(out[-1][1])
        return out

    return pd.Series([mobi.write_kf8("book", s or "", chapters(t)) for t, s in zip(texts, source)])


@query("kf8_round_trip", "", "SELECT doc_id, source AS author, ((len(string_split(text, chr(10))) + 1) // 2)::BIGINT AS chapters, length(regexp_replace(text, '[ \\t\\n\\f\\r\\x0B]', '', 'g'))::BIGINT AS letters FROM documents WHERE text IS NOT NULL")
def _(t):
    got = mobi.read_mobi(_docs(t).select("doc_id", _kf8("text", "source").alias("content")), "doc_id")
    black = lambda c: F.length(F.regexp_replace(c, r"[ \t\n\f\r\x0B]", ""))
    own = black("text") - black("title") - (F.col("position") > 0).cast("int")  # but for the link's x
    return got.groupBy("doc_id", "author").agg(F.count("title").alias("chapters"), F.sum(own).cast("long").alias("letters"))


@query("kf8_links", "", f"SELECT doc_id, c::BIGINT AS part, (c - 1)::BIGINT AS to_part, 'p' || (2 * (c - 1))::VARCHAR AS anchor FROM (SELECT DISTINCT doc_id, (i - 1) // 2 AS c FROM ({LINES})) WHERE c > 0")
def _(t):
    got = mobi.read_mobi_links(_docs(t).select("doc_id", _kf8("text", "source").alias("content")), "doc_id")
    return got.where("part is not null").select("doc_id", "part", "to_part", "anchor")


@F.pandas_udf(T.BinaryType())
def _pdf(ids: pd.Series, texts: pd.Series, source: pd.Series) -> pd.Series:
    """A page for 600 characters, an outline of the lines; packed objects for every second file."""

    def file(i: int, text: str, author: str | None) -> bytes:
        pages = len(text) // 600 + 1
        entries = [(int(k % 3 > 0), f"line {k}", min(k, pages - 1)) for k in range(text.count("\n") + 1)]
        return pdf.write_pdf(f"doc {i}", author or "", pages, entries, i % 2 == 0)

    return pd.Series([file(*x) for x in zip(ids, texts, source)])


@query("pdf_info", "", "SELECT doc_id, (length(text) // 600 + 1)::BIGINT AS pages, 'doc ' || doc_id AS title, source AS author FROM documents WHERE text IS NOT NULL")
def _(t):
    return pdf.read_info(_docs(t).select("doc_id", _pdf("doc_id", "text", "source").alias("content")), "doc_id").select("doc_id", "pages", "title", "author")


@query("pdf_outline", "", f"SELECT doc_id, (i - 1)::BIGINT AS position, ((i - 1) % 3 > 0)::INT AS depth, 'line ' || (i - 1) AS title, least(i - 1, length(text) // 600)::BIGINT AS page FROM ({LINES}) JOIN documents USING (doc_id)")
def _(t):
    return pdf.read_outline(_docs(t).select("doc_id", _pdf("doc_id", "text", "source").alias("content")), "doc_id").drop("error")


@query("mobi_sniff", "", "SELECT doc_id, doc_id % 4 = 0 AS is_mobi FROM documents WHERE text IS NOT NULL")
def _(t):
    rows = _docs(t).select("doc_id", F.when(F.col("doc_id") % 4 == 0, _mobi("text", "source")).otherwise(F.col("text").cast("binary")).alias("content"))
    return rows.select("doc_id", mobi.is_mobi(F.col("content")).alias("is_mobi"))


@query("format_sniff", "", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' ELSE 'html' END AS format FROM pages")
def _(t):
    rows = t.raw("pages").withColumn("k", F.col("page_id") % 4)
    ext = F.when(F.col("k") == 0, "EPUB").when(F.col("k") == 2, "bin")
    kind = F.when(F.col("k") == 3, "text/html; charset=utf-8")
    content = F.when(F.col("k") == 2, F.encode(F.lit("%PDF-1.7"), "UTF-8")).otherwise(F.col("html").cast("binary"))
    return rows.select("page_id", sniff.sniff(ext, kind, content).alias("format"))


@query("text_charsets", "", "SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def _(t):
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-8"))
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FEFF")), raw)).otherwise(raw)
    return _docs(t).select("doc_id", F.length(charset.decoded_texts(marked)).cast("long").alias("n"))


@query("html_charsets", "", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'utf-8' ELSE 'iso8859-1' END AS charset FROM pages")
def _(t):
    declared = F.replace("html", F.lit('charset="utf-8"'), F.when(F.col("page_id") % 2 == 0, F.lit('charset="utf-8"')).otherwise(F.lit('charset="iso-8859-1"')))
    return t.raw("pages").select("page_id", charset.html_charsets(declared.cast("binary")).alias("charset"))


@query("atom_feed", "", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'publication' ELSE 'navigation' END AS kind, 'page ' || page_id::VARCHAR AS title, url AS href FROM pages")
def _(t):
    rel = F.when(F.col("page_id") % 2 == 0, "http://opds-spec.org/acquisition").otherwise("subsection")
    entry = F.format_string('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>page %d</title><link rel="%s" href="%s"/></entry></feed>', F.col("page_id"), rel, F.replace("url", F.lit("&"), F.lit("&amp;")))
    got = feeds.read_feeds(t.raw("pages").select("page_id", F.encode(entry, "UTF-8").alias("content")), "page_id")
    return got.select("page_id", "kind", "title", "href")


@query("json_feed", "", "SELECT page_id, 'publication' AS kind, 'page ' || page_id::VARCHAR AS title, url AS href FROM pages")
def _(t):
    book = F.struct(F.struct(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title")).alias("metadata"), F.array(F.struct(F.lit("http://opds-spec.org/acquisition").alias("rel"), F.col("url").alias("href"))).alias("links"))
    text = F.to_json(F.struct(F.struct(F.lit("t").alias("title")).alias("metadata"), F.array(book).alias("publications")))
    return feeds.read_feeds(t.raw("pages").select("page_id", F.encode(text, "UTF-8").alias("content")), "page_id").select("page_id", "kind", "title", "href")


@query("web_manifest", "", "SELECT page_id, url AS first, 2::BIGINT AS items FROM pages")
def _(t):
    text = F.to_json(F.struct(F.struct(F.lit("t").alias("title")).alias("metadata"), F.array(F.struct(F.col("url").alias("href")), F.struct(F.lit("b.html").alias("href"))).alias("readingOrder")))
    rows = t.raw("pages").select("page_id", feeds.manifest(text).alias("m"))
    return rows.select("page_id", F.col("m.readingOrder")[0]["href"].alias("first"), F.size("m.readingOrder").cast("long").alias("items"))


@query("locators", "", "SELECT page_id, url AS href, round((page_id % 10) / 10.0, 3)::DOUBLE AS progression, CASE WHEN page_id % 5 > 0 THEN (page_id % 5)::INT END AS position, 'x' || page_id::VARCHAR AS selector FROM pages")
def _(t):
    text = F.format_string('{"href":"%s","type":"text/html","locations":{"progression":%s,"position":%d,"cssSelector":"x%d","fragments":["a"]}}', F.col("url"), ((F.col("page_id") % 10) / 10).cast("string"), F.col("page_id") % 5, F.col("page_id"))
    rows = t.raw("pages").select("page_id", feeds.locator(text).alias("l"))
    return rows.select("page_id", "l.href", F.round("l.progression", 3).alias("progression"), "l.position", F.col("l.other")["cssSelector"].alias("selector"))


@query("ratings", "", "SELECT event_id, CASE WHEN event_id % 6 < 4 AND event_id % 11 > 0 THEN (event_id % 11)::DOUBLE / 2 END AS rating FROM events")
def _(t):
    n, k = ((F.col("event_id") % 11) / 2).cast("string"), F.col("event_id") % 6
    forms = ('{"rating":"%s"}', '{"rating":%s}', '{"rating":{"value":"%s"}}', '{"score":%s}', '{"rating":0,"other":%s}', "no json %s")
    text = F.format_string(forms[-1], n)
    for i, form in enumerate(forms[:-1]):
        text = F.when(k == i, F.format_string(form, n)).otherwise(text)
    return t.raw("events").select("event_id", feeds.rating(text).alias("rating"))


@query("api_answers", "books", """SELECT id, title, CASE id % 3 WHEN 0 THEN author || ', ' || format ELSE author END AS author,
CASE id % 3 WHEN 0 THEN 'Google Books' WHEN 1 THEN '豆瓣' ELSE 'Open Library' END AS source, round(log10(total_characters + 1), 6)::DOUBLE AS popularity FROM books WHERE title IS NOT NULL""")
def _(t):
    n = F.col("total_characters")
    google = F.to_json(F.struct(F.array(F.struct(F.struct("title", F.array("author", "format").alias("authors"), n.alias("ratingsCount")).alias("volumeInfo"))).alias("items")))
    douban = F.to_json(F.struct(F.array(F.struct("title", "author", F.struct(F.lit(8.8).alias("value"), n.alias("count")).alias("rating"))).alias("items")))
    library = F.to_json(F.struct(F.array(F.struct(F.lit("/works/1").alias("key"), "title", F.array("author").alias("author_name"), n.alias("edition_count"))).alias("docs")))
    rows = t.books.where("title is not null").select("id", google.alias("g"), douban.alias("d"), library.alias("o"))
    of = F.when(F.col("id") % 3 == 0, feeds.google_books(F.col("g"))).when(F.col("id") % 3 == 1, feeds.douban(F.col("d"))).otherwise(feeds.open_library(F.col("o")))
    return rows.select("id", F.inline(of)).select("id", "title", "author", "source", F.round("popularity", 6).alias("popularity"))


@query("page_rules", "", "SELECT page_id, list_count(regexp_extract_all(html, '<li><a '))::BIGINT AS links, regexp_extract(html, '<li><a href=\"([^\"]*)\"', 1) AS first FROM pages WHERE contains(html, '<li><a ')")
def _(t):
    got = rules.extract_all(t.raw("pages").withColumn("url", F.lit("")), {"bookList": "tag.nav@tag.li", "name": "tag.a@href", "url": "tag.a@href"})
    return got.groupBy("page_id").agg(F.count("*").alias("links"), F.min_by("name", "position").alias("first"))


@query("book_links", "", """WITH m AS (SELECT page_id, regexp_extract_all(html, '<a[^>]+href="([^"]+)"[^>]*>([^<]{2,40})</a>', 1) AS h, regexp_extract_all(html, '<a[^>]+href="([^"]+)"[^>]*>([^<]{2,40})</a>', 2) AS t FROM pages),
u AS (SELECT page_id, unnest(h) AS href, unnest(t) AS title, generate_subscripts(h, 1) AS i FROM m)
SELECT page_id, trim(title) AS title, 'http://x' || arg_min(href, i) AS href FROM u WHERE length(trim(title)) BETWEEN 2 AND 40 AND regexp_matches(href, 'book|info|article|th') GROUP BY ALL""")
def _(t):
    # links of these pages are short words; those with "th" are made to look like books
    marked = F.regexp_replace("html", r'<a href="(/[^"]*th[^"]*)"', '<a href="/book$1"')
    got = rules.book_links(t.raw("pages").select("page_id", marked.alias("html")), "http://x")
    return got.withColumn("href", F.regexp_replace("href", "^http://x/book/", "http://x/"))


@query("embedded_json", "", "SELECT page_id, page_id AS k FROM pages")
def _(t):
    page = F.concat(F.lit("<script>window.__DATA__ = "), F.format_string('{"a":[{"k":%d,"s":"}]"}]}', F.col("page_id")), F.lit(";</script>"), "html")
    return t.raw("pages").select("page_id", F.get_json_object(rules.embedded_jsons(page), "$.a[0].k").cast("long").alias("k"))


@query("event_props", "", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def _(t):
    return t.raw("events").select("event_id", rules.minimal_path(F.col("props"), "$.k").cast("int").alias("k"))


@query("json_structs", "", f"SELECT doc_id, 'line ' || (i - 1) AS title, line AS summary FROM ({LINES}) WHERE doc_id % 7 > 0 AND trim(line, ' ') <> '' AND i % 3 <> 2")
def _(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.when(i % 3 == 1, " ").otherwise(F.concat(F.lit("line "), i.cast("string"))).alias("title"), x.alias("summary")))
    text = F.when(F.col("doc_id") % 7 > 0, F.to_json(lines)).otherwise("bad")
    parsed = F.filter(F.from_json(text, "array<struct<title:string,summary:string>>"), lambda c: (F.trim(c["title"]) != "") & (F.trim(c["summary"]) != ""))
    return _docs(t).select("doc_id", F.inline(parsed))


@query("outline_walk", "", """WITH d AS (SELECT doc_id, doc_id % 13 AS k, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i::INT AS depth, repeat('0.', i) AS path, 'level ' || i AS title, '' AS summary FROM d, unnest(range(0, k + 1)) AS u(i)
UNION ALL SELECT doc_id, (k + 1)::INT, repeat('0.', k) || (j - 1) || '.', 'line ' || (j - 1), length(lines[j])::VARCHAR FROM d, unnest(range(1, len(lines) + 1)) AS u(j)""")
def _(t):
    """Each document's lines below a chain of doc_id % 13 + 1 nodes."""
    k = (F.col("doc_id") % 13).cast("int")
    level = lambda i: F.concat(F.lit('{"title":"level '), i.cast("string"), F.lit('","children":["text",'))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.concat(F.lit("line "), i.cast("string")).alias("title"), F.length(x).alias("summary")))
    chain = F.array_join(F.transform(F.sequence(F.lit(0), k - 1), level), "")
    chain = F.when(k > 0, chain).otherwise("")
    inner = F.to_json(F.struct(F.concat(F.lit("level "), k.cast("string")).alias("title"), lines.alias("children")))
    text = F.concat(F.lit("```json\n"), chain, inner, F.repeat(F.lit("]}"), k), F.lit("\n```"))
    got = outlines.outline_nodes(_docs(t).select("doc_id", text.alias("json")), "doc_id")
    # of a chain's children the first is text, and so left out
    shown = F.array_join(F.transform("path", lambda p, i: F.concat(F.when(i < F.col("doc_id") % 13, p - 1).otherwise(p).cast("string"), F.lit("."))), "")
    return got.select("doc_id", "depth", shown.alias("path"), "title", "summary")


PARTS = f"SELECT doc_id, i - 1 AS position, 'part ' || (i - 1) AS title, substr(line, 1, 80) AS summary, substr(line, 81, 80) AS events, substr(line, 161, 80) AS characters, substr(line, 85, 5) AS wanted FROM ({LINES})"


@query("result_search", "", f"SELECT * FROM (SELECT doc_id, position, array_to_string(list_filter([CASE WHEN contains(lower(title), q) THEN 'title' END, CASE WHEN contains(lower(summary), q) THEN 'summary' END, CASE WHEN contains(lower(events), q) THEN 'events' END, CASE WHEN contains(lower(characters), q) THEN 'characters' END], lambda x: x IS NOT NULL), ',') AS found FROM (SELECT *, lower(trim(wanted, ' ')) AS q FROM ({PARTS})) WHERE q <> '') WHERE found <> ''")
def _(t):
    """A few letters of each line's events are looked for in the line's chapter."""
    lines = _docs(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    cut = lambda a, n=80: F.substring("line", a, n)
    chapters = lines.select("doc_id", F.col("position").cast("long").alias("position"), F.concat(F.lit("part "), F.col("position").cast("string")).alias("title"), cut(1).alias("summary"), cut(81).alias("events"), cut(161).alias("characters"), F.trim(cut(85, 5)).alias("wanted"))
    got = outlines.search_results(chapters.where("wanted <> ''"), F.col("wanted"))
    return got.select("doc_id", "position", F.array_join("found", ",").alias("found"))


@query("json_write", "", "SELECT item_id, '{\"item_id\":' || item_id::VARCHAR || ',\"n\":' || length(text)::VARCHAR || '}' AS json FROM benchmark")
def _(t):
    return t.raw("benchmark").select("item_id", F.to_json(F.struct("item_id", F.length("text").alias("n"))).alias("json"))


@query("dictionary_lookup", "", """WITH e AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]+')) AS key FROM documents WHERE doc_id % 3 > 0), c AS (SELECT DISTINCT '词' || (doc_id % 50) AS key FROM documents),
a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN lower(regexp_extract(text, '[A-Za-z]+')) ELSE '词' || (conv_id % 70) END AS key FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, 'english' AS lexicon, key FROM a JOIN e USING (key) WHERE key <> '' UNION ALL SELECT conv_id, turn, 'chinese', key FROM a JOIN c USING (key)""")
def _(t):
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    docs = t.raw("documents")
    english = docs.where("doc_id % 3 > 0").groupBy(F.lower(word).alias("key")).agg(F.count("*").alias("n")).select("key", F.struct("n").alias("entry"))
    chinese = docs.groupBy(F.concat(F.lit("词"), (F.col("doc_id") % 50).cast("string")).alias("key")).agg(F.count("*").alias("n")).select("key", F.struct("n").alias("entry"))
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.upper(word))).otherwise(F.concat(F.lit("词"), (F.col("conv_id") % 70).cast("string")))
    asked = t.raw("conversations").where("text is not null").select(F.struct("conv_id", "turn").alias("id"), text.alias("text"))
    return lexicons.look_up(asked, english, chinese).select("id.conv_id", "id.turn", "lexicon", "key")


def _drained(t, name: str, make, keys: list[str]):
    """The stream's state after all of the events are read; its files are in the shared folder if there is one."""
    import tempfile
    import uuid

    folder = t.spark.conf.get("spark.checkpoint.dir", None) or ("file://" + tempfile.mkdtemp() if t.spark.sparkContext.master.split("[")[0] == "local" else t.spark.conf.get("spark.sql.warehouse.dir"))
    schema = t.raw("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parquet*")
    table = f"{name}_{uuid.uuid4().hex}"
    at = f"{folder.rstrip('/')}/streams/{table}"
    return rollups.drain(make(stream.withColumn("ts", F.col("ts").cast("timestamp"))), keys, f"{at}/rows", f"{at}/checkpoint")


@query("stream_daily_totals", "", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, sum(floor(value * 10))::BIGINT AS seconds FROM events GROUP BY ALL")
def _(t):
    return _drained(t, "daily", lambda e: rollups.daily_totals(e.withColumn("seconds", F.floor(F.col("value") * 10)), ["user_id"]), ["day", "user_id"]).withColumn("day", F.col("day").cast("string"))


@query("stream_windows", "", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return _drained(t, "windows", lambda e: rollups.windowed(e, "6 hours", None, ["event_type"], "1 day"), ["start", "end", "event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
