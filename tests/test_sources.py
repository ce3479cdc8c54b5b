"""Document formats by files that the tests write themselves."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelake.sources import archives, charset, feeds, kf8, lexicons, media, mobi, pdf, rules, sniff
from quirelake.streaming import rollups


def test_charsets():
    assert charset.text_charset("中文".encode("gbk")) == "gbk"
    assert charset.text_charset("中文".encode("utf-8")) == "utf-8"
    assert charset.text_charset("﻿x".encode("utf-16-le")) == "utf-16-le"
    assert charset.text_charset(b"plain") == "utf-8"
    assert charset.html_charset(b'<meta charset="GBK">') == "gbk"
    assert charset.html_charset('<?xml encoding="utf-8"?>中'.encode("gbk")) == "gb18030"
    assert charset.html_charset("<p>中".encode("gbk")) == "gb18030"
    assert charset.html_charset(b"<p>x") == "utf-8"


def test_epub_and_docx(spark):
    raw = archives.write_epub("T & t", "A", "en", [("One", "a\nb"), ("Two", "c < d")])
    files = spark.createDataFrame([("x", bytearray(raw)), ("bad", bytearray(b"PK"))], "path string, content binary")
    rows = {(r["position"], r["title"], r["text"]) for r in archives.read_epubs(files).where("error is null").collect()}
    assert rows == {(0, "One", "a\nb"), (1, "Two", "c < d")}
    assert archives.read_epubs(files).where("error is not null").count() == 1
    assert next(archives.epub_metadata(raw))[:3] == ("T & t", "A", "en")
    assert list(archives.docx_paragraphs(archives.write_docx(["a", " ", "b & c"]))) == [(0, "a"), (1, "b & c")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../x", "y")
    with pytest.raises(ValueError):
        list(archives.zip_entries(out.getvalue()))


def test_package_and_contents():
    opf = b"""<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>t</dc:title>
    <dc:creator id="c">N</dc:creator><meta refines="#c" property="role">trl</meta><dc:subject>a, b;c</dc:subject></metadata>
    <manifest><item id="x" href="x.xhtml" media-type="m" fallback="y"/><item id="y" href="y.svg" fallback="x"/></manifest>
    <spine toc="n"><itemref idref="x" linear="no"/><itemref idref="gone"/></spine><guide><reference type="cover" href="x.xhtml"/></guide></package>"""
    p = archives.parse_package(opf)
    assert p["roles"] == {"trl": ["N"]} and p["metadata"]["subject"] == ["a", "b", "c"]
    assert p["spine"] == [("x", False)] and p["manifest"]["x"]["alternates"] == ["OEBPS/y.svg", "OEBPS/x.xhtml"]
    ncx = b'<ncx><navMap><navPoint><navLabel><text> A  b</text></navLabel><content src="a.html#1"/><navPoint><navLabel><text>C</text></navLabel><content src="c.html"/></navPoint></navPoint></navMap></ncx>'
    assert list(archives.flat_toc(archives.parse_ncx(ncx, "O/toc.ncx"))) == [(0, "A b", "O/a.html#1"), (1, "C", "O/c.html")]
    with pytest.raises(ValueError):
        archives.read_xml(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>')


def test_mobi():
    data = b"hello hello hello\x00\xe9 z"
    assert mobi.unpack_palmdoc(mobi.pack_palmdoc(data)) == data
    assert mobi.unpack_palmdoc(b"abc\x80\x1b") == b"abcabcabc"  # back 3, six letters
    assert mobi.unpack_palmdoc(b"a\xe2") == b"a b"
    raw = mobi.write_mobi("Title", "Me", "<p>x</p><mbp:pagebreak/><h1>Two</h1><p>y</p>")
    assert list(mobi.mobi_items(raw)) == [(0, "第1部分", "x", "Title", "Me"), (1, "Two", "Two\n\ny", "Title", "Me")]
    with pytest.raises(ValueError):
        mobi.parse(b"x" * 100)


def test_huffman():
    import struct

    first = b"".join(struct.pack(">I", 255 << 8 | 128 | 8) for _ in range(256))
    huff = b"HUFF\0\0\0\x18" + struct.pack(">II", 16, 16 + len(first)) + first + b"\0" * 256
    phrases = [(b"ab", True), (bytes([255, 255]), False), (b"c", True)]
    body, offsets = b"", []
    for data, plain in phrases:
        offsets.append(2 * len(phrases) + len(body))
        body += struct.pack(">H", len(data) | (0x8000 if plain else 0)) + data
    cdic = b"CDIC\0\0\0\x10" + struct.pack(">II", len(phrases), 8) + struct.pack(">3H", *offsets) + body
    h = mobi.Huffman(huff, [cdic])
    assert h.unpack(bytes([255, 253, 254])) == b"abcabab"
    assert h.unpack(b"") == b""


def test_feeds():
    atom = b"""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opds="http://opds-spec.org/2010/catalog" xmlns:thr="http://purl.org/syndication/thread/1.0"><title>F</title>
    <entry><title>Book</title><id>1</id><author><name>N</name></author><link rel="http://opds-spec.org/acquisition/buy" href="b.epub" type="application/epub+zip"/><link rel="collection" href="g" title="G"/></entry>
    <entry><title>More</title><link href="/m" type="t"/></entry><link rel="http://opds-spec.org/facet" opds:facetGroup="Sort" thr:count="4" href="?s=1" title="New"/><link rel="self" href="x"/></feed>"""
    rows = list(feeds.parse_atom(atom, "http://h/c/"))
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [("publication", "G", "Book", "http://h/c/b.epub"), ("navigation", None, "More", "http://h/m"), ("facet", "Sort", "New", "http://h/c/?s=1"), ("link", None, None, "http://h/c/x")]
    assert rows[2][9] == 4 and rows[0][6] == "N"
    with pytest.raises(ValueError):
        list(feeds.parse_atom(b'<feed xmlns="http://www.w3.org/2005/Atom"/>'))
    feed = b'{"metadata":{"title":"F"},"navigation":[{"href":"n","title":"N"}],"groups":[{"metadata":{"title":"G"},"publications":[{"metadata":{"title":{"en":"P"},"author":[{"name":"A"},"B"]},"links":[{"rel":["http://opds-spec.org/acquisition"],"href":"p"}]}]}],"facets":[{"metadata":{"title":"S"},"links":[{"href":"s","properties":{"numberOfItems":3}}]}]}'
    got = list(feeds.parse_json_feed(feed, "http://h/"))
    assert [(r[0], r[1], r[2], r[3], r[6]) for r in got] == [("navigation", None, "N", "http://h/n", None), ("publication", "G", "P", "http://h/p", "A, B"), ("facet", "S", None, "http://h/s", None)]


def test_rules():
    page = '<ul id="l"><li class="b x"><a href="/1" title="T">One  (v1)</a></li><li class="b"><a href="/2">Two</a></li><li class="b"><a href="/3">Three</a></li></ul>'
    got = rules.extract(page, {"bookList": "id.l@class.b!1", "name": "tag.a.0@text##\\s*\\(.*\\)", "url": "a@href"}, "http://h/")
    assert got == [{"name": "One", "url": "http://h/1"}, {"name": "Three", "url": "http://h/3"}]
    assert [n.text() for n in rules.tree(page).select("ul > li.x a, #l [href=\"/2\"]")] == ["One (v1)", "Two"]
    data = '{"data":{"list":[{"n":"A","id":7},{"n":""}]}}'
    assert rules.extract(data, {"bookList": "$.data.list.[*]", "name": "$.n", "url": "/b/{{$.id}}"}, "http://h") == [{"name": "A", "url": "http://h/b/7"}]
    assert rules.embedded_json('x window.__DATA__ = {"a":"}\\"","b":[1]}; y') == '{"a":"}\\"","b":[1]}'
    assert rules.embedded_json("none") is None


def test_sniffing(spark):
    cases = [(None, None, b"%PDF-1.4", "pdf"), ("epub", None, b"", "epub"), ("x", "text/html; charset=x", b"", "html"), (None, None, b"  <html>", "html"), (None, None, b"\x89PNG", "bitmap"), (None, None, b'{"readingOrder":[]}', "webpub_manifest"), (None, None, b"zzz", None), ("cbz", None, b"", "zip")]
    rows = spark.createDataFrame([(e, m, bytearray(c)) for e, m, c, _ in cases], "e string, m string, c binary")
    assert [r[0] for r in rows.select(sniff.sniff(F.col("e"), F.col("m"), F.col("c"))).collect()] == [x[3] for x in cases]


def test_lexicons(spark, tmp_path):
    (tmp_path / "f.txt").write_text("# c\n北京 10 ns\n北京 3 n\nbad\n大学 5\n", encoding="utf-8")
    assert {tuple(r) for r in lexicons.frequency_list(spark, str(tmp_path / "f.txt")).collect()} == {("北京", 10, "ns"), ("大学", 5, None)}
    (tmp_path / "v.txt").write_text("a\t2\nb\tx\n")
    assert [tuple(r) for r in lexicons.value_list(spark, str(tmp_path / "v.txt")).collect()] == [("a", 2.0)]
    (tmp_path / "j.tsv").write_text('apple\t{"w":"apple","t":"fruit"}\n')
    assert lexicons.tsv_json(spark, str(tmp_path / "j.tsv"), lexicons.ENGLISH).first()["entry"]["t"] == "fruit"
    assert lexicons.word_set(spark, str(tmp_path / "f.txt")).count() == 4


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:01", 1, 5.0), ("2024-01-01 00:10:00", 1, 7.0), ("2024-01-02 01:00:00", 1, 1.0)], "ts string, k long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))  # one file: no event comes late
    stream = lambda: rollups.event_stream(spark, str(tmp_path / "e"), events.schema)
    totals = rollups.daily_totals(stream().withColumn("seconds", F.col("value")), ["k"])
    assert {(str(r["day"]), r["k"], r["seconds"]) for r in rollups.drain(totals, ["day", "k"], str(tmp_path / "d"), str(tmp_path / "c1")).collect()} == {("2024-01-01", 1, 12.0), ("2024-01-02", 1, 1.0)}
    rollups.write_batches(rollups.sessions(stream(), "5 minutes", "k", "1 hour"), str(tmp_path / "s"), str(tmp_path / "c2"), "complete")
    last = spark.read.parquet(str(tmp_path / "s"))
    assert last.where(F.col("batch") == last.agg(F.max("batch")).first()[0]).count() == 3
    # two batches: a day's total is the last one written, not both
    for i, rows in enumerate(([("2024-01-01 00:00:01", 1, 5.0)], [("2024-01-01 03:00:00", 1, 2.0), ("2024-01-01 04:00:00", 2, 1.0)])):
        spark.createDataFrame(rows, "ts string, k long, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "two"))
        two = rollups.daily_totals(rollups.event_stream(spark, str(tmp_path / "two"), events.schema).withColumn("seconds", F.col("value")), ["k"])
        got = rollups.drain(two, ["day", "k"], str(tmp_path / "d2"), str(tmp_path / "c5"))
    assert {(r["k"], r["seconds"]) for r in got.collect()} == {(1, 7.0), (2, 1.0)}
    rollups.write_batches(stream(), str(tmp_path / "o"), str(tmp_path / "c3"))
    rollups.write_batches(stream(), str(tmp_path / "o"), str(tmp_path / "c3"))  # nothing new
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    rollups.live(stream(), spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), "k", str(tmp_path / "c4"), str(tmp_path / "v"))
    assert {r["v"] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"a"}


def test_addresses_and_pieces(spark):
    from quirelake.functions import urls, wordpiece
    from quirelake.operators import licences

    assert urls.resolve("http://h/a/b.html", "../c?x#y") == "http://h/c?x#y"
    assert urls.resolve("a/b.html", "c.html") == "a/c.html" and urls.resolve("/a/b", "/c") == "/c"
    assert urls.relativise("http://h/a/", "http://h/a/b/c") == "b/c" and urls.relativise("http://h/a/", "http://g/b") == "http://g/b"
    assert urls.normalise("HTTP://Example.com/a/./b/../%41 c?q=1") == "http://example.com/a/A%20c?q=1"
    assert urls.template_names("/u{?a,b}/{c}") == ["a", "b", "c"]
    assert urls.expand_template("/s{?q,p}", {"q": "a b"}) == "/s?q=a%20b" and urls.expand_template("/{x}/y{?q}", {"x": "1"}) == "/1/y"
    one = spark.createDataFrame([("http://H/a?b=c%20d",)], "u string")
    assert one.select(urls.host(F.col("u")), urls.query_value(F.col("u"), "b")).first()[0] == "h"
    vocab = {"[CLS]": 101, "[SEP]": 102, "[UNK]": 100, "play": 1, "##ing": 2, "中": 3, "!": 4}
    assert wordpiece.encode("Playing 中! zzz", vocab) == [101, 1, 2, 3, 4, 100, 102]
    assert len(wordpiece.encode("play " * 600, vocab)) == 512
    pieces = spark.createDataFrame(list(vocab.items()), "piece string, id int")
    assert wordpiece.with_ids(spark.createDataFrame([("play",), (None,)], "text string"), pieces).select("token_ids").collect()[1][0] == [101, 102]
    left, granted = licences.use_up(spark.createDataFrame([(1, 5), (2, None), (3, 1)], "id int, prints int"), spark.createDataFrame([(1, 2), (1, 2), (2, 9), (3, 2)], "id int, n int"), "prints")
    assert dict(tuple(r) for r in left.collect()) == {1: 1, 2: None, 3: 1}
    assert {r["id"]: r["granted"] for r in granted.collect()} == {1: True, 2: True, 3: False}


def test_media_and_accessibility(spark):
    from quirelake.functions import accessibility as acc
    from quirelake.sources import media

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in ("c/10.jpg", "c/2.jpg", "x.txt", "a/1.mp3"):
            z.writestr(n, "data")
    assert [r[1] for r in media.comic_pages(out.getvalue())] == ["c/2.jpg", "c/10.jpg"]
    assert [r[2] for r in media.audio_tracks(out.getvalue())] == ["1"]
    font = bytes(range(256)) * 8
    assert media.plain_font(media.plain_font(font, "urn:x y"), "urn:x y") == font
    key = "urn:uuid:00112233-4455-6677-8899-aabbccddeeff"
    assert media.plain_font(font, key, "adobe")[:2] == bytes([0, 1 ^ 0x11]) and media.plain_font(font, key, "adobe")[1024:] == font[1024:]
    row = spark.createDataFrame([(["textual", "visual"], [["textual"]], ["MathML", "tableOfContents"], ["flashing"]), (["visual"], None, None, ["none"])], "m array<string>, s array<array<string>>, f array<string>, h array<string>")
    got = row.select(acc.nonvisual_reading(F.col("m"), F.col("s"), F.col("f")), acc.navigation(F.col("f")), acc.rich_content(F.col("f")), acc.hazards(F.col("h")), acc.visual_adjustments(F.col("f"), F.lit(True)), acc.prerecorded_audio(F.col("m"), F.col("s"), F.col("f"))).collect()
    assert tuple(got[0]) == ("readable", ["table of contents"], ["math as MathML"], ["flashing"], "unmodifiable", "unknown")
    assert got[1][0] == "unreadable" and got[1][3] == ["none"]


def test_mobi_titles_by_place():
    body = "<p>x</p><mbp:pagebreak/><h1>own</h1><p>y</p><mbp:pagebreak/><p>z</p>"
    toc = "<p><a filepos=%010d>Alpha</a> <a filepos=%010d>Beta</a></p><mbp:pagebreak/>"
    size = len(toc % (0, 0))
    first, second = size + body.index("<h1>"), size + body.index("<p>z")
    assert [t for t, _ in mobi.split_chapters(toc % (first, second) + body)] == ["第1部分", "第2部分", "Alpha", "Beta"]


def test_kf8_parts_fragments_and_links():
    chapters = [
        ("One", ["<p id='a'>first piece of text here</p>", f"<p>second <a href='{kf8.link(2)}'>go</a> <a href='{kf8.link(0, 3)}'>up</a></p>"]),
        ("", [f"<p name='z'>third piece of text, 世界</p><a href='{kf8.link(2, 9)}'>no anchor after</a><a href='{kf8.link(9)}'>nowhere</a>"]),
        ("s", ["x"]),
    ]
    for packed in (True, False):
        raw = mobi.write_kf8("T", "Me", chapters, "p{color:red}", packed)
        assert [x[:3] for x in mobi.mobi_items(raw)] == [(0, "One", "One\n\nfirst piece of text here\n\nsecond go up"), (1, "第2部分", "third piece of text, 世界\nno anchor afternowhere")]
        # after the offset the first anchor of the part counts; without one the link leads to the fragment's part
        assert list(mobi.mobi_links(raw)) == [(0, 1, "z"), (0, 0, "a"), (1, 1, None)]
    _, text, recs, _ = mobi._parsed(raw)
    book = kf8.Book(recs, text)
    assert book.styles == [b"p{color:red}"] and len(book.fragments) == 4
    assert "kindle:flow" not in book.markup(0) and "aid=" not in book.markup(0) and 'href=\'part1.xhtml#z\'' in book.markup(0)


def test_kf8_indexes():
    # two control bytes; a tag with a length in bytes, one that comes twice, one that is missing
    tags = [kf8.Tag(1, 1, 0x03, False), kf8.Tag(2, 2, 0x0C, False), kf8.Tag(0, 0, 0, True), kf8.Tag(3, 1, 0x01, False), kf8.Tag(4, 1, 0x02, False)]
    number = kf8._number
    data = bytes([0x03 | 0x08, 0x02]) + number(3) + number(300) + number(5) + b"".join(map(number, (1, 2, 3, 400))) + number(70_000)
    assert kf8._values(tags, 2, data, 0) == {1: [300, 5], 2: [1, 2, 3, 400], 4: [70_000]}
    assert all(kf8.Reader(number(n), 0).number() == n for n in (0, 1, 127, 128, 16_383, 16_384, 2**31))
    with pytest.raises(ValueError):
        kf8.Reader(b"\x01\x02", 0).number()
    many = [(f"c{i}", [f"<p>{i} words of a chapter</p>"] * 3) for i in range(900)]  # several index records
    raw = mobi.write_kf8("T", "Me", many)
    assert [x[1] for x in mobi.mobi_items(raw)] == [c for c, _ in many]


def test_kf8_damage(spark):
    raw = mobi.write_kf8("T", "Me", [("One", ["<p>some text that is long</p>"])])
    files = spark.createDataFrame([("a", raw), ("b", raw.replace(b"FDST", b"xDST")), ("c", raw.replace(b"TAGX", b"xAGX")), ("d", raw[:-40]), ("e", raw[:200])], "path string, content binary")
    found = {r["path"]: r for r in mobi.read_mobi(files).collect()}
    assert found["a"]["title"] == "One" and all(found[k]["error"] for k in "bce")


ENTRIES = [(0, "Eins", 0), (1, "a", 1), (2, "b", 1), (1, "c", 2), (0, "Zwei 世", 3)]


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_pages_outline_and_metadata(packed):
    raw = pdf.write_pdf("Titel ü", "Me", 5, ENTRIES, packed)
    assert list(pdf.info_items(raw)) == [(5, "Titel ü", "Me", "0102", "ltr")]
    assert list(pdf.outline_items(raw)) == [(i, *e) for i, e in enumerate(ENTRIES)]
    assert list(pdf.page_items(raw)) == [(i, 300.0, 400.0) for i in range(5)]
    # without its cross-references, and with its end cut off, the objects are searched for
    for damaged in (raw.replace(b"startxref", b"startxxxx"), raw[:-12], raw.replace(b"startxref\n", b"startxref\n9")):
        assert list(pdf.info_items(damaged))[0][:3] == (5, "Titel ü", "Me")
    assert list(pdf.info_items(pdf.write_pdf("", "", 0, [], packed))) == [(0, None, None, "0102", "ltr")]
    assert len(list(media.pdf_pages(raw))) == 5
    for bad in (raw[:60], raw.replace(b"/Root", b"/Encrypt 4 0 R /Root"), b"no file"):
        with pytest.raises(ValueError):
            list(pdf.info_items(bad))


def test_pdf_objects():
    read = lambda raw: pdf.Lexer(raw).object()
    assert read(b"% note\n<</A#42 [1 -2.5 .5 true null (a\\(b\\)(c)\\101\\\nd) <48 6> 3 0 R]/B/C>>") == {"AB": [1, -2.5, 0.5, True, None, b"a(b)(c)Ad", b"H`", pdf.Ref(3)], "B": "C"}
    for bad in (b"[1 2", b"(abc", b"<<", b"[" * 500, b""):
        with pytest.raises(ValueError):
            read(bad)
    assert pdf.text(b"\xfe\xff\x4e\x16") == "世" and pdf.text(b"  ") is None and pdf.text(b"\xe9") == "é"


def test_pdf_predictors():
    rows = [bytes([10, 20, 30]), bytes([13, 25, 90]), bytes([1, 2, 250])]

    def written(kind):
        out, above = b"", bytes(3)
        for r in rows:
            paeth = lambda a, b, c: min((a, b, c), key=lambda x: abs(a + b - c - x))
            guess = [{0: 0, 1: r[i - 1] if i else 0, 2: above[i], 3: ((r[i - 1] if i else 0) + above[i]) // 2, 4: paeth(r[i - 1] if i else 0, above[i], above[i - 1] if i else 0)}[kind] for i in range(3)]
            out, above = out + bytes([kind]) + bytes((x - g) & 255 for x, g in zip(r, guess)), r
        return out

    for kind in range(5):
        assert pdf._unpredicted(written(kind), {"Predictor": 15, "Columns": 3}) == b"".join(rows)
    assert pdf._unpredicted(bytes([1, 1, 1, 5, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 5, 6, 7])


def test_pdf_inheritance_updates_and_loops():
    base = pdf.write_pdf("T", "A", 2, [(0, "x", 1)], packed=False)
    # an update replaces a page by a node with two pages, one of which is its own parent, and turns the other
    new = {5: b"<</Type/Pages/Kids[20 0 R 2 0 R]/MediaBox[10 0 110 50]>>", 20: b"<</Type/Page/Rotate 90>>"}
    out, at = bytearray(base), {}
    for n, body in new.items():
        at[n] = len(out)
        out += b"%d 0 obj " % n + body + b" endobj\n"
    table = len(out)
    previous = int(re.findall(rb"startxref\s+(\d+)", base)[-1])
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in at.items()) + b"trailer\n<</Root 1 0 R/Prev %d/Size 21>>\nstartxref\n%d\n%%%%EOF" % (previous, table)
    assert list(pdf.page_items(bytes(out))) == [(0, 50.0, 100.0), (1, 300.0, 400.0)]
    assert list(pdf.outline_items(bytes(out))) == [(0, 0, "x", 1)]


def test_pdf_tables(spark):
    good = pdf.write_pdf("T", "A", 3, ENTRIES[:2])
    files = spark.createDataFrame([("a", good), ("b", b"%PDF-1.4 nothing"), ("c", None)], "path string, content binary")
    found = {r["path"]: r for r in pdf.read_info(files).collect()}
    assert found["a"]["pages"] == 3 and found["a"]["error"] is None and found["b"]["error"] and found["c"]["error"]
    assert pdf.read_outline(files).where("error is null").count() == 2 and pdf.read_pages(files).where("error is null").count() == 3


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def encryption(*entries):
    data = "".join(f'<enc:EncryptedData><enc:EncryptionMethod Algorithm="{m}"/>{k}<enc:CipherData><enc:CipherReference URI="{u}"/></enc:CipherData>{p}</enc:EncryptedData>' for u, m, k, p in entries)
    return f'<encryption xmlns="urn:oasis:names:tc:opendocument:xmlns:container" xmlns:enc="http://www.w3.org/2001/04/xmlenc#" xmlns:ds="http://www.w3.org/2000/09/xmldsig#">{data}</encryption>'


AES, IDPF = "http://www.w3.org/2001/04/xmlenc#aes256-cbc", archives.FONT_METHODS[0]
KEY = f'<ds:KeyInfo><ds:RetrievalMethod URI="{archives.LICENCE_KEY}"/></ds:KeyInfo>'
PACKED = '<enc:EncryptionProperties><enc:EncryptionProperty><Compression Method="8" OriginalLength="42"/></enc:EncryptionProperty></enc:EncryptionProperties>'


def test_archive_kinds(spark):
    decoy = zipped(a_dot_txt="manifest.json and publication.json are names")
    files = {
        "epub": zipped(mimetype="application/epub+zip", a_dot_xhtml="x"),
        "epub2": zipped(a_dot_xhtml="x", **{"META-INF__container_dot_xml": "<container/>"}),
        "web": zipped(manifest_dot_json="{}"),
        "lpf": zipped(publication_dot_json="{}"),
        "deep": zipped(**{"b__manifest_dot_json": "{}"}),
        "decoy": decoy,
        "streamed": decoy[:-30],
        "text": b"manifest.json",
    }
    rows = spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content binary")
    none = F.lit(None).cast("string")
    got = {r["path"]: r["kind"] for r in rows.select("path", sniff.sniff(none, none, F.col("content")).alias("kind")).collect()}
    assert got == {"epub": "epub", "epub2": "epub", "web": "webpub_package", "lpf": "lpf", "deep": "zip", "decoy": "zip", "streamed": "zip", "text": None}


def test_encryption_of_archives():
    fonts = encryption(("fonts/a%20b.otf", IDPF, "", ""))
    book = encryption(("/text/1.xhtml", AES, KEY, PACKED), ("f.otf", IDPF, "", ""))
    other = encryption(("1.xhtml", AES, "", ""))
    made = lambda xml, **more: zipped(mimetype="application/epub+zip", **{"META-INF__encryption_dot_xml": xml}, **more)
    assert list(archives.encrypted_entries(made(book))) == [(0, "text/1.xhtml", AES, "lcp", "deflate", 42), (1, "f.otf", IDPF, None, None, None)]
    assert list(archives.encrypted_entries(made(fonts))) == [(0, "fonts/a b.otf", IDPF, None, None, None)]
    kinds = [archives.protection(x) for x in (zipped(a="x"), made(fonts), made(book), made(other), made(other, **{"META-INF__rights_dot_xml": "<r/>"}), zipped(license_dot_lcpl="{}"))]
    assert kinds == [None, None, "lcp", "unknown", "adept", "lcp"]


def test_pdf_outlines_are_written_and_read_in_proportion(monkeypatch):
    """Steps of the general lexer don't come up for usual files; odd objects inside lists are read as alone; a long outline takes no search among its later entries."""
    steps = []
    monkeypatch.setattr(pdf.Lexer, "skip", lambda self, f=pdf.Lexer.skip: (steps.append(1), f(self))[1])
    entries = [(0 if i % 50 == 0 else 1 + i % 2, f"line {i}", i % 3) for i in range(6000)]

    class Counted(list):
        passes = 0

        def __iter__(self):
            Counted.passes += 1
            return super().__iter__()

    raw = pdf.write_pdf("T", "A", 3, Counted(entries))
    assert Counted.passes < 10
    got = [e for _, *e in pdf.outline_items(raw)]
    assert len(got) > 100 and got[0] == [0, "line 0", 0] and len(steps) < 2 * len(entries) + 100
    odd = [b"1", b"-.5", b"2 0 R", b"2 0 Rx", b"/A#42", b"<486>", b"(a\\(b\\)(c)\\101)", b"<</A 1>>", b"[1 [2]]", b"true", b"null"]
    listed = pdf.Lexer(b"[% x\n" + b" ".join(odd) + b"]").object()
    assert listed == [1, -0.5, pdf.Ref(2), 2, 0, None, "AB", b"H`", b"a(b)(c)A", {"A": 1}, [1, [2]], True, None]
    for broken in (b"[1 2", b"[1 >> 2]", b"<</A 1]", b"[" * 300):
        with pytest.raises(ValueError):
            pdf.Lexer(broken).object()
