"""Small cases with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.functions import scalars as s
from quirelake.functions import tagexpr
from quirelake.functions import text as x
from quirelake.functions import wordpiece
from quirelake.operators import chapters, joins, keywords, licences, outlines, ranking, recommend, relational, retrieval, snapshots, windows

TAGS = {"A": 1, "B": 2, "C": 3}


@pytest.mark.parametrize(
    "text, clauses, excluded",
    [
        ("A AND (B OR C)", [[1], [2, 3]], set()),
        ("(A AND B) OR C", [[1, 3], [2, 3]], set()),
        ("A OR NO B", [], {2}),
        ("NO (A AND B)", [], {1, 2}),
        ("Z", [[-1]], set()),
        ("", [], set()),
        ("a and B", [[1]], set()),
        ("NO Z", [], set()),
        ("NO (Z)", [], set()),
        ("A AND", [[1], [-1]], set()),
        ("(A", [[1]], set()),
        ("BAND C", [[2], [3]], set()),
        ("A ANDNO B", [[1]], {2}),
    ],
)
def test_tag_expressions(text, clauses, excluded):
    got = tagexpr.compile_expression(text, TAGS)
    assert (got.clauses, set(got.excluded)) == (clauses, excluded)


def test_flat_terms(spark):
    groups = tagexpr.flat_terms([(1, "AND"), (2, "AND"), (3, "OR")])
    rows = spark.createDataFrame([([3],), ([1],), ([1, 2],), (None,)], "t array<bigint>")
    assert [r[0] for r in rows.select(tagexpr.matches_any_group(groups, F.col("t"))).collect()] == [True, False, True, False]


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, v if hasattr(v, "_jc") else F.lit(v))
    return row.select(column).first()[0]


def test_numbers_and_labels(spark):
    assert one(spark, s.large_number(F.lit(12345))) == "1.2万"
    assert one(spark, s.large_number(F.lit(80_000_000))) == "0.800亿"
    assert one(spark, s.duration(F.lit(3661))) == "1小时1分钟"
    assert one(spark, s.duration(F.lit(59))) == "59秒"
    assert one(spark, s.page_label_percent(F.lit("189 / 1987"))) == "9%"
    assert one(spark, s.div(F.lit(1000) * 1, 3)) == 333
    assert one(spark, s.pmi(F.lit(4), F.lit(100), F.lit(4), F.lit(8))) == pytest.approx(2.525729, abs=1e-6)
    assert one(spark, s.idf(F.lit(None).cast("double"), F.lit(1000), F.lit(6.0))) == pytest.approx(7.908755, abs=1e-6)
    assert [one(spark, windows.positions(F.lit(n))) for n in (0, 512, 1025)] == [1, 1, 3]
    assert one(spark, s.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, s.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0


def test_text(spark):
    assert one(spark, x.sentences(F.lit("你好。”他走了。"))) == ["你好。”", "他走了。"]
    assert one(spark, x.sentences(F.lit("A. B!! C"))) == ["A.", "B!!", "C"]
    assert one(spark, x.sentences(F.lit(" "))) == []
    assert x.percent_decode("%41+%42") == "A+B"
    assert one(spark, x.cut_after_html(F.lit("<html></html><img/>"))) == "<html></html>"
    assert one(spark, x.repaired_ampersands(F.lit("a & b &amp; &#12; &x"))) == "a &amp; b &amp; &#12; &amp;x"
    assert one(spark, x.without_watermarks(F.lit("a਀junk\nb"))) == "a\nb"
    assert x.drop_garbled("好" * 7 + "한글漢" + "好" * 9) == "好" * 9  # ten characters stand in a run of six with both
    assert "한" not in x.drop_garbled("好好好好好好好한글漢好好好好好好好好好")
    assert x.drop_garbled("plain ascii") == "plain ascii"
    assert x.resolve_path("OEBPS/text/a.xhtml", "../img/b.png") == "OEBPS/img/b.png"
    assert x.block_text("<p>a</p><p>b<br>c</p><script>x</script>") == "a\n\nb\nc"
    assert x.text_with_offsets("<b>a&amp;</b>z") == ("a&z", [3, 4, 13])
    got = x.content_elements('<body lang="fr"><h1>T</h1><p id="p">a <b>b</b></p><img src="i.png" alt="x"></body>')
    assert [(e["kind"], e["role"], e["text"]) for e in got] == [("text", "heading1", "T"), ("text", "body", "a b"), ("image", None, "x")]
    assert got[1]["selector"] == "#p" and got[1]["language"] == "fr" and got[2]["progression"] == pytest.approx(2 / 3)
    assert one(spark, x.numbered_lines(F.lit("1. a\n\n2、b\n- c"))) == ["a", "b", "c"]
    assert one(spark, x.first_numbers(F.lit("rank 12\nno\n3,4"))) == [12, 3]
    assert one(spark, x.indexed_summaries(F.lit("[1]: a\n[2]： b\n[1]: c"))) == {1: "a", 2: "b"}
    assert x.renamed("a%2Ab.png a*b.png", {"a*b.png": "1.png"}) == "1.png 1.png"


def test_chapters(spark):
    body = "字" * 150
    text = f"第一章 起\n{body}\n第二章 短\n{'字' * 20}\n第三章 末\n{body}"
    rows = chapters.detect(spark.createDataFrame([(1, text)], "book_id long, text string")).orderBy("start").collect()
    assert [r["title"] for r in rows] == ["第一章 起", "第三章 末"]
    parts = chapters.materialise(spark.createDataFrame([(1, "preface\n" + text)], "book_id long, text string"), chapters.detect(spark.createDataFrame([(1, "preface\n" + text)], "book_id long, text string")))
    assert [r["title"] for r in parts.orderBy("start").collect()] == ["text", "第一章 起", "第三章 末"]
    rows = spark.createDataFrame([(1, "a", 0, "x"), (1, "b", 5, "y"), (1, "c", 9, "z")], "book_id long, title string, start int, content string")
    assert [(r["title"], r["content"]) for r in chapters.absorb(rows, F.col("title") == "b").orderBy("start").collect()] == [("a", "x\ny"), ("c", "z")]
    assert chapters.sample_for_type(rows).count() == 3
    assert chapters.batches(rows, 2, rows.where("title = 'a'")).groupBy("batch").count().count() == 1


def test_keywords(spark):
    lex = keywords.Lexicon(words={"北京": 50, "大学": 40, "北京大学": 60, "生": 5}, kinds={"北京大学": "nt", "生": "n"})
    assert keywords.cut("北京大学生 Hello9", lex) == ["北京大学", "生", "hello9"]
    assert keywords.short_text_keywords("北京大学生", lex) == ["北京大学"]
    cands = spark.createDataFrame([(1, "罗伯斯庇", 5), (1, "罗伯斯庇尔", 5)], "book_id long, gram string, n long")
    words = spark.createDataFrame([], "word string")
    assert [r["gram"] for r in keywords.without_substrings(cands, words).collect()] == ["罗伯斯庇尔"]
    names = spark.createDataFrame([(1, "薛牧", 9), (1, "薛牧来", 3), (1, "姬无忧", 5), (1, "无忧", 6)], "book_id long, gram string, n long")
    assert {r["gram"] for r in keywords.without_name_verbs(names, {"薛", "姬"}).collect()} == {"薛牧", "姬无忧", "无忧"}
    assert "无忧" not in {r["gram"] for r in keywords.without_given_names(names, {"薛", "姬"}).collect()}
    assert keywords.diverse([("女巫之锤", 5.0), ("女巫", 4.9), ("城", 4.5)], 3) == [("女巫之锤", 5.0), ("城", 4.5), ("女巫", 4.9)]
    grams = spark.createDataFrame([(1, "g", c, "x") for c in "ab"], "book_id long, gram string, left string, right string")
    assert keywords.neighbour_entropy(grams).first()["left_entropy"] == pytest.approx(math.log(2))
    text = "。".join(["山艾洛丝水", "看艾洛丝书", "听艾洛丝歌", "问艾洛丝话", "石艾洛丝火", "风艾洛丝雨"] * 3 + ["信书歌话山水石火风雨看听问"] * 40)
    found = keywords.new_words(spark.createDataFrame([(1, text)], "book_id long, text string"), keywords.Lexicon(), words)
    assert "艾洛丝" in {r["gram"] for r in found.collect()}
    mined = keywords.mine(spark.createDataFrame([(1, text + "北京大学" * 4)], "book_id long, text string"), lex, spark.createDataFrame([(w,) for w in lex.words], "word string"), spark.createDataFrame([], "word string, idf double"), spark.createDataFrame([], "word string, df long"))
    rows = {r["keyword"]: (r["weight"], r["rank"]) for r in mined.collect()}
    assert "北京大学" in rows and max(w for w, _ in rows.values()) == 1.0 and min(w for w, _ in rows.values()) >= 0.05


def test_recommendation(spark):
    kw = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y"), (2, "y"), (3, "y"), (9, "z")], "book_id long, keyword string").withColumn("weight", F.lit(1.0))
    seeds = spark.createDataFrame([("x", 1.0)], "keyword string, weight double")
    got = {r["keyword"]: r["weight"] for r in recommend.expand(kw, seeds).collect()}
    assert got == {"x": 1.0, "y": pytest.approx(2 / 3 * 0.4)}
    assert one(spark, recommend.quality(F.lit("Google Books"), F.lit("4.5"), F.log10(F.lit(50.0)), F.lit("d"))) == pytest.approx(0.965)
    empty = F.array().cast("array<string>")
    side = lambda *t: {"tags": F.array(*map(F.lit, t)), "author": F.lit("Me"), "title": empty, "description": empty, "contents": F.create_map().cast("map<string,double>")}
    assert one(spark, recommend.relevance(side("a", "b"), side("b", "c"))) == pytest.approx(0.35 / 3 + 0.20)


def test_windows_and_ranking(spark):
    rows = spark.createDataFrame([(1, i, "ch1" if i < 5 else "") for i in range(7)], "book_id long, chunk_index long, chapter string")
    assert [r["chunk_index"] for r in retrieval.dedup_by_chapter(rows, ["chunk_index"]).orderBy("chunk_index").collect()] == [0, 1, 2, 5, 6]
    runs = spark.createDataFrame([(1, 0, 150), (1, 200, 420), (1, 900, 950)], "k long, a long, b long")
    assert [(r["a"], r["b"]) for r in windows.merge_runs(runs, ["k"], "a", "b", 100, 200).collect()] == [(0, 420)]
    total = windows.running_total(spark.createDataFrame([(i, 2) for i in range(50)], "id long, v long"), "id", "v", 4)
    assert all(r["before"] == 2 * r["id"] for r in total.collect())
    picks = ranking.weighted_sample(spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "id long, w double"), "id", "w", 10, 3)
    assert picks.count() == 10 and picks.where("id % 2 = 0").count() == 0
    budget = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc")], "k long, i long, t string")
    assert [r["t"] for r in windows.within_budget(budget, ["k"], ["i"], "t", 6).orderBy("i").collect()] == ["aaaa", "bb…"]


def test_relations_and_writes(spark):
    edges = spark.createDataFrame([(1, 2, 0), (3, 1, 1), (1, 4, 2)], "book_id long, related_id long, status int")
    assert {r["id"] for r in joins.related(edges, 1).collect()} == {2, 3}
    changed = {tuple(r) for r in joins.change_links(edges.withColumn("book_id", F.least("book_id", "related_id")).withColumn("related_id", F.greatest(F.lit(2), "related_id")), edges.where("related_id = 2"), edges.where("related_id = 4")).collect()}
    assert (1, 2, 2) in changed and (1, 4, 1) in changed
    table = spark.createDataFrame([(1, "a", 10)], "id long, v string, n long")
    up = relational.upsert(table, spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 3)], table.schema), ["id"], [F.desc("n")])
    assert {tuple(r) for r in up.collect()} == {(1, "c", 2), (2, "d", 3)}
    daily = relational.daily_rollup(spark.createDataFrame([("d1", 1, 10)], "day string, book long, seconds long"), spark.createDataFrame([("d1", 2, 5), ("d2", 1, 3), ("d1", 1, 1)], "day string, book long, seconds long"), ["day", "book"], "seconds")
    assert {tuple(r) for r in daily.collect()} == {("d1", 1, 11), ("d1", 2, 5), ("d2", 1, 3)}


def test_backup_and_vectors(spark, tmp_path):
    import struct

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    snapshots.back_up(spark, {"books": df}, str(tmp_path / "b"))
    assert snapshots.restore(spark, str(tmp_path / "b"))["books"].count() == 2
    with pytest.raises(ValueError):
        snapshots.back_up(spark, {"../x": df}, str(tmp_path / "c"))
    values = [1.5, -0.25, 0.0, 3.1415927]
    blob = spark.createDataFrame([(bytearray(struct.pack("<4f", *values)), 4)], "vector binary, dim int")
    assert snapshots.decoded_vectors(blob).first()["vector"] == pytest.approx(values)


def test_search(spark):
    docs = spark.createDataFrame([(1, "aaa b"), (2, "xyz")], "id long, text string")
    assert sorted(r["start"] for r in retrieval.find_all(docs, "AA").collect()) == [0, 1]
    assert one(spark, retrieval.snippet(F.lit("one\ntwo three"), F.lit(4), 3)) == "one 「two」 three"
    assert retrieval.route(["a"], True) == "chapters" and retrieval.route([], True) == "digest" and retrieval.route([], False) == "standard"


def test_running_total_of_many_rows(spark):
    """Sums are right with extra columns and many parts, and for rows that share a place in the order with none."""
    from quirelake.operators import windows as w

    rows = spark.range(0, 200_000, 1, 16).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"), F.concat(F.lit("x"), "id").alias("extra"))
    out = w.running_total(rows, "id", "v", 64)
    got = out.select("id", "v", "before", "extra").orderBy("id").toPandas()
    assert len(got) == 200_000
    assert (got["before"] == got["v"].cumsum().shift(fill_value=0)).all()
    assert w.running_total(rows.limit(0), "id", "v", 8).count() == 0


def test_text_hashes(spark):
    texts = ["", "a", "hello", "文字", "é😀", None]

    def fnv(t):
        h = 2166136261
        for b in t.encode("utf-8"):
            h = (h ^ b) * 16777619 % (1 << 32)
        return h

    def polynomial(t):
        h, raw = 0, t.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + raw[i] * 256 + raw[i + 1]) % (1 << 32)
        return h - (1 << 32) if h >= 1 << 31 else h

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", s.fnv1a_32(F.col("t")).alias("f"), s.string_hash(F.col("t")).alias("h")).collect()
    assert [(r["f"], r["h"]) for r in got] == [(fnv(t), polynomial(t)) if t is not None else (None, None) for t in texts]


def test_points_in_spans(spark):
    """Against all pairs, with ends on the edges of buckets and spans over several."""
    rows = lambda r, names: spark.createDataFrame(r, names).withColumn("t", F.timestamp_seconds("t"))
    points = rows([(i % 3, i * 50) for i in range(100)], "k long, t long")
    raw = [(0, 100, 100), (0, 0, 1800), (1, 1799, 5000), (2, 3600, 3601), (2, 0, 99_999)]
    spans = spark.createDataFrame(raw, "k long, a long, b long").select("k", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("stop"))
    got = joins.points_in_spans(points, spans, ["k"], "t", 1800).select("k", F.unix_seconds("t"), F.unix_seconds("start")).collect()
    want = [(i % 3, i * 50, a) for i in range(100) for k, a, b in raw if k == i % 3 and a <= i * 50 < b]
    assert sorted(map(tuple, got)) == sorted(want)


def test_labels_and_languages(spark):
    texts = spark.createDataFrame([("abc",), ("你好",), ("這",), ("",)], "text string")
    assert [r[0] for r in texts.select(x.language_boost(F.col("text"))).collect()] == [-0.4, 1.0, 0.5, 0.0]
    assert [one(spark, s.page_label_percent(F.lit(v))) for v in ("5/4", "chapter")] == ["100%", "chapter"]
    assert [one(spark, s.clock_seconds(F.lit(v))) for v in ("1:02:03.5", "02:03", "5h", "2min", "7.5", "500ms", "x")] == [3723.5, 123, 18000, 120, 7.5, 0.5, None]
    assert [one(spark, s.type_of_label(F.lit(v))) for v in ("长篇网文", "历史学术类", "短篇同人", "?")] == ["webnovel", "history_academic", "collection_fanfic", "general"]
    assert one(spark, x.sections(F.lit("前言【主角】 甲乙\n【背景】旧都 "), ["主角", "背景"])) == {"主角": "甲乙", "背景": "旧都"}
    assert [one(spark, x.is_chinese_name(F.lit(v))) for v in ("刘慈欣", "刘 慈欣", "Liu", "")] == [True, False, False, False]
    assert [one(spark, s.cloud_size(F.lit(w))) for w in (-1.0, 0.0, 0.5, 1.0, 7.0)] == [12, 12, 24, 36, 36]
    assert [one(spark, s.iso_instant(F.lit(v))) is None for v in ("2024-01-05T06:07:08Z", "yesterday", None)] == [False, True, True]
    assert one(spark, F.date_format(s.iso_instant(F.lit("2024-01-05T06:07:08+02:00")), "HH:mm")) == "04:07"
    assert [one(spark, F.round(s.popularity(F.lit(n)), 6)) for n in (0, 9, 99)] == [0, 1, 2]
    assert [one(spark, retrieval.is_temporal(F.lit(v))) for v in ("什么时候认识的", "主题是什么", "故事的起因")] == [True, False, True]


def test_pooled_vectors():
    states = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [[1.0, 1.0], [1.0, 1.0], [1.0, 1.0]]])
    got = wordpiece.pooled(states, np.array([[1, 1, 0], [0, 0, 0]]))
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == pytest.approx([0, 0])


def test_licence_lookups(spark):
    rows = spark.createDataFrame([(1, "u", "p", "abc"), (2, "v", "p", None), (3, "u", "q", "abc"), (4, "u", None, "def")], "id long, user string, provider string, passphrase string")
    assert sorted(r["id"] for r in licences.by_user(rows, "u").collect()) == [1, 3, 4]
    assert sorted(r[0] for r in licences.passphrases(rows).collect()) == ["abc", "def"]
    assert [r[0] for r in licences.passphrases(rows, "q").collect()] == ["abc"]


def test_outlines(spark):
    deep = "".join(f'{{"title":"{i}","children":[' for i in range(40)) + '{"title":"leaf","summary":7}' + "]}" * 40
    texts = ['{"title":"T","children":[{"summary":"s"},"text",{"title":"U","children":[{"title":"V"}]},3,null]}', "```json\n{\"title\":\"X\"}\n```", '{"title":" "}', "no json", None, "[1]", '{"children":[]}', deep]
    got = outlines.outline_nodes(spark.createDataFrame(list(enumerate(texts)), "id int, json string"), "id")
    rows = sorted((r["id"], list(r["path"]), r["depth"], r["title"], r["summary"]) for r in got.collect())
    assert [r for r in rows if r[0] < 7] == [(0, [], 0, "T", ""), (0, [0], 1, outlines.UNTITLED, "s"), (0, [2], 1, "U", ""), (0, [2, 0], 2, "V", ""), (1, [], 0, "X", ""), (6, [], 0, outlines.UNTITLED, "")]
    assert [(r[2], r[3]) for r in rows if r[0] == 7] == [(i, str(i)) for i in range(40)] + [(40, "leaf")] and rows[-1][4] == "7"
    parts = spark.createDataFrame([(2, 0, "a", "b"), (2, 1, "c", "d"), (1, 0, "e", "f")], "id int, position int, title string, summary string")
    more = sorted((r["id"], list(r["path"]), r["title"]) for r in outlines.or_chapters(got.where("id = 1"), parts, "id").collect())
    assert more == [(1, [], "X"), (2, [], outlines.WHOLE), (2, [0], "a"), (2, [1], "c")]


def test_search_in_results(spark):
    rows = spark.createDataFrame([(1, "The End", "x", None, "Ann"), (2, "b", "the ENDing", "end", ""), (3, "c", "", "", "")], "id int, title string, summary string, events string, characters string")
    assert {r["id"]: r["found"] for r in outlines.search_results(rows, F.lit(" end ")).collect()} == {1: ["title"], 2: ["summary", "events"]}
    assert outlines.search_results(rows, F.lit("")).count() == 3


def test_links_of_author_classes(spark):
    books = spark.createDataFrame([(1, "Ann"), (2, "Ann"), (3, "Ann, Bob"), (4, "Bob"), (5, "Unknown"), (6, "Zoe"), (7, None)], "id long, author string")
    own = spark.createDataFrame([(1, 3, 1), (1, 4, 2), (2, 3, 0)], "book_id long, related_id long, status int")
    members = {r["id"]: (r["class_id"], r["n_links"]) for r in joins.link_classes(books).collect()}
    assert members == {1: (1, 2), 2: (1, 2), 3: (3, 3), 4: (4, 1), 6: (6, 0)}
    links = {(r["book_id"], r["related_id"], r["status"], r["classes"]) for r in joins.sync_class_links(own, books).collect()}
    assert links == {(1, 3, 1, False), (1, 4, 2, False), (1, 1, 0, True), (1, 3, 0, True), (3, 4, 0, True)}
    # the members' pairs are the links of author_links
    expanded = {(min(a, b), max(a, b)) for x_, y_, _, c in links if c for a, (ca, _) in members.items() for b, (cb, _) in members.items() if (ca, cb) == (x_, y_) and a != b}
    assert expanded == {(r["book_id"], r["related_id"]) for r in joins.author_links(books).collect()}


def test_sources_without_a_cap(spark):
    rows = spark.createDataFrame([(f"t{i}", "a", "x" if i % 2 else None, float(i)) for i in range(20)], "title string, author string, source string, score double")
    assert recommend.merge_sources([rows], [0.0], {"x": 2}, 30).count() == 12


def test_keywords_of_books_of_one_row_need_no_shuffle_of_words(spark):
    texts = spark.createDataFrame([(1, "Banana banana cherry x"), (2, None), (3, "orange"), (3, "orange apricot apricot apricot"), (None, "walnut"), (None, "walnut")], "book_id long, text string")
    rows = {(r["book_id"], r["keyword"]): (r["weight"], r["rank"]) for r in keywords.simple_keywords(texts).collect()}
    assert rows == {(1, "banana"): (1.0, 0), (1, "cherry"): (0.5, 1), (3, "apricot"): (1.0, 0), (3, "orange"): (round(2 / 3, 6), 1), (None, "walnut"): (1.0, 0)}
    one = keywords.simple_keywords(texts.where("book_id < 3"))
    assert one.count() == 2 and "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_similar_books_meet_in_blocks_without_rows_for_pairs(spark, monkeypatch):
    import random

    from quirelake.operators import nearest, similar_books

    draw = random.Random(7)
    some = lambda n, of: draw.sample([f"w{i}" for i in range(of)], draw.randint(0, n))
    books = [(i, draw.choice(["Long Title", "long", "a", None, "other", "the other one"]), draw.choice(["ann", " Ann", "", None, "bob"]), some(4, 6), draw.choice([None, some(3, 9)]), some(5, 30)) for i in range(60)]
    marks = [(b[0], w, draw.random()) for b in books for w in some(5, 12)]
    kind = "id long, title string, author string, tags array<string>, title_words array<string>, description_words array<string>"
    table, keys = spark.createDataFrame(books, kind), spark.createDataFrame(marks, "book_id long, keyword string, weight double")
    monkeypatch.setattr(nearest, "ROWS", 16)
    monkeypatch.setattr(nearest, "QUERIES", 4)
    found = similar_books.single_book(table, keys, table.where("id % 5 = 0"), 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") == 1 and "Generate" not in plan  # words aren't joined with words
    df = {w: sum(k == w for _, k, _ in marks) for w in {k for _, k, _ in marks}}
    of = {b[0]: {k: w * math.log1p(df[k]) for i, k, w in marks if i == b[0]} for b in books}
    j = lambda x, y: len({*(x or [])} & {*(y or [])}) / max(1, len({*(x or [])} | {*(y or [])}))

    def score(x, y):
        a, b = ((z[2] or "").strip().lower() for z in (x, y))
        hit = sum(w * of[y[0]].get(k, 0) for k, w in of[x[0]].items()) / max(sum(of[x[0]].values()), 1e-9)
        out = 0.35 * j(x[3], y[3]) + 0.2 * (a != "" and a == b) + 0.1 * j(x[4], y[4]) + 0.2 * j(x[5], y[5]) + 0.15 * min(1.0, hit)
        s, t = ((z[1] or "").lower() for z in (x, y))
        return round(max(out, 0.4) if min(len(s), len(t)) >= 2 and (s in t or t in s) else out, 6)

    want = {}
    for x in books[::5]:
        best = sorted((-score(x, y), y[0]) for y in books if x[0] != y[0] and score(x, y) > 0)[:7]
        want |= {(x[0], i + 1): (y, pytest.approx(-v, abs=2e-6)) for i, (v, y) in enumerate(best)}
    assert {(r["seed"], r["rank"]): (r["id"], r["score"]) for r in found.collect()} == want


def test_similar_books_score_few_pairs_in_full(monkeypatch):
    import random

    import pyarrow as pa

    from quirelake.operators import similar_books
    from quirelake.operators.nearest import Best

    draw = random.Random(3)
    some = lambda least, most, of: draw.sample(range(of), draw.randint(least, most))
    word = lambda: "".join(draw.choice("ab") for _ in range(draw.randint(3, 9)))
    books = []
    for i in range(4000):
        keys = sorted(some(0, 8, 300))
        books.append((i, draw.choice(["ann", "bob", None, "cleo", "ann"]), draw.choice([None, word()]), some(0, 5, 12), some(0, 3, 200), some(0, 4, 200), keys, [draw.random() for _ in keys]))
    books += [(i, *books[i % 7][1:]) for i in range(4000, 4060)]  # copies: ties go by id
    books += [(12, *books[40][1:]), (9000, None, None, [], [], [], [], [])]  # an id twice, and a book like none
    lists = pa.list_(pa.int64())
    kind = pa.schema([("id", pa.int64()), ("author", pa.string()), ("title", pa.string()), ("tags", lists), ("title_words", lists), ("description_words", lists), ("contents", lists), ("w", pa.list_(pa.float64()))])
    table = lambda rows: pa.Table.from_pylist([dict(zip(kind.names, r)) for r in rows], kind).combine_chunks()
    seeds = books[::100] + [books[-1]]
    full = []
    monkeypatch.setattr(similar_books, "rounded", lambda x, rounded=similar_books.rounded: full.append(len(x)) or rounded(x))
    asked, best = similar_books._Block(table(seeds)), Best(len(seeds), 10)
    half = len(books) // 2
    for part in (books[:half], books[half:]):  # a later block adds to what an earlier one gave
        similar_books._meet(asked, similar_books._Block(table(part)), best)
    assert sum(full) < len(seeds) * len(books) / 10
    j = lambda x, y: len({*x} & {*y}) / max(1, len({*x} | {*y}))

    def score(x, y):
        hit = sum(w * dict(zip(y[6], y[7])).get(k, 0) for k, w in zip(x[6], x[7])) / max(sum(x[7]), 1e-9)
        out = 0.35 * j(x[3], y[3]) + 0.2 * (x[1] is not None and x[1] == y[1]) + 0.1 * j(x[4], y[4]) + 0.2 * j(x[5], y[5]) + 0.15 * min(1.0, hit)
        return max(out, 0.4) if x[2] and y[2] and (x[2] in y[2] or y[2] in x[2]) else out

    of = {x[0]: x for x in seeds}
    for q, i in enumerate(asked.ids.tolist()):
        want = sorted((-round(score(of[i], y), 6), y[0]) for y in books if y[0] != i and score(of[i], y) > 0)[:10]
        got = [(-s, int(b)) for s, b in zip(best.score[q], best.id[q]) if s > -float("inf")]
        assert [b for _, b in got] == [b for _, b in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-6), i


def test_similar_books_read_texts_for_keywords_once(spark):
    from quirelake.plans import registry

    found = registry.QUERIES["single_book"](spark, "/root/testdata/sf0.001")
    assert found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Final Plan" in final and final.count("ArrowEvalPython") == 1


def test_packed_blocks_grow_and_flags_part_them(spark):
    from quirelake.operators import nearest

    rows = spark.range(40, numPartitions=1).selectExpr("id", "id % 4 = 0 as asked")
    blocks = [nearest.unpacked(r["data"]) for r in nearest.packed(rows, 8, "asked", False, 2).collect()]
    assert [b.num_rows for b in blocks] == [2, 4, 8, 8, 8] and blocks[0].column_names == ["id"]
    assert sorted(x for b in blocks for x in b["id"].to_pylist()) == [i for i in range(40) if i % 4]
    asked = nearest.repacked(nearest.packed(rows, 3, "asked", True), 100, 1).collect()
    assert [nearest.unpacked(r["data"])["id"].to_pylist() for r in asked] == [list(range(0, 40, 4))]


def test_most_frequent_words_by_count_then_word():
    import random

    draw = random.Random(5)
    for n in (0, 1, 5, 60):
        counts = {f"w{draw.randrange(1000)}": draw.randint(1, 4) for _ in range(n)}
        for most in (0, 1, 3, 10, 100):
            assert keywords.most_frequent(counts, most) == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]


def test_nearest_vectors_make_no_row_for_a_pair(spark, monkeypatch):
    from quirelake.operators import nearest

    monkeypatch.setattr(nearest, "ROWS", 8)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    rows = [(i, [math.cos(i % 12), math.sin(i % 12)]) for i in range(40)] + [(50, None), (51, [1.0, None]), (52, [1.0 / 128, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    queries = vectors.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = retrieval.vector_top(vectors, queries, 6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    score = F.round(s.dot(F.col("v"), F.col("q")), 6).alias("score")
    plain = ranking.cap_by(vectors.crossJoin(queries).select("query_id", "id", score), ["query_id"], [F.desc("score"), "id"], 6)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert found.where("query_id = 50").count() == 6


def test_equal_runs_of_a_book_are_cut_once(spark):
    texts = spark.createDataFrame([(1, "abc abc abd"), (1, "abc"), (2, "abc")], "book_id long, text string")
    grams = keywords.ngrams(texts, 2, "[a-z]+")
    assert grams.count() == 15  # five grams of each of three runs, not of five
    assert {(r["book_id"], r["gram"], r["n"]) for r in keywords.gram_counts(grams, 3).collect()} == {(1, "a", 4), (1, "b", 4), (1, "ab", 4), (1, "c", 3), (1, "bc", 3)}
    right = {r["gram"]: r["right_total"] for r in keywords.neighbour_entropy(grams).where("book_id = 1").collect()}
    assert right["ab"] == 4 and right["d"] == 1


def test_documents_reach_python_in_bounded_batches(spark):
    import os

    from quirelake.batches import ARROW_BYTES
    from quirelake.plans import registry

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables are not here")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    for name in ("mobi_sniff", "mobi_round_trip", "kf8_round_trip", "kf8_links", "epub_round_trip"):
        registry.QUERIES[name](spark, data)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(ARROW_BYTES)
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_links_of_their_own_are_left_out_of_class_links(spark):
    books = spark.createDataFrame([(1, "Ann"), (2, "Ann"), (3, "Ann, Bob"), (4, "Bob")], "id long, author string")
    own = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (2, 4, 1), (3, 4, 0)], "book_id long, related_id long, status int")
    links = {(r["book_id"], r["related_id"]): r["n_links"] for r in joins.sync_class_links(own, books).where("classes").collect()}
    assert links == {(1, 3): 1, (3, 4): 1}  # the only pair of Ann's books is blocked
