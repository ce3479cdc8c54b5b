"""Operator 11 against whole texts encoded by the libraries and aligned in plain Python."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.llm import token_alignment as ta

from .test_operators import docs_of, empty, odd  # noqa: F401  a fixture


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(ta.tokenizer_path(ta.A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.tokenizer_path(ta.B))
    _, _, a_bytes, b_bytes = ta.encoders(ta.tokenizer_path(ta.A), ta.tokenizer_path(ta.B))
    assert ta.words_apart(ta.tokenizer_path(ta.B))
    return a, b, a_bytes, b_bytes


def tokens(sides, text):
    a, b, a_bytes, b_bytes = sides
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(a_bytes[i] for i in x) != (" " + text).encode() or b"".join(b_bytes[i] for i in y) != (" " + text).encode():
        return [], []
    return [(i, a_bytes[i]) for i in x], [(i, b_bytes[i]) for i in y]


def brute(sides, texts):
    """A row for each text."""

    def ends(side):
        at, out = 0, []
        for i, raw in side:
            at += len(raw)
            out.append((at, i))
        return out

    rows, pairs = [], Counter()
    for text in texts:
        x, y = (ends(s) for s in (tokens(sides, text) if text else ([], [])))
        cuts = sorted({e for e, _ in x} & {e for e, _ in y})
        groups = [[[i for e, i in s if low < e <= high] for s in (x, y)] for low, high in zip([0, *cuts], cuts)] if len(x) < 3000 else None
        if groups is None:  # the same in one pass
            groups, i, j = [], 0, 0
            for c in cuts:
                k, n = i, j
                while x[i][0] < c:
                    i += 1
                while y[j][0] < c:
                    j += 1
                i, j = i + 1, j + 1
                groups.append([[t for _, t in x[k:i]], [t for _, t in y[n:j]]])
        links = [(dict(x)[c], dict(y)[c]) for c in cuts] if len(cuts) < 3000 else list(zip(*(map(d.get, cuts) for d in (dict(x), dict(y)))))
        pairs.update(links)
        rows.append((len(x), len(y), groups, links))
    top = {}
    for (_, b), n in pairs.items():
        top[b] = max(top.get(b, 0), n)
    return [(na, nb, len(g), len(ls), sum(pairs[p] == top[p[1]] for p in ls), sum(pairs[p] for p in ls), ";".join("|".join(",".join(map(str, s)) for s in x) for x in g)) for na, nb, g, ls in rows]


def check(spark, sides, rows):
    found = ta.align(spark, docs_of(spark, rows))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = Counter((r[0], *w) for r, w in zip(rows, brute(sides, [r[1] for r in rows])))
    assert Counter(tuple(r) for r in found.collect()) == want


ODD_SPACES = [t for c in (0x0, 0x1C, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x2581, 0x3000, 0xFEFF) for t in (f"a{chr(c)}b", f"a{chr(c)} b {chr(c)}c")]
SPECIAL = [*ODD_SPACES, "<|endoftext|>", "<s>x</s>", "<0x41> a", "a  b", "  lead", "trail ", "trail   ", " ", "   ", "\n\n a\n b", "caf\xe9 na\xefve", "\u4f60\u597d \u4e16\u754c", "it's  we'll 'tis", "tab\t tab", "\U0001f600 \U0001f600\U0001f601", "word", "a" * 500, "1234 5678  90", "e\u0301 e"]


def test_equals_brute_force(spark, odd, sides):  # noqa: F811
    check(spark, sides, [*odd, *[(400 + i, t, "en", "a") for i, t in enumerate(SPECIAL)], (403, "a  b", "en", "a"), (403, "a  b", "fr", "a")])


def test_rare_words_take_the_other_join(spark, sides, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[: 1 + rng.randrange(300)]) for _ in range(rng.randint(1, 60))), "en", "a") for i in range(80)]
    for n in (0, 20, 100):
        monkeypatch.setattr(ta, "HOT_ROWS", n)
        check(spark, sides, rows)


def test_a_text_without_spaces(spark, sides):
    rng = random.Random(9)
    check(spark, sides, [(1, "".join(rng.choice("abcde,;1é") for _ in range(40_000)), "en", "a"), (2, "ab", "en", "a")])


def test_tokenizers_that_join_words(spark, sides, monkeypatch):
    monkeypatch.setattr(ta, "words_apart", lambda _: False)
    check(spark, sides, [(i, t, "en", "a") for i, t in enumerate(SPECIAL)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", " ", "  ", "\n", "\t", *map(chr, (0x1C, 0x85, 0xA0, 0x180E, 0x200B, 0x2581, 0x3000)), "a", "B", "9", ".", "'s", "\xdf", "\u4e16", "\U0001f600"]) | st.characters(exclude_categories=["Cs"]), max_size=25))
def test_words_have_the_same_tokens_alone(sides, some):
    import re

    text = "".join(some)
    x, y = tokens(sides, text)
    if not text or not x:
        return
    by_a, by_b, *_ = ta.encoders(ta.tokenizer_path(ta.A), ta.tokenizer_path(ta.B))
    parts = re.split(ta.CUT, text)
    assert [i for ids in by_a(parts) for i in ids] == [i for i, _ in x]
    assert [i for ids in by_b(parts) for i in ids] == [i for i, _ in y]


def test_empty_tables(spark):
    assert ta.align(spark, empty(spark)).count() == 0
    assert [r["n_a"] for r in ta.align(spark, docs_of(spark, [(1, None, None, None)])).collect()] == [0]


def test_query_hashes_the_groups(spark, sides):
    found = ta.op11_token_alignment(spark, "/root/testdata/sf0.001")
    assert found.where("(n_groups = 0) <> (groups_sha256 = '')").count() == 0
    assert found.where(F.length("groups_sha256").isin(0, 64)).count() == found.count()


def test_pair_tables_go_when_they_were_read(spark, monkeypatch):
    from pathlib import Path

    names = []
    monkeypatch.setattr(ta, "written", lambda s, df, name, *a, f=ta.written: (out := f(s, df, name, *a), names.append((name, out.inputFiles()[0])))[0])
    words = spark.createDataFrame([(0, "a", 3, [(1, 2)]), (1, "b", 1, [(1, 2), (4, 2)])], "unit long, part string, n long, links array<struct<a int, b int>>")
    got = {r["part"]: (r["n_best"], r["count_sum"]) for r in ta.weighed(spark, words).collect()}
    assert got == {"a": (1, 4), "b": (1, 5)}
    assert [n for n, f in names if Path(f.removeprefix("file://")).exists()] == ["words"]


def test_rare_words_are_written_before_the_texts_are_dealt(spark, sides, monkeypatch):
    """The way of rare words to their words and the way back are never on disk at once, and a text's rows meet without being dealt again."""
    from pathlib import Path

    monkeypatch.setattr(ta, "HOT_ROWS", 5)
    names = []
    monkeypatch.setattr(ta, "written", lambda s, df, name, *a, f=ta.written: (out := f(s, df, name, *a), names.append((name, out.inputFiles()[0])))[0])
    found = ta.align(spark, docs_of(spark, [(i, f"word{i} of the text of {i * i}", "en", "a") for i in range(40)]))
    assert [n for n, f in names if Path(f.removeprefix("file://")).exists()] == ["texts", "common", "rare"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "SortMergeJoin" not in plan
    assert found.count() == 40
