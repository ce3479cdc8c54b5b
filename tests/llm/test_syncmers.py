"""Operator 12 against plain Python over whole texts."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from quirelake.llm import syncmers as sm

from .test_operators import docs_of, empty, odd  # noqa: F401  a fixture


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def h64(raw, tag=None):
    return xxhash.xxh64_intdigest(raw, 42 if tag is None else xxhash.xxh64_intdigest(tag.to_bytes(4, "little"), 42))


def fingerprint(raw):
    """(hash, place) of the least anchors."""
    smers = [signed(h64(raw[i : i + sm.S])) for i in range(len(raw) - sm.S + 1)]
    w = sm.K - sm.S + 1
    found = [(h64(raw[i : i + sm.K]), i) for i in range(len(raw) - sm.K + 1) if min(smers[i], smers[i + w - 1]) == min(smers[i : i + w])]
    found += [(h64(raw[:i], 0), 0) for i in range(1, min(len(raw), sm.K - 1) + 1)]
    if raw:
        found.append((h64(raw[-sm.K :], 1), max(len(raw) - sm.K, 0)))
    least = {}
    for h, at in found:
        h >>= sm.PLACE_BITS + 1
        least[h] = min(at, least.get(h, at))
    return sorted(least.items())[: sm.KEPT]


def likeness(a, b):
    u = sorted({h for h, _ in a} | {h for h, _ in b})[: sm.KEPT]
    if not u:
        return 1.0
    where = dict(b)
    both = {h for h in u if h in dict(a) and h in where}
    shifts = sorted(where[h] - at for h, at in a if h in both)
    if not shifts:
        return 0.0
    slack = max(sm.SLACK, max(at for _, at in a + b) // sm.SHIFT)
    return sum(abs(s - shifts[len(shifts) // 2]) <= slack for s in shifts) / len(u)


def brute(rows):
    kept = sorted({(i is None, i or 0, t or "") for i, t in rows})
    # rows that share an id follow each other by hashes that are the operator's own, so the test has none of different texts
    assert len({x[:2] for x in kept}) == len(kept)
    out = {}
    for (missing, i, text), (_, _, after) in zip(kept, kept[1:] + kept[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        mine, changed = fingerprint(text.encode()), fingerprint(edited.encode())
        shown = lambda f: " ".join(f"{h:09x}:{at}" for h, at in f)
        out[None if missing else i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(mine), shown(changed), round(likeness(mine, changed), 9), round(likeness(mine, fingerprint(after.encode())), 9))
    return Counter((i, *out[i]) for i, _ in rows)


def got(df):
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect())


def prose(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "d\xf6lor", "sit", "你好", "am\xeat", "x", "\U0001f600"]) + str(rng.randrange(60)) for _ in range(n))


def test_equals_brute_force(spark, odd, monkeypatch):  # noqa: F811
    rng = random.Random(12)
    rows = [r[:2] for r in odd if r[0] is not None] + [(None, "the only one without an id " * 3)]
    rows += [(1000 + i, prose(rng, rng.choice([0, 1, 2, 3, 5, 9, 40, 300]))) for i in range(60)] + [(2000 + n, "abcdefghijklmnopqrstuvwxyz"[:n]) for n in range(26)]
    rows += [(3000, "a" * 400), (3001, "\x00" * 40), (3002, "a" * 399 + "b"), (3003, "q" * 15), (3003, "q" * 15)]
    want = brute(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    docs = docs_of(spark, [(*r, "en", "a") for r in rows])
    for part, n in ((sm.PART, "4"), (64, "23")):
        monkeypatch.setattr(sm, "PART", part)
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert got(sm.fingerprints(spark, docs)) == want
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_texts_and_edits(spark):
    rng = random.Random(1)
    text = prose(rng, 400)
    edit = re.sub("lorem5", "other", text)
    rows = [(1, text), (2, text), (3, edit), (4, "A passage before it. " * 10 + text), (5, prose(rng, 400)), (6, "zz")]
    found = {r["doc_id"]: r for r in sm.fingerprints(spark, docs_of(spark, [(*r, "en", "a") for r in rows])).collect()}
    assert found[1]["fingerprint"] == found[2]["fingerprint"] and found[1]["near_next"] == 1.0
    assert found[2]["near_next"] > 0.7  # a few edits
    assert found[3]["near_next"] > 0.6  # the same text at another place
    assert found[4]["near_next"] < 0.5 and found[5]["near_next"] == 0.0
    assert all(0.4 < found[i]["near_edited"] < 1 for i in (1, 2, 3, 4, 5))


def test_rows_that_share_an_id_and_rows_without(spark):
    rows = [(1, "one text of it"), (1, "another text of it"), (1, "one text of it"), (None, None), (None, ""), (None, "word")]
    found = sm.fingerprints(spark, docs_of(spark, [(*r, "en", "a") for r in rows])).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in found) == Counter((i, len(t or "")) for i, t in rows)
    assert len({tuple(r) for r in found}) == 4


@pytest.mark.parametrize("text", [None, "", "only"])
def test_one_row_is_next_to_itself(spark, text):
    found = sm.fingerprints(spark, docs_of(spark, [(7, text, None, None)])).collect()
    assert [(r["near_next"], r["next_id"]) for r in found] == [(1.0, 7)]


def test_empty_table(spark):
    assert sm.fingerprints(spark, empty(spark)).count() == 0


def test_plan_is_native_and_shuffles_texts_once(spark):
    found = sm.op12_syncmers(spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "ReusedExchange" in plan
