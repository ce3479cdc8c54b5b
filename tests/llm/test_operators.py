"""The training-data operators against brute force, with odd rows."""

import io
import itertools
import random
import sys
import time
import unicodedata
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.llm import common, embedding_dedup, exact_dedup, language_id, mixing, order_minhash, packing, quality, token_counts, toxicity, warc, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, sha string, slot long, n int"
LONG = "lorem ipsum dolor sit amet " * 4000


def docs_of(spark, rows):
    """Documents with extra columns that clash with names inside the operators."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", "s", 1, 1) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = say(120)
    edit = lambda t, k: " ".join(rng.choice(vocab) if rng.random() < k else w for w in t.split())
    rows = [(i, say(rng.randint(5, 80)), rng.choice(["en", "fr"]), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(100 + i, edit(base, 0.03), "en", "a") for i in range(25)]
    rows += [(200 + i, base, "en", "a") for i in range(5)] + [(210, base.replace(" ", " \t"), "en", "b"), (210, base.replace(" ", " \t"), "en", "b")]
    rows += [(300, None, None, None), (301, "", "en", ""), (302, "", None, "a"), (303, " \n", "fr", "b"), (None, "no id " + say(20), "en", "a"), (None, None, None, None), (304, LONG, "en", "c"), (305, "?!", "en", "c")]
    return rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 --------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.95):
    fit = [(i, np.array(v, "f8")) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, u), (b, v) in itertools.combinations(fit, 2):
        if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (links[i], find(i)) for i, _ in rows}


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((4, 16))
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(60)]
    rows += [(100 + i, (centre[i % 4] + 0.12 * rng.standard_normal(16)).tolist()) for i in range(80)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, None), (303, [0.0] * 16), (304, []), (305, [float("nan")] + [1.0] * 15), (306, [None] + [1.0] * 15), (307, [float("inf")] * 16), (308, rows[3][1][:8])]
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, weight long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark, df).collect()}
    assert got == brute_links(rows)
    assert embedding_dedup.near_duplicates(spark, df.limit(0)).count() == 0


def test_embedding_rows_without_id(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in embedding_dedup.near_duplicates(spark, df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 105), (105, 90), (7, 7)]
    got = dict(tuple(r) for r in common.connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 90, 105: 90, 90: 90}
    assert common.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2 --------------------------------------------------------------------------------------


def fluid(blocks, weights):
    """What each source has at each slot when all that have blocks left run in the ratio of their weights."""
    got, left = dict.fromkeys(blocks, Fraction(0)), {s for s, n in blocks.items() if n}
    shares = {s: Fraction(w) for s, w in weights.items()}
    for _ in range(sum(blocks.values())):
        rest = Fraction(1)
        while rest and left:
            whole = sum(shares[s] for s in left)
            step = min(rest, *((blocks[s] - got[s]) * whole / shares[s] for s in left))
            for s in left:
                got[s] += step * shares[s] / whole
            rest -= step
            left = {s for s in left if got[s] < blocks[s]}
        yield dict(got)


def deviation(blocks, weights):
    seen, most = dict.fromkeys(blocks, 0), Fraction(0)
    order = mixing.pfair(blocks, weights)
    for s, ideal in zip(order, fluid(blocks, weights)):
        seen[s] += 1
        most = max(most, *(abs(seen[x] - ideal[x]) for x in blocks))
    assert seen == blocks
    return most


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.integers(0, 40), st.floats(0.01, 10)), min_size=1))
def test_pfair_stays_within_a_block_of_the_fluid_mix(sources):
    blocks = {s: n for s, (n, _) in sources.items()}
    assert deviation(blocks, {s: w for s, (_, w) in sources.items()}) < 1


@pytest.mark.parametrize(
    "blocks",
    [{"a": 1000, "b": 1000} | {f"s{i}": 1 + i % 5 for i in range(100)}, {f"s{i:02}": 5 + 7 * i for i in range(30)}, {"a": 400, "b": 30, "c": 3}],
)
def test_pfair_after_sources_have_ended(blocks):
    assert deviation(blocks, dict.fromkeys(blocks, 1.0)) < 1
    assert deviation(blocks, {s: 0.3 + i % 7 for i, s in enumerate(blocks)}) < 1


def test_pfair_keeps_to_the_true_weights():
    weights = {"a": 0.7490, "b": 0.2003, "c": 0.05, "d": 0.0007}
    total, seen = sum(weights.values()), dict.fromkeys(weights, 0)
    for slot, s in enumerate(mixing.pfair({s: int(w * 20_000) for s, w in weights.items()}, weights)[:19_000]):
        seen[s] += 1
        assert all(abs(seen[s] - w / total * (slot + 1)) < 1 + 1e-6 for s, w in weights.items()), slot


def test_pfair_of_many_sources():
    start = time.process_time()
    order = mixing.pfair({f"s{i}": 1 + i % 20 for i in range(10_000)}, {f"s{i}": 1 + (i * 37 % 101) / 7 for i in range(10_000)})
    assert len(order) == sum(1 + i % 20 for i in range(10_000)) and time.process_time() - start < 30


def test_mixing(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 7)
    df = docs_of(spark, odd)
    rows = mixing.mix(spark, df, {"a": 3.0, "b": 1.0}, block_bytes=400).collect()
    assert len(rows) == len(odd)
    slots = {}
    for r in rows:
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert all(len(x) == 1 for x in slots.values())
    assert len({(r["slot"], r["seat"]) for r in rows}) == len(rows)
    whole = mixing.mixed(spark, df)
    assert whole.columns == df.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, df.collect()))
    assert mixing.mix(spark, empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(spark, df, {"a": 0.0})


def test_blocks_grow_with_the_documents(spark, monkeypatch):
    """The schedule has BLOCKS slots and one more for each source at most."""
    monkeypatch.setattr(mixing, "BLOCKS", 50)
    rows = [(i, "x" * 99, "en", "a" if i % 3 else "b") for i in range(3000)]
    got = mixing.mix(spark, docs_of(spark, rows), {"a": 1.0, "b": 1.0}, block_bytes=1).collect()
    assert len(got) == 3000 and len({r["slot"] for r in got}) <= 52
    order = sorted(got, key=lambda r: (r["slot"], r["seat"]))
    first = [r["source"] for r in order[:1800]]
    assert abs(first.count("a") - first.count("b")) <= 3 * 3000 // 50  # within a block of the equal weights, until b ends


# --- 3 --------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 60_000
    pages = [(1, "http://a/x y", "same"), (2, None, "same"), (3, "http://c", None), (4, "u", ""), (5, "u\r\nX: y", big), (None, "n", "same"), (6, "v", "WARC/1.1\r\n\r\n"), (7, "w", "once")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(spark, df, folder)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    rows = warc.read_archives(spark, manifest, folder).collect()
    text = {}
    for r in sorted(rows, key=lambda r: r["chunk_no"]):
        assert len(r["chunk"]) <= warc.CHUNK
        text.setdefault((r["page_id"], r["record_id"]), bytearray()).extend(r["chunk"])
    last = {r["page_id"]: r for r in rows if r["last"]}
    want = {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None), 7: ("response", None)}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in last.items()} == want
    import base64
    import hashlib

    for page, _, html in pages:
        raw = (html or "").encode()
        assert last[page]["payload_bytes"] == len(raw)
        assert last[page]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert bytes(text[(5, last[5]["record_id"])]) == big.encode()
    assert len([r for r in rows if r["page_id"] == 5]) == -(-len(big.encode()) // warc.CHUNK)
    none = warc.write_archives(spark, df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, none, f"file://{tmp_path}/e").count() == 0


def test_warc_least_bytes_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long long"), (4, "d", "long long")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(spark, df, folder, least_bytes=5)
    types = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, manifest, folder).collect()}
    assert types == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    name = manifest.first()["archive"]
    raw = (tmp_path / "w" / name).read_bytes()
    with pytest.raises((EOFError, ValueError)):
        list(warc.read_archive(io.BytesIO(raw[: len(raw) - 12])))


# --- 4 --------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_binary_fuse_has_no_false_negative(keys):
    fuse = exact_dedup.BinaryFuse.load(exact_dedup.BinaryFuse.build(np.array(sorted(keys), "u8")).dump())
    assert all(k in fuse for k in keys)


def test_binary_fuse_rate_and_size():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64 - 1, 50_000, dtype="u8")
    fuse = exact_dedup.BinaryFuse.build(keys)
    assert fuse.has(keys).all()
    assert fuse.has(rng.integers(0, 2**64 - 1, 200_000, dtype="u8")).mean() < 2e-4
    assert len(fuse.dump()) < 50_000 * 2 * 1.4


@pytest.mark.parametrize("bucket", [100_000, 10])
def test_exact_groups(spark, odd, monkeypatch, bucket):
    monkeypatch.setattr(exact_dedup, "BUCKET", bucket)
    import hashlib
    import re

    got = exact_dedup.exact_groups(spark, docs_of(spark, odd)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t, *_ in odd:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, *_ in odd:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert exact_dedup.exact_groups(spark, empty(spark)).count() == 0


def test_drop_copies(spark, odd):
    df = docs_of(spark, odd)
    kept = exact_dedup.drop_copies(spark, df)
    assert kept.columns == df.columns
    assert kept.where("doc_id between 200 and 210").count() == 1
    assert kept.where("doc_id is null").count() == 2


# --- 5 --------------------------------------------------------------------------------------


def test_word_hashes_part_at_separators():
    texts = ["the cat", "cat  the", "", " x", "thecat"]
    doc, bucket = quality.features([t.encode() for t in texts])
    of = [sorted(bucket[doc == i].tolist()) for i in range(5)]
    assert len(of[0]) == 3 and len(of[1]) == 3 and len(of[2]) == 0 and len(of[3]) == 1 and len(of[4]) == 1
    assert set(of[0]) & set(of[1]) and of[0] != of[1]
    raw = np.frombuffer("a bc  a".encode(), "u1")
    h, at = words.word_hashes(raw, words.WHITE_SPACE)
    assert at.tolist() == [0, 2, 6] and h[0] == h[2] != h[1]


def test_quality(spark):
    rng = random.Random(2)
    good, bad = [f"w{i}" for i in range(200)], [f"#{i}!" for i in range(200)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(30)), "en", "a") for i in range(200)] + [(900, None, None, None), (901, "", "en", "a"), (None, "w1 w2", "en", "a")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 200, 2)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.resample(spark, docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["log_weight"] == by[901]["log_weight"] == 0
    wrong = sum(by[i]["kept"] != (i % 5 != 0) for i in range(200))
    assert wrong <= 12
    # the same weights by plain loops
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    wanted = {i for i in range(0, 200, 2) if i % 5} | {4}
    each = {}
    for i, t, *_ in rows:
        _, b = quality.features([(t or "").encode()])
        each[i] = b
        np.add.at(raw, b, 1)
        if i in wanted:
            np.add.at(target, b, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert all(abs(by[i]["log_weight"] - ratio[each[i]].sum()) < 1e-6 for i in by)
    assert sum(r["kept"] for r in quality.resample(spark, docs_of(spark, rows), labels, 0.5).collect()) == round(0.5 * len(rows))
    assert quality.resample(spark, empty(spark), labels).count() == 0
    assert {r["log_weight"] for r in quality.resample(spark, docs_of(spark, rows[:5]), labels.limit(0)).collect()} == {0.0}


def test_kth_largest(spark):
    rng = random.Random(7)
    values = [rng.randint(-(2**60), 2**60) for _ in range(300)] + [5, 5, 5, -1, 0]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 7, 150, len(values)):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


# --- 6 --------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 50, 64]))
def test_assign(lengths, capacity):
    sequences = packing.assign(lengths, capacity)
    seen = [[] for _ in lengths]
    for s in sequences:
        assert s and sum(n for _, _, n in s) <= capacity
        for doc, start, n in s:
            assert n > 0
            seen[doc] += range(start, start + n)
    assert [sorted(x) for x in seen] == [list(range(n)) for n in lengths]
    assert len(sequences) == sum(n // capacity for n in lengths) + -(-sum(n % capacity for n in lengths) // capacity)


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    rows = [*odd, (400, "x<|endoftext|>y", "en", "a"), (401, "<|endoftext|>", "en", "a")]
    got = packing.pack(spark, docs_of(spark, rows)).collect()
    lib = Tokenizer.from_file(token_counts.tokenizer_path(packing.TOKENIZER))
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    pieces = {}
    for r in got:
        assert any(r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in pieces.values():
        p.sort()
        assert [o for o, _ in p] == [0, *itertools.accumulate(n for _, n in p)][:-1] and sum(n for _, n in p) <= 2048
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    assert packing.pack(spark, empty(spark)).count() == 0
    assert [packing.padded(n) for n in (1, 3, 512, 2047, 2048)] == [1, 2048, 512, 2048, 2048]


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 300_000, "\n" * 1_000_000, " a" * 50_000 + " " * 20_000 + "b <|endoftext|>", "x" + "\u3000 " * 20_000 + "y"])
def test_long_runs_equal_the_library(text):
    import tokenizers

    path = token_counts.tokenizer_path(packing.TOKENIZER)
    assert packing.encoder(path)(text) == tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_pieces_go_to_the_cheapest_sequence_with_room(lengths):
    """Against a plain greedy: descending pieces, least cost among the sequences with room."""
    capacity = 64
    rest = sorted(((n % capacity, doc) for doc, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    k = -(-sum(n for n, _ in rest) // capacity)
    bins = [[0, 0.0, []] for _ in range(k)]
    for n, doc in rest:
        open_ = [b for b in bins if b[0] + n <= capacity]
        if open_:
            b = min(open_, key=lambda b: b[1])
            b[0] += n
            b[1] += n + n * n / 2048
            b[2].append(doc)
    got = packing.assign(lengths, capacity)
    whole = [[doc for doc, start, n in pieces if n == lengths[doc] % capacity and start == lengths[doc] - n] for pieces in got]
    for _, _, docs in bins:
        assert not docs or any(docs == w[: len(docs)] for w in whole)


# --- 7 --------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(0, 30), st.sampled_from([0, 2, 128]), st.sampled_from([0, 100]))
def test_banded_distance(a, b, most, scalar, bits):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(order_minhash, "SCALAR", scalar)
        m.setattr(order_minhash, "BITS", bits)
        d = levenshtein(a, b)
        assert order_minhash.distance(np.array(a, "u4"), np.array(b, "u4"), most) == (d if d <= most else None)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(1, 12), st.floats(0, 0.4), st.integers(0, 90))
def test_distances_of_many(seed, n, k, share, most):
    rng = random.Random(seed)
    a = [rng.randint(0, 40) for _ in range(n)]
    others = []
    for _ in range(k):
        b = []
        for w in a:
            x = rng.random()
            b += [] if x < share / 3 else [rng.randint(0, 40)] if x < share * 2 / 3 else [w, rng.randint(0, 40)] if x < share else [w]
        if abs(len(b) - n) <= most and b:
            others.append(np.array(b, "u4"))
    others.sort(key=len)
    if others:
        got = order_minhash.distances(np.array(a, "u4"), others, most)
        for b, d in zip(others, got):
            want = levenshtein(a, b.tolist())
            assert d == want if want <= most else d > most


def test_neighbours_over_batches():
    import pyarrow as pa

    rng = random.Random(9)
    rows = sorted((rng.randint(0, 40), rng.choice([5, 5, 5, 9]), i) for i in range(60))
    like = [i > 0 and rows[i - 1][0] == r[0] for i, r in enumerate(rows)] + [False]
    want = [(r[2], rows[i - 1][2] if like[i] and r[0] & 1 and rows[i - 1][1] == r[1] else None) for i, r in enumerate(rows) if like[i] or like[i + 1] or i in (0, 59)]
    for size in (1, 2, 3, 7, 60):
        batches = [pa.RecordBatch.from_pydict(dict(zip(("key", "size", "doc_id"), map(list, zip(*rows[i : i + size]))))) for i in range(0, 60, size)]
        got = [(r["doc_id"], r["before"]) for b in order_minhash._neighbours(0.8)(iter(batches)) for r in b.to_pylist()]
        assert got == want


def brute_classes(rows, similarity=0.8):
    seqs = {i: order_minhash.words_of(t).tolist() for i, t, *_ in rows if i is not None}
    raw = {i: t or "" for i, t, *_ in rows if i is not None}
    root = {i: i for i in seqs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(seqs, 2):
        n = max(len(seqs[a]), len(seqs[b]))
        near = raw[a] == raw[b] if not n else abs(len(seqs[a]) - len(seqs[b])) <= 0.2 * n and (seqs[a] == seqs[b] or n < 3000 and 1 - levenshtein(seqs[a], seqs[b]) / n >= similarity)
        if near:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in seqs}


@pytest.mark.parametrize("block, words, parts", [(8192, 4_000_000, 4), (3, 100, 4), (5, 4_000_000, 61)])
def test_order_minhash(spark, odd, monkeypatch, block, words, parts):
    """The same classes whatever the sizes of blocks and the number of partitions."""
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    monkeypatch.setattr(order_minhash, "BLOCK_WORDS", words)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = order_minhash.near_classes(spark, docs_of(spark, odd)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(odd)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == brute_classes(odd)
    assert all(r["kept"] and r["class_id"] is None for r in got if r["doc_id"] is None)


def test_texts_of_a_repeated_id(spark):
    """Both texts of doc_id 1 link it, whichever row comes first."""
    rng = random.Random(3)
    x, y = (" ".join(f"{rng.getrandbits(40):x}" for _ in range(60)) for _ in range(2))
    rows = [(1, x, "en", "a"), (1, y, "en", "a"), (2, x + " more", "en", "a"), (3, y + " more", "en", "a"), (4, y + " other", "en", "a"), (4, y + " other", "en", "a")]
    for order in (rows, rows[::-1]):
        got = order_minhash.near_classes(spark, docs_of(spark, order)).collect()
        assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1)]


def test_a_text_has_a_row_for_a_leader_not_for_each_key(spark, monkeypatch):
    """30 keys of one leader, of which each lacks another text, and one key of another leader."""
    texts = range(100, 140)
    keys = [(k, d, d, 60) for k in range(30) for d in texts if d != 100 + k] + [(99, d, d, 60) for d in (7, 110, 139)]
    placed = spark.createDataFrame([*keys, *((k, 5, 5, 60) for k in range(30))], "key long, component long, doc_id long, size int")
    buckets = spark.createDataFrame([*((k, 5, 40) for k in range(30)), (99, 7, 3)], "key long, leader long, n long")
    wanted = sorted([(d, 5) for d in (5, *texts)] + [(d, 7) for d in (7, 110, 139)])
    for most in (order_minhash.BROADCAST_ROWS, 0):
        monkeypatch.setattr(order_minhash, "BROADCAST_ROWS", most)
        got = sorted((r["doc_id"], r["leader"]) for r in order_minhash.leaders_of(spark, placed, buckets).collect())
        assert sorted(set(got)) == wanted
        assert len(got) < 80  # of 1203 texts and keys


def test_order_minhash_empty_and_drop(spark, odd):
    assert order_minhash.near_classes(spark, empty(spark)).count() == 0
    df = docs_of(spark, odd)
    kept = order_minhash.drop_near_copies(spark, df)
    assert kept.columns == df.columns and kept.where("doc_id between 100 and 250").count() == 1


def test_keys_keep_order(monkeypatch):
    w = order_minhash.words_of(" ".join(f"w{i}" for i in range(300)))
    keys = order_minhash.order_keys(w)
    assert len(set(keys.tolist())) == 128 and (keys & 1).sum() == 24
    turned = np.concatenate([w[150:], w[:150]])  # nearly the same k-mers: half of their pairs stand in another order
    assert 30 <= len(set(keys.tolist()) & set(order_minhash.order_keys(turned).tolist())) <= 90
    near = w.copy()
    near[40] = 5
    assert len(set(keys.tolist()) & set(order_minhash.order_keys(near).tolist())) >= 112
    g = order_minhash.labelled_kmers(order_minhash.words_of("a b c d e " * 3), 5)
    assert len(set(g.tolist())) == len(g)  # occurrences tell repeated k-mers apart
    monkeypatch.setattr(order_minhash, "CHUNK", 700)  # tables are hashed in runs
    assert (order_minhash.order_keys(w) == keys).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=40), min_size=2, max_size=12))
def test_no_bound_excludes_a_similar_pair(texts):
    seqs = sorted((np.array(t, "u4") for t in texts), key=len)
    size = np.array([len(x) for x in seqs], "i8")
    may = {(i, j) for i, others in order_minhash.may_be_similar(size, seqs, np.arange(len(seqs)), 0.8) for j in others.tolist()}
    for i, j in itertools.combinations(range(len(seqs)), 2):
        near = 1 - levenshtein(seqs[i].tolist(), seqs[j].tolist()) / size[j] >= 0.8 - 1e-12
        assert order_minhash.similar(seqs[i], seqs[j]) == near
        assert not near or (i, j) in may


def test_near_copies_in_a_crowded_bucket(spark, monkeypatch):
    """Thousands of texts share a passage, and what a copy has in common with its text is that passage alone."""
    monkeypatch.setattr(order_minhash, "BLOCK", 300, raising=False)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = [word() for _ in range(66)]
    base = [[*passage, *(word() for _ in range(34))] for _ in range(2000)]
    copies = [[word() if i >= 66 and (i - 66) % 4 == 0 else w for i, w in enumerate(t)] for t in base[:60]]
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(base)] + [(5000 + i, " ".join(t), "en", "a") for i, t in enumerate(copies)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(spark, docs_of(spark, rows)).collect()}
    assert all(got[i] == i for i in range(2000))
    assert all(got[5000 + i] in (i, 5000 + i) for i in range(60))
    found = sum(got[5000 + i] == i for i in range(60))
    assert found >= 54, found


def test_stated_miss():
    sizes = [*range(5, 200), 500, 1000, 5000, 20_000]
    assert max(order_minhash.missed(n) for n in sizes) < 1e-3
    assert max(order_minhash.missed(n, spread=True) for n in sizes) < 0.02


def test_recall_by_similarity(spark):
    """Pairs with words replaced, put in or taken out at random, told by their true similarity."""
    rng = random.Random(21)
    word = lambda: f"{rng.getrandbits(30):x}"
    rows, similarity = [], {}
    for n in range(400):
        text = [word() for _ in range(rng.choice([12, 30, 50, 60, 90, 150, 400]))]
        edited, share = list(text), rng.uniform(0.01, 0.2)
        for _ in range(max(1, int(share * len(text)))):
            at, how = rng.randrange(len(edited)), rng.random()
            edited[at : at + 1] = [word()] if how < 0.6 else [] if how < 0.8 else [edited[at], word()]
        similarity[n] = 1 - levenshtein(text, edited) / max(len(text), len(edited))
        rows += [(n, " ".join(text), "en", "a"), (10_000 + n, " ".join(edited), "en", "a")]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(spark, docs_of(spark, rows)).collect()}
    for low in (0.8, 0.85, 0.9, 0.95):
        of = [n for n, x in similarity.items() if low <= x < low + 0.05 + 1e-9]
        assert len(of) > 30 and sum(got[10_000 + n] == n for n in of) >= 0.97 * len(of), low
    assert all(got[10_000 + n] == 10_000 + n for n, x in similarity.items() if x < 0.8)


def test_near_copies_at_the_threshold(spark):
    """One word in five replaced, evenly spread: what 5-word k-mers share least."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, n = [], 0
    for size in [5, 6, 7, 8, 9, 10, 12, 14, 20, 24, 25, 29, 30, 40, 60, 100, 300]:
        for _ in range(6):
            text = [word() for _ in range(size)]
            edited = [word() if i % 5 == 2 and i // 5 < size // 5 else w for i, w in enumerate(text)]
            rows += [(n, " ".join(text), "en", "a"), (10_000 + n, " ".join(edited), "en", "a")]
            n += 1
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(spark, docs_of(spark, rows)).collect()}
    assert sum(got[10_000 + i] != i for i in range(n)) <= 1


# --- 8 --------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(5)
    parts = {"xx": ["tion", "ing", "the", "er", "and"], "yy": ["keit", "ung", "sch", "ein", "ge"], "zz": ["eux", "que", "oi", "ment", "é"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(12, 80))), lang, "s") for i in range(240) for lang in [rng.choice(list(parts))]]
    truth = {r[0]: r[2] for r in rows}
    rows += [(900, None, "xx", "s"), (901, "", None, None), (902, "12 !?", "xx", "s"), (None, "tion ing the and er", None, "s"), (903, LONG, None, "s")]
    got = language_id.identify(spark, docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    test = [i for i in truth if by[i]["held_out"]]
    assert np.mean([by[i]["lang_pred"] == truth[i] for i in test]) >= 0.97
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[None]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(spark, empty(spark)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(spark, docs_of(spark, [(0, "abc", None, "s")])).collect()} == {"und"}


def test_numerals_are_no_letters():
    content = (("en", b"the quick brown fox jumps over the lazy dog"), ("fr", b"le renard brun saute par dessus le chien"))
    for text in ("½ ² ½", "Ⅷ 12", "\u0301\u0308", "", None, "!? 3"):
        assert language_id.classify(text, content) == ("und", 0.0, False)
    assert language_id.classify("the dog", content)[0] == "en"


def test_language_is_the_smallest_compressed_size():
    import zstandard

    content = (("aa", b"alpha beta gamma delta epsilon zeta " * 20), ("bb", b"uno dos tres cuatro cinco seis siete " * 20))
    rng = random.Random(8)
    for _ in range(20):
        text = " ".join(rng.choice("alpha beta gamma uno dos tres Cuatro".split()) for _ in range(rng.randint(1, 300)))
        raw, sizes = text.lower().encode(), {}
        for lang, words in content:
            d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(raw[i : i + language_id.BLOCK])) for i in range(0, len(raw), language_id.BLOCK))
        lang, score, _ = language_id.classify(text, content)
        assert sizes[lang] == min(sizes.values()) and abs(score - (1 - min(sizes.values()) / max(sizes.values()))) < 1e-9


def test_language_of_repeated_rows(spark):
    """Repeated ids don't shrink the sample: each language is learned."""
    rows = [(i % 10, "tion ing the and er " + "ing " * (i % 10), "xx", "s") for i in range(2000)] + [(100 + i % 10, "keit ung sch ein ge " + "ung " * (i % 10), "yy", "s") for i in range(2000)]
    got = language_id.identify(spark, docs_of(spark, rows)).groupBy("doc_id").agg(F.min("lang_pred").alias("a"), F.max("lang_pred").alias("b")).collect()
    assert all(r["a"] == r["b"] == ("xx" if r["doc_id"] < 100 else "yy") for r in got)


# --- 9 --------------------------------------------------------------------------------------


def test_grammar_states():
    g = toxicity.Grammar({"idio": 2.0}, [0.0] * 13)
    assert g.features("you idiot. fine").tolist() == [2, 2, 0, 0, 0, 0]
    assert g.features("not an idiot! IDIOTS").tolist() == [2, 0, 2, 0, 0, 0]
    assert g.features("he said you are an idiot").tolist() == [0, 2, 0, 2, 0, 0]
    assert g.features("I kill you\nkill time").tolist() == [0, 0, 0, 0, 2, 1]
    assert g.features("grandidiot").tolist() == [0] * 6
    assert g.features(None).tolist() == [0] * 6


def test_grammar_reads_contractions_inflections_and_both_sides():
    g = toxicity.Grammar({"idio": 2.0}, [0.0] * 13)
    assert g.features("you aren't an idiot").tolist() == [0, 2, 2, 0, 0, 0]
    assert g.features("an idiot you are not").tolist() == [0, 2, 2, 0, 0, 0]
    assert g.features("killing you").tolist() == [0, 0, 0, 0, 1, 1]
    assert g.features("l'idiot, qu'il dit").tolist() == [0, 2, 0, 2, 0, 0]
    assert g.features('an "idiot" he wrote').tolist() == [0, 2, 0, 2, 0, 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["you", "not", "said", "idiots", "kill", "killer", "yours", "word", "idio", "snar", '"', "no", "nothing"]), max_size=8))
def test_one_path_of_the_composed_transducer_is_accepted(clause):
    machine = toxicity.compose({"idio": 2.0, "snar": 0.5})
    symbol = {"you": "T", "yours": "T", "not": "N", "no": "N", "said": "S", '"': "S", "kill": "M", "killer": "M", "idiots": "I", "idio": "I", "snar": "I"}
    read = [symbol.get(w, "O") for w in clause]
    # all paths: each assumption about target, negation and speech, kept if it comes true
    paths = []
    for assumed in itertools.product([False, True], repeat=3):
        if assumed == tuple(k in read for k in "TNS"):
            told = np.zeros(6)
            for w, k in zip(clause, read):
                weight = 0.5 if w == "snar" else 2.0
                if k == "I":
                    told[3 if assumed[2] else 2 if assumed[1] else 0] += weight
                    told[1] += weight * assumed[0]
                elif k == "M":
                    told[4] += 1
                    told[5] += assumed[0]
            paths.append(told)
    got = machine.run(clause)
    assert len(got) == len(paths) == 1
    features = np.zeros(6)
    for f, weight in next(iter(got.values())):
        features[f] += weight
    assert features.tolist() == paths[0].tolist()


def test_toxicity_with_repeated_rows(spark):
    """The sample has a row for each labelled document, however often its row is repeated."""
    rows = [(i % 40, ("grumbolt " if i % 40 % 4 == 0 else "") + f"word{i % 40} calm here", "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)] * 3, "doc_id long, quality int, toxic int")
    got = toxicity.score(spark, docs_of(spark, rows), labels).collect()
    assert len(got) == 400 and len({(r["doc_id"], r["score"]) for r in got}) == 40


def test_stems_are_chosen_by_what_they_tell():
    counts = [("lose", 60, 9), ("loser", 55, 0), ("losers", 20, 0), ("lowe", 80, 0), ("lowei", 40, 0), ("rare", 3, 0), ("word", 90, 900)]
    assert set(toxicity.choose_stems(counts, 200, 2000)) == {"loser", "lowe"}


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 6 == 0
        text = [f"word{rng.randint(0, 300)}" for _ in range(40)]
        if toxic:
            text[rng.randint(0, 39)] = rng.choice(["grumbolt", "grumbolts", "vexling"])
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None, None), (901, "", "en", "s"), (902, "Grumbolted " + LONG[:500], "en", "s"), (903, "grumbolt vexling. " * 400 + LONG, "en", "s"), (None, "vexling", "en", "s")]
    labels = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, rows)
    by = {r["doc_id"]: r for r in toxicity.score(spark, df, labels).collect()}
    assert len(by) == len(rows)
    held = [i for i in range(400) if by[i]["held_out"]]
    assert held and all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert all(by[i]["predicted"] == int(i % 6 == 0) for i in held)
    assert by[900]["score"] == by[901]["score"] < 0.5 and by[902]["predicted"] == by[903]["predicted"] == by[None]["predicted"] == 1
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) for r in by.values())
    assert toxicity.score(spark, empty(spark), labels).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score(spark, df, labels.limit(0)).collect())
    kept = toxicity.drop_toxic(spark, df, labels)
    assert kept.columns == df.columns and kept.where("doc_id % 6 = 0 and doc_id < 400").count() == 0 and kept.where("doc_id is null").count() == 1


# --- 10 -------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_equal_the_library(text):
    assert token_counts.counter(token_counts.tokenizer_path(token_counts.TOKENIZER)).count(text) == len(_library().encode(text, add_special_tokens=False).ids)


def _library(cache=[]):
    from tokenizers import Tokenizer

    if not cache:
        cache.append(Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER)))
    return cache[0]


def test_token_counts(spark, odd):
    rows = [*odd, (400, "ΣΑΣ İ ² ½ Ⅷ it's", "en", "a"), (401, "a<|endoftext|>b<|startoftext|>", "en", "a"), (402, "x" * 5000, "en", "a"), (403, "\x1c\x85  é", "en", "a")]
    got = token_counts.token_counts(spark, docs_of(spark, rows)).collect()
    want = [(i, len((t or "").encode()), n := len(_library().encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert token_counts.token_counts(spark, empty(spark)).count() == 0


def test_each_character_counts_as_in_the_library():
    """Alone, in a word and doubled; also the characters that Python's tables don't know yet."""
    words = token_counts.counter(token_counts.tokenizer_path(token_counts.TOKENIZER))
    wrong = []
    for start in range(0x80, sys.maxunicode + 1, 20_000):
        some = [chr(c) for c in range(start, min(start + 20_000, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000]
        texts = [f"a{c}b {c}{c} 1{c}" for c in some]
        for c, t, e in zip(some, texts, _library().encode_batch(texts, add_special_tokens=False)):
            if words.count(t) != len(e.ids):
                wrong.append(f"{ord(c):x} {unicodedata.category(c)}")
    assert not wrong, wrong[:20]


def test_many_long_runs_are_linear():
    path = token_counts.tokenizer_path(packing.TOKENIZER)
    start = time.process_time()
    for text in (("x" + " " * 9999) * 50, ("y" + "\n " * 5000) * 20):
        packing.encoder(path)(text)
    assert time.process_time() - start < 5
