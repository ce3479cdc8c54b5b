"""Operator 12: document fingerprints from closed syncmers, in Spark's own functions.

A k-mer is K bytes of a text in UTF-8. It is a closed syncmer, and with its
place an anchor, if the least hash among its substrings of S bytes is that of
its first or of its last one. That depends on those K bytes alone: an edit
changes the anchors that it touches and no others. A text's first bytes, up to
K - 1 of them, and its last K are anchors as well, so that short texts have some too. The
fingerprint holds the KEPT anchors of least hash, each with its first place.

As anchors are free of context, a text's are the union of those of its parts
that overlap by K - 1 bytes. So long texts are hashed in parts of bounded
size, and the edited text hashes its new end only.

The plan has no Python. Texts are shuffled once; both joins read that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

#: Bytes of a k-mer and of the substrings in it, anchors in a fingerprint.
K, S, KEPT = 16, 8, 64
#: Starts of k-mers that are hashed at once.
PART = 1 << 15
#: Bits of an anchor's place, which stays at its largest value beyond 128 MiB; the other 36 bits are its hash.
PLACE_BITS = 27
#: Anchors match if they moved by the median shift, give or take so many bytes or a SHIFT-th of the text.
SLACK, SHIFT = 256, 4


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda evaluates what it refers to for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(F.least(place.cast("long"), F.lit((1 << PLACE_BITS) - 1)))


def _hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def _place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _least(anchors: Column) -> Column:
    """The KEPT anchors of least hash, each hash at its first place."""
    first = lambda z: F.filter(z, lambda x, i: (i == 0) | (_hash_of(x) != _hash_of(z[F.greatest(i - 1, F.lit(0))])))
    return _let(F.sort_array(anchors), lambda z: F.slice(first(z), 1, KEPT))


def anchors(raw: Column, base: Column) -> Column:
    """The KEPT least closed syncmers of the bytes raw, whose first byte stands at base."""
    within = lambda h, i: [h[i + d] for d in range(K - S + 1)]

    def of_part(part: Column, start: Column) -> Column:
        size = F.octet_length(part)
        hashes = F.transform(F.sequence(F.lit(0), size - S), lambda i: F.xxhash64(part.substr(i + 1, F.lit(S))))
        at_edge = lambda h: F.filter(F.sequence(F.lit(0), size - K), lambda i: F.least(h[i], h[i + (K - S)]) == F.least(*within(h, i)))
        return _let(hashes, lambda h: _least(F.transform(at_edge(h), lambda i: _packed(F.xxhash64(part.substr(i + 1, F.lit(K))), start + i))))

    parts = F.sequence(F.lit(0), F.floor((F.octet_length(raw) - K) / PART).cast("int"))
    each = F.transform(parts, lambda j: _let(raw.substr(j * PART + 1, F.lit(PART + K - 1)), lambda p: _let(base + j * PART, lambda at: of_part(p, at))))
    return F.when(F.octet_length(raw) >= K, _least(F.flatten(each))).otherwise(F.array().cast("array<long>"))


def edges(raw: Column) -> Column:
    """Anchors of the first 1 to K - 1 bytes and of the last K; their hashes are apart from those of k-mers."""
    size = F.octet_length(raw)
    starts = _let(raw.substr(F.lit(1), F.lit(K - 1)), lambda r: F.transform(F.sequence(F.lit(1), F.octet_length(r)), lambda i: _packed(F.xxhash64(F.lit(0), r.substr(F.lit(1), i)), F.lit(0))))
    at = F.greatest(size - K, F.lit(0))
    return F.when(size > 0, F.concat(starts, F.array(_packed(F.xxhash64(F.lit(1), raw.substr(at + 1, F.lit(K))), at)))).otherwise(F.array().cast("array<long>"))


def merged(*some: Column) -> Column:
    return _least(F.flatten(F.array(*some)))


def shown(found: Column) -> Column:
    """A fingerprint as text: nine hex digits of hash, a colon and the place of each anchor, by hash."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.lower(F.lpad(F.hex(_hash_of(x)), 9, "0")), F.lit(":"), _place_of(x).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Of the KEPT least hashes of both fingerprints, the share that both hold and that moved by about the same shift; 1 if both are empty."""
    hashes = lambda x: F.transform(x, _hash_of)
    far = F.greatest(*[F.coalesce(F.array_max(F.transform(x, _place_of)), F.lit(0)) for x in (a, b)])
    slack = F.greatest(F.lit(SLACK).cast("long"), F.floor(far / SHIFT))

    def matched(both: Column) -> Column:
        places = F.map_from_arrays(hashes(b), F.transform(b, _place_of))
        shifts = lambda m: F.transform(F.filter(a, lambda x: F.array_contains(both, _hash_of(x))), lambda x: F.element_at(m, _hash_of(x)) - _place_of(x))
        near = lambda d: _let(F.struct(d[F.floor(F.size(d) / 2).cast("int")].alias("mid"), slack.alias("slack")), lambda at: F.size(F.filter(d, lambda v: F.abs(v - at["mid"]) <= at["slack"])))
        return F.when(F.size(both) == 0, F.lit(0)).otherwise(_let(places, lambda m: _let(F.sort_array(shifts(m)), near)))

    def share(u: Column) -> Column:
        both = F.array_intersect(u, F.array_intersect(hashes(a), hashes(b)))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(_let(both, matched) / F.size(u))

    return _let(F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, KEPT), share)


def _order(spark: SparkSession, keys: DataFrame) -> DataFrame:
    """keys(doc_id, k1, k2, n_chars) -> distinct k1, k2, n_chars, copies, and n1, n2: the next key by doc_id, after the last the first.

    Keys are dealt by ranges; a window looks at one range, and the first key
    of the ranges after it comes from a table of one row for each range."""
    order = ("missing", "doc_id", "k1", "k2")
    one = keys.groupBy(F.col("doc_id").isNull().alias("missing"), "doc_id", "k1", "k2").agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(spark, one.repartitionByRange(n, *order).select("*", F.spark_partition_id().alias("part")), "order")
    firsts = dealt.groupBy("part").agg(F.min(F.struct(*order)).alias("first"))
    by_part = Window.orderBy("part")  # as many rows as ranges
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(by_part), F.first("first").over(whole)).alias("after"))
    inside = Window.partitionBy("part").orderBy(*order)
    following = F.coalesce(F.lead(F.struct(*order)).over(inside), F.col("after"))
    return dealt.join(F.broadcast(firsts), "part").withColumn("next", following).select("k1", "k2", "n_chars", "copies", F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2"))


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, next_id: a row for each row.

    The edited text is the text whose last floor(n_chars / 4) code points are
    replaced by as many first ones of the next document, or all it has. The
    next document is that of the next larger doc_id, and of the last the
    first; rows without a doc_id come last; rows that share a doc_id follow
    each other by a hash, and repeated rows count as one document and get the
    same result each. A null text is empty: it has no anchors, and its
    likeness is 1 to another empty text and 0 to any other. Very long texts
    are hashed whole, in parts. Other columns are ignored; an empty table
    gives an empty result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = [F.xxhash64(F.lit(i), "doc_id", "text").alias(f"k{i}") for i in (1, 2)]
    order = written(spark, _order(spark, rows.select("doc_id", *key, F.char_length("text").alias("n_chars"))), "next")

    n_new = F.floor(F.char_length("text") / 4).cast("int")
    raw, left = F.col("text").cast("binary"), F.col("text").substr(F.lit(1), F.char_length("text") - n_new).cast("binary")
    tail_at = lambda kept: F.greatest(F.octet_length(kept) - (K - 1), F.lit(0))
    tail = raw.substr(tail_at(left) + 1, F.octet_length(raw))
    hashed = rows.select(*key, "doc_id", "text", anchors(left, F.lit(0)).alias("stays"), anchors(tail, tail_at(left)).alias("goes"))
    one = hashed.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "stays", "goes")])

    asked = order.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("n1").alias("k1"), F.col("n2").alias("k2"), "n_chars", "copies")
    whole = merged("stays", "goes", edges(raw))
    given = one.join(asked, ["k1", "k2"]).select(
        F.col("o1").alias("k1"), F.col("o2").alias("k2"), "n_chars", "copies", F.col("doc_id").alias("next_id"), whole.alias("next_found"), F.col("text").substr(F.lit(1), F.floor(F.col("n_chars") / 4).cast("int")).alias("piece")
    )
    both = one.join(given, ["k1", "k2"])
    new_end = F.concat(left.substr(tail_at(left) + 1, F.octet_length(left)), F.col("piece").cast("binary"))
    edited = F.concat(left, F.col("piece").cast("binary"))
    found = both.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), whole.alias("found"), merged("stays", anchors(new_end, tail_at(left)), edges(edited)).alias("edited_found"), "next_found", "next_id", "copies"
    )
    result = found.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("found")).alias("fingerprint"), shown(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"), likeness(F.col("found"), F.col("next_found")).alias("near_next"), "next_id", "copies",
    )
    return result.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "_copy")


def op12_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, read(spark, sf_dir, "documents"))
