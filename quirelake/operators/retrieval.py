"""Passages: chunks, postings, BM25, vectors, fusion and context assembly.

The chunk size and overlap, the BM25 constants and the fusion rule are this
engine's own choices: Okapi BM25 with k1 = 1.2 and b = 0.75, and reciprocal
rank fusion with k = 60."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as w
from .nearest import best_of, rounded
from .ranking import cap_by

K1, B, FUSION = 1.2, 0.75, 60
#: Terms of queries up to which they are broadcast.
TERMS = 200_000
#: Characters of a prompt's context, of history, of a book's preview head and tail.
CONTEXT, HISTORY, HEAD, TAIL = 55_000, 8_000, 2_000, 1_500
#: Questions about when something began.
TEMPORAL = "怎么?认识|如何?相识|初次?见|第一?次|何时|什么时候|怎么开始|起源|来历|如何?相遇|如何?认识|早期|最初|一开始|起[因源]|结识|初遇"


def chunk(texts: DataFrame, size: int, overlap: int, per_chapter: int = 5) -> DataFrame:
    """texts(book_id, text) -> book_id, chunk_index, chapter, content, char_offset; a short or empty text is one chunk."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / float(step))).cast("long")
    rows = texts.select("book_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_index"))
    chapter = F.concat(F.lit("part "), F.call_function("div", F.col("chunk_index"), F.lit(per_chapter).cast("long")).cast("string"))
    return rows.select("book_id", "chunk_index", chapter.alias("chapter"), F.substring(F.col("text"), (F.col("chunk_index") * step + 1).cast("int"), F.lit(size)).alias("content"), (F.col("chunk_index") * step).alias("char_offset"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; Chinese as single characters and pairs.

    ASCII texts, which have no Chinese, are split once instead of searched three times."""
    ascii_words = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+"), F.lit(0))
    single = F.regexp_extract_all(text, F.lit(r"[\x{4E00}-\x{9FFF}]"), F.lit(0))
    pairs = F.regexp_extract_all(text, F.lit(r"(?=([\x{4E00}-\x{9FFF}]{2}))"), F.lit(1))
    return F.when(F.octet_length(text) == F.length(text), ascii_words).otherwise(F.concat(words, single, pairs))


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """docs(id, text), queries(query_id, text) -> query_id, id, score: the k best of each query.

    Only tokens that a query holds are kept before the counts are shuffled.
    Queries' terms meet their document frequencies first; these few rows are
    broadcast, so that a term which most documents hold is no key of a join."""
    # the outer form of explode, as the plain one has Spark split each text again in a filter for texts without tokens; joins drop the nulls
    terms = queries.select("query_id", F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term"))
    lengths = docs.select("id", tokens(F.col("text")).alias("_t")).select("id", "_t", F.size("_t").alias("_n"))
    corpus = lengths.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"))
    few = terms.limit(TERMS + 1).count() <= TERMS
    sent = F.broadcast if few else lambda df: df
    hits = lengths.select("id", "_n", F.explode_outer("_t").alias("term")).join(sent(terms.select("term").distinct()), "term", "left_semi").groupBy("id", "_n", "term").agg(F.count("*").alias("_tf"))
    # frequencies come from the same shuffle as the hits, as they read the same columns
    df = hits.groupBy("term").agg(F.sum(F.when(F.col("_tf") > 0, 1)).alias("_df"))
    rows = hits.join(sent(sent(terms).join(df, "term")), "term").crossJoin(F.broadcast(corpus))  # corpus: one row
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    tf = F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
    scored = rows.groupBy("query_id", "id").agg(F.sum(idf * tf).alias("score"))
    return cap_by(scored, ["query_id"], [F.desc(F.round("score", 9)), "id"], k)


class _Vectors:
    def __init__(self, table):
        column = table["v"].combine_chunks()
        self.v = pc.list_flatten(column).to_numpy().reshape(len(column), -1)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors(id, v), queries(query_id, q), of unit length -> the k nearest by cosine, exactly.

    Blocks of queries meet blocks of vectors as matrix products in double
    precision, and each task keeps k rows of each query (``best_of``). Vectors
    and queries that are no whole row of finite numbers of the usual length
    (null, with nulls, NaN) have scores by the same rule as before, which may
    be null and come last: only they meet the others pair by pair."""
    from ..functions.scalars import dot

    length = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    score = F.round(dot(F.col("v"), F.col("q")), 6).alias("score")
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    whole = lambda key, c: F.col(key).isNotNull() & F.coalesce((F.size(c) == length) & F.forall(c, finite), F.lit(False)) & F.lit(length > 0)
    fit = lambda df, key, c: df.where(whole(key, c)).select(F.col(key).cast("long").alias("id"), F.transform(c, lambda x: x.cast("double")).alias("v"))
    near = best_of(fit(queries, "query_id", "q"), fit(vectors, "id", "v"), k, _Vectors, lambda q, v: rounded(q.v @ v.v.T))
    odd, asked_odd = vectors.where(~whole("id", "v")), queries.where(~whole("query_id", "q"))
    rest = odd.crossJoin(queries.where(whole("query_id", "q"))).union(vectors.crossJoin(asked_odd)).select("query_id", "id", score)
    return cap_by(near.union(rest), ["query_id"], [F.desc("score"), "id"], k)


def fuse(rankings: Sequence[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of rankings(query_id, id, score)."""
    parts = [r.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("_n")) for r in rankings]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    scored = rows.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (FUSION + F.col("_n"))).alias("score"))
    return cap_by(scored, ["query_id"], [F.desc(F.round("score", 9)), "id"], k)


def prefer_earlier(score: Column, index: Column, last: Column) -> Column:
    return score * (1 + 0.2 * (1 - F.when(last > 0, index / last).otherwise(0.0)))


def dedup_by_chapter(chunks: DataFrame, order: Sequence, most: int = 3) -> DataFrame:
    """At most so many chunks of a chapter, in order; chunks without a chapter don't count together."""
    key = F.when(F.col("chapter") == "", F.concat(F.lit("#"), F.col("chunk_index").cast("string"))).otherwise(F.concat(F.lit("="), F.col("chapter")))
    return cap_by(chunks.withColumn("_key", key), ["book_id", "_key"], order, most).drop("_key")


def is_temporal(question: Column) -> Column:
    return question.rlike(TEMPORAL)


def rerank(candidates: DataFrame, ranks: DataFrame | None, k: int) -> DataFrame:
    """The k best by ranks given from outside (query_id, id, rank); without any, the first k by score."""
    if ranks is None:
        return cap_by(candidates, ["query_id"], [F.desc("score"), "id"], k)
    ranked = candidates.join(ranks, ["query_id", "id"], "left")
    return cap_by(ranked, ["query_id"], [F.asc_nulls_last("rank"), F.desc("score"), "id"], k).drop("rank")


def context(passages: DataFrame, budget: int = CONTEXT - HISTORY) -> DataFrame:
    """passages(query_id, position, label, content) -> one text per query, cut at the budget."""
    block = passages.withColumn("block", F.concat(F.lit("【"), F.col("label"), F.lit("】"), F.col("content")))
    kept = w.within_budget(block, ["query_id"], ["position"], "block", budget)
    parts = F.sort_array(F.collect_list(F.struct("position", "block")))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n").alias("context"), F.count("*").alias("passages"))


def preview(text: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """The head and tail of a text that is longer than both."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("\n…\n"), F.right(text, F.lit(tail))))


def route(chapters: Sequence[str], decomposed: bool) -> str:
    """Which plan answers a question: chosen chapters, a book's digest first, or full retrieval."""
    return "chapters" if chapters else "digest" if decomposed else "standard"


def summary_or_start(summary: Column, content: Column, n: int = 60) -> Column:
    return F.when(F.trim(F.coalesce(summary, F.lit(""))) == "", F.left(content, F.lit(n))).otherwise(summary)


def find_all(texts: DataFrame, needle: str) -> DataFrame:
    """texts(id, text) -> id, start, progression: every place of the needle, overlapping ones too, whatever its case."""
    import re

    quoted = "".join(re.escape(c) for c in needle.lower())
    before = F.split(F.lower("text"), f"(?={quoted})")
    sized = texts.select("id", F.length("text").alias("_len"), F.transform(before, lambda p: F.length(p)).alias("_n"), F.lower("text").alias("_low"))
    starts = F.transform(F.sequence(F.lit(1), F.size("_n")), lambda i: F.aggregate(F.slice("_n", 1, i - 1), F.lit(0), lambda a, b: a + b))
    rows = sized.where(F.col("_low").contains(needle.lower())).select("id", "_len", "_low", F.explode(starts).alias("start"))
    hits = rows.where(F.substring(F.col("_low"), F.col("start") + 1, F.lit(len(needle))) == needle.lower())
    return hits.select("id", F.col("start").cast("long").alias("start"), (F.col("start") / F.col("_len")).alias("progression"))


def snippet(text: Column, start: Column, length: int, around: int = 25) -> Column:
    """...before「hit」after..., line breaks as spaces."""
    before = F.substring(text, F.greatest(F.lit(1), start + 1 - around).cast("int"), F.least(F.lit(around), start).cast("int"))
    hit = F.substring(text, (start + 1).cast("int"), F.lit(length))
    after = F.substring(text, (start + 1 + length).cast("int"), F.lit(around))
    return F.translate(F.concat(before, F.lit("「"), hit, F.lit("」"), after), "\n", " ")
