"""Recommendations: profiles, co-occurrence, scores and caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.text import genre_tags, language_boost
from .joins import NO_AUTHOR
from .ranking import cap_by

#: Trust in a source, and in one that isn't listed.
BASELINE, OTHER = {"Google Books": 0.60, "豆瓣": 0.55, "Open Library": 0.50, "Pixiv": 0.55, "起点": 0.55, "晋江": 0.55, "菠萝包": 0.55}, 0.25
#: Weights of tags, author, title, description and contents.
SIGNALS = (0.35, 0.20, 0.10, 0.20, 0.15)


def keyword_profile(keywords: DataFrame, books: DataFrame, preferred: Sequence[str], most: int = 15) -> DataFrame:
    """keyword, score: weights by reading time over books that were read, without preferred names."""
    read = books.where("reading_time > 0").select("book_id", "reading_time")
    rows = keywords.where(~F.col("keyword").isin(*preferred)).join(read, "book_id")
    return rows.groupBy("keyword").agg(F.sum(F.col("reading_time") * F.col("weight")).alias("score")).orderBy(F.desc(F.round("score", 6)), "keyword").limit(most)


def neighbours(keywords: DataFrame, seeds: DataFrame, least: float = 0.25, most: int = 5) -> DataFrame:
    """seeds(keyword) -> seed, keyword, jaccard: keywords whose sets of books are near a seed's.

    Seeds are few; only books of seeds are joined, and sizes are counts by
    keyword, so no pair of other keywords is made."""
    size = keywords.groupBy("keyword").agg(F.count("*").alias("size"))
    mine = keywords.join(seeds.select("keyword"), "keyword", "left_semi").select("book_id", F.col("keyword").alias("seed"))
    both = mine.join(keywords.select("book_id", "keyword"), "book_id").where("seed <> keyword").groupBy("seed", "keyword").agg(F.count("*").alias("both"))
    named = both.join(size, "keyword").join(size.select(F.col("keyword").alias("seed"), F.col("size").alias("seed_size")), "seed").where("seed_size > 1")
    j = F.col("both") / (F.col("size") + F.col("seed_size") - F.col("both"))
    return cap_by(named.withColumn("jaccard", j).where(F.col("jaccard") >= least), ["seed"], [F.desc("jaccard"), "keyword"], most).select("seed", "keyword", "jaccard")


def expand(keywords: DataFrame, seeds: DataFrame, fraction: float = 0.5, decay: float = 0.4) -> DataFrame:
    """seeds(keyword, weight) with the neighbours of strong ones; seeds are never replaced, and a neighbour of several gets its best weight."""
    strongest = seeds.agg(F.max("weight").alias("_max"))
    strong = seeds.crossJoin(F.broadcast(strongest)).where((F.col("_max") > 0) & (F.col("weight") >= F.col("_max") * fraction))  # one row
    # one pass over the keywords, not one for strong seeds and one for the others
    weak = seeds.select("keyword").join(strong.select("keyword"), "keyword", "left_anti")
    near = neighbours(keywords.join(weak, "keyword", "left_anti"), strong)
    near = near.join(seeds.select("keyword"), "keyword", "left_anti")
    new = near.join(strong.select(F.col("keyword").alias("seed"), "weight"), "seed").groupBy("keyword").agg(F.max(F.col("weight") * F.col("jaccard") * decay).alias("weight"))
    return seeds.select("keyword", "weight").unionByName(new)


def local_scores(keywords: DataFrame, pool: DataFrame, books: DataFrame, authors: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """book_id, score: overlap with the pool(keyword, pool) by ln(1 + df), more for top authors, less for seeds."""
    df = keywords.groupBy("keyword").agg(F.count("*").alias("df"))
    hits = keywords.join(pool, "keyword").join(df, "keyword").groupBy("book_id").agg(F.sum(F.col("pool") * F.col("weight") * s.collection_weight(F.col("df"))).alias("score"))
    rows = hits.join(books.select("book_id", "author"), "book_id")
    score = (F.col("score") + F.when(F.col("author").isin(*authors), 0.6).otherwise(0.0)) * F.when(F.col("book_id").isin(*seeds), 0.2).otherwise(1.0)
    return rows.select("book_id", score.alias("score"))


def baseline(source: Column) -> Column:
    out = F.when(F.lit(False), OTHER)
    for k, v in BASELINE.items():
        out = out.when(source == k, v)
    return out.otherwise(OTHER)


def quality(source: Column, rating: Column, popularity: Column, description: Column) -> Column:
    """0 to 1: the source's trust, its rating as far as it can be believed, and a description."""
    r = F.when(rating.try_cast("double") > 0, rating.try_cast("double"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log10(s.count_of(popularity) + 1) / F.log10(F.lit(50.0))))
    more = F.when(source == "Google Books", r / 5 * sure * 0.35).when(source == "豆瓣", r / 10 * 0.35)
    told = F.when(F.trim(F.coalesce(description, F.lit(""))) != "", 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), baseline(source) + F.coalesce(more, F.lit(0.0)) + told))


def passes_gate(source: Column, popularity: Column) -> Column:
    return (source != "Pixiv") | (popularity >= F.log10(F.lit(101.0)))


def same_author(a: Column, b: Column) -> Column:
    x, y = F.trim(a), F.trim(b)
    return (x != "") & (x != NO_AUTHOR[0]) & (F.lower(x) == F.lower(y))


def weighted_overlap(seed: Column, other: Column) -> Column:
    """Of two maps from word to weight: the sum of products over the seed's sum, within 0 and 1."""
    total = F.aggregate(F.map_values(seed), F.lit(0.0), lambda a, b: a + b)
    hit = F.aggregate(F.map_keys(seed), F.lit(0.0), lambda a, k: a + F.element_at(seed, k) * F.coalesce(F.try_element_at(other, k), F.lit(0.0)))
    return F.when(F.size(seed) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), hit / F.greatest(total, F.lit(1e-9)))))


def blend(tags: Column, author: Column, title: Column, description: Column, contents: Column) -> Column:
    return sum((w * x for w, x in zip(SIGNALS, (tags, author, title, description, contents))), F.lit(0.0))


def relevance(seed: dict[str, Column], other: dict[str, Column]) -> Column:
    """Columns tags, title, description (arrays), author, contents (map) on both sides."""
    same = F.when(same_author(seed["author"], other["author"]), 1.0).otherwise(0.0)
    j = lambda k: s.jaccard(seed[k], other[k])
    return blend(j("tags"), same, j("title"), j("description"), weighted_overlap(seed["contents"], other["contents"]))


def genre_hit(text: Column, name: Column, english: Column) -> Column:
    """Whether a text holds a genre's name, or one of its English tags whatever the case."""
    return text.contains(name) | F.exists(genre_tags(F.coalesce(english, F.lit(""))), lambda g: F.lower(text).contains(F.lower(g)))


def keyword_hits(words: Column, english: Column, text: Column) -> Column:
    """The part of words (an array) that a text holds; english maps a word to its tags."""
    hit = F.size(F.filter(words, lambda k: genre_hit(text, k, F.try_element_at(english, k))))
    return F.when((F.size(words) == 0) | (F.trim(text) == ""), 0.0).otherwise(hit / F.size(words))


def candidate_score(text: Column, tags: Column, popularity: Column, preferred: Sequence[tuple[str, float, str]], learned: Sequence[tuple[str, float]], wanted: str | None) -> tuple[Column, Column]:
    """(score, reason) of a candidate: language, preferred genres, learned keywords, the genre searched for, popularity."""
    whole = F.concat(text, F.array_join(tags, " "))
    largest = max((w for _, w in learned), default=1.0)
    parts = [(n, float(w), F.lit(e)) for n, w, e in preferred] + [(n, w / largest * 0.5, F.lit("")) for n, w in learned]
    hits = [(F.when(genre_hit(whole, F.lit(n), e), F.lit(w)).otherwise(F.lit(0.0)), n, w) for n, w, e in parts]
    score = sum((c for c, _, _ in hits), language_boost(text)) + popularity * 0.15
    best, reason = F.lit(0.0), F.lit(None).cast("string")
    for c, n, _ in hits:
        reason = F.when(c > best, F.lit(n)).otherwise(reason)
        best = F.greatest(best, c)
    if wanted:
        found = genre_hit(whole, F.lit(wanted), F.lit(""))
        score = score + F.when(found, 1.0).otherwise(0.0)
        reason = F.when(found, F.lit(wanted)).otherwise(reason)
    return score, reason


def merge_sources(parts: Sequence[DataFrame], bonuses: Sequence[float], caps: dict[str, int], most: int = 30) -> DataFrame:
    """Candidates(title, author, source, score) of several searches: a bonus by search, one row per title and author, caps by source."""
    rows = None
    for i, (p, b) in enumerate(zip(parts, bonuses)):
        one = p.withColumn("score", F.col("score") + b).withColumn("_search", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    key = F.concat_ws("|", F.lower("title"), F.lower("author"))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_search", F.desc("score"), "source"))).where("_n = 1").drop("_n", "_search")
    cap = F.when(F.lit(False), 0)  # without a cap: null
    for k, v in caps.items():
        cap = cap.when(F.col("source") == k, v)
    return cap_by(once, ["source"], [F.desc("score"), "title", "author"], cap).orderBy(F.desc("score"), "title", "author").limit(most)
