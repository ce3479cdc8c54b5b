"""Joins of the document library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that stand for an unknown author.
NO_AUTHOR = ("未知作者", "佚名", "Unknown", "anonymous")
#: States of a link between books.
AUTO, MANUAL, BLOCKED = 0, 1, 2


def related(relations: DataFrame, book_id: int) -> DataFrame:
    """Ids linked to a book from either side, but not blocked."""
    live = relations.where(F.col("status") != BLOCKED)
    there = live.where(F.col("book_id") == book_id).select(F.col("related_id").alias("id"))
    back = live.where(F.col("related_id") == book_id).select(F.col("book_id").alias("id"))
    return there.union(back).distinct()


def lookup_with_default(rows: DataFrame, names: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, default))


def spine(first: str, days: int, spark) -> DataFrame:
    """One row per day."""
    start = F.to_date(F.lit(first))
    return spark.range(1).select(F.explode(F.sequence(start, F.date_add(start, days - 1))).alias("day"))


def author_parts(author: Column) -> Column:
    """Names in an author field: parted by comma, ideographic comma, fullwidth comma, ampersand, slash, semicolon."""
    return F.filter(F.transform(F.split(author, "[,，、&/;]"), lambda x: F.trim(x)), lambda x: x != "")


def author_fields(books: DataFrame, least: int = 2) -> DataFrame:
    """Pairs (author, whole) of author fields where a part of the one occurs in the other.

    Parts are looked up among the substrings of author fields by equality
    rather than by a nested loop; each field is compared once, however many
    books have it."""
    fields = books.where(~F.col("author").isin(*NO_AUTHOR) & (F.trim("author") != "")).select("author").distinct()
    parts = fields.select("author", F.explode(author_parts(F.col("author"))).alias("part")).where((F.length("part") >= least) & ~F.col("part").isin(*NO_AUTHOR))
    lengths = F.sequence(F.lit(least), F.length("author"))
    sub = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length("author") - n + 1), lambda i: F.lower(F.substring(F.col("author"), i, n)))))
    pieces = fields.where(F.length("author") >= least).select(F.col("author").alias("whole"), F.explode(F.array_distinct(sub)).alias("piece"))
    return parts.join(pieces, F.lower("part") == F.col("piece")).select("author", "whole").distinct()


def author_links(books: DataFrame, least: int = 2) -> DataFrame:
    """Pairs (book_id < related_id) where a part of one's author occurs in the other's.

    All pairs of an author's books are links; where authors have many, use
    ``author_fields`` or one book of each author."""
    left = books.select(F.col("id").alias("a"), "author")
    right = books.select(F.col("id").alias("b"), F.col("author").alias("whole"))
    pairs = left.join(author_fields(books, least), "author").join(right, "whole").where("a <> b")
    return pairs.select(F.least("a", "b").alias("book_id"), F.greatest("a", "b").alias("related_id")).distinct()


def class_links(books: DataFrame, least: int = 2) -> DataFrame:
    """(author, other) of author fields that a part of one links with the other, both ways; a field is linked with itself."""
    found = author_fields(books, least).select("author", F.col("whole").alias("other"))
    return found.union(found.select("other", "author")).distinct()


def _author_counts(books: DataFrame) -> DataFrame:
    return books.groupBy("author").agg(F.count("*").alias("n"), F.min("id").alias("class_id"))


def link_classes(books: DataFrame, least: int = 2) -> DataFrame:
    """books(id, author) -> id, class_id (the least id of its author's books), n_links (other books linked with it).

    Books of one author field are alike in their links, so a row for each book
    and the links of the fields (``class_links``) say all links without their
    pairs; books without a known author have no row."""
    counts = _author_counts(books)
    linked = class_links(books, least).join(counts.select(F.col("author").alias("other"), "n"), "other").groupBy("author").agg((F.sum("n") - 1).alias("n_links"))
    per = counts.join(linked, "author").select("author", "class_id", "n_links")
    return books.select("id", "author").join(per, "author").select("id", "class_id", "n_links")


def sync_class_links(relations: DataFrame, books: DataFrame, least: int = 2) -> DataFrame:
    """relations that aren't automatic, classes false, and the automatic links of whole classes, classes true.

    A class link stands for a link of each book of one class with each of the
    other, but for pairs that have a relation of their own, which wins:
    n_links says how many are left, and a class link without any is none."""
    counts = _author_counts(books)
    named = lambda c, p: counts.select(F.col("author").alias(c), F.col("class_id").alias(p), F.col("n").alias(f"{p}_n"))
    pairs = class_links(books, least).join(named("author", "a"), "author").join(named("other", "b"), "other")
    pair = lambda x, y: (F.least(x, y).alias("book_id"), F.greatest(x, y).alias("related_id"))
    every = F.when(F.col("a") == F.col("b"), F.expr("a_n * (a_n - 1) div 2")).otherwise(F.col("a_n") * F.col("b_n"))
    links = pairs.select(*pair("a", "b"), every.alias("n")).distinct()
    own = relations.where(F.col("status") != AUTO)
    member = lambda c, p: books.select(F.col("id").alias(c), "author").join(counts, "author").select(c, F.col("class_id").alias(p))
    taken = own.where("book_id <> related_id").select(*pair("book_id", "related_id")).distinct()
    taken = taken.join(member("book_id", "a"), "book_id").join(member("related_id", "b"), "related_id").groupBy(*pair("a", "b")).agg(F.count("*").alias("own"))
    left = links.join(taken, ["book_id", "related_id"], "left").withColumn("n_links", F.col("n") - F.coalesce("own", F.lit(0))).where("n_links > 0")
    kept = own.select("book_id", "related_id", "status", F.lit(False).alias("classes"), F.lit(1).cast("long").alias("n_links"))
    return kept.unionByName(left.select("book_id", "related_id", F.lit(AUTO).alias("status"), F.lit(True).alias("classes"), "n_links"))


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """points(keys, at) joined with spans(keys, start, stop) that hold them (start <= at < stop).

    Both are cut into buckets of so many seconds, so that a key's rows meet
    by bucket and not all with all; a span is in each bucket that it touches."""
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    cut = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop")))))
    return points.withColumn("_bucket", bucket(F.col(at))).join(cut, [*keys, "_bucket"]).where((F.col("start") <= F.col(at)) & (F.col(at) < F.col("stop"))).drop("_bucket")


def sync_auto_links(relations: DataFrame, found: DataFrame) -> DataFrame:
    """Automatic links are replaced by those found; manual and blocked ones stay and win."""
    own = relations.where(F.col("status") != AUTO)
    new = found.join(own.select("book_id", "related_id"), ["book_id", "related_id"], "left_anti").withColumn("status", F.lit(AUTO))
    return own.unionByName(new)


def change_links(relations: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Removing blocks an automatic link and deletes any other; adding makes a manual one."""
    key = ["book_id", "related_id"]
    pair = lambda df: df.select(F.least(*key).alias("book_id"), F.greatest(*key).alias("related_id")).distinct()
    gone, new = pair(removed).withColumn("_gone", F.lit(True)), pair(added)
    kept = relations.join(new, key, "left_anti").join(gone, key, "left")
    kept = kept.where(F.col("_gone").isNull() | (F.col("status") == AUTO)).select(*key, F.when(F.col("_gone"), BLOCKED).otherwise(F.col("status")).alias("status"))
    return kept.unionByName(new.withColumn("status", F.lit(MANUAL)))


def link_all(ids: DataFrame) -> DataFrame:
    """A manual link for each pair of the chosen ids (a user's selection, so its pairs are the result)."""
    other = ids.select(F.col("id").alias("related_id"))
    return ids.select(F.col("id").alias("book_id")).join(other, F.col("book_id") < F.col("related_id")).withColumn("status", F.lit(MANUAL))


def file_key(href: Column) -> Column:
    """A resource's file name, lower case, without fragment and query."""
    return F.lower(F.element_at(F.split(F.regexp_replace(href, "[#?].*$", ""), "/"), -1))
