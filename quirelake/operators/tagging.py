"""Books by their tags. Tags are gathered per book only for the tags that an
expression names, after the scan's filter, so that the aggregation moves no
other pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tagexpr import Compiled, compile_expression, matches


def tag_sets(pairs: DataFrame, only: Sequence[int] | None = None) -> DataFrame:
    rows = pairs if only is None else pairs.where(F.col("tag_id").isin(list(only)))
    return rows.groupBy("book_id").agg(F.collect_set("tag_id").alias("tag_ids"))


def with_all_tags(pairs: DataFrame, tags: Sequence[int]) -> DataFrame:
    wanted = list(dict.fromkeys(tags))
    rows = pairs.where(F.col("tag_id").isin(wanted)).groupBy("book_id").agg(F.countDistinct("tag_id").alias("n"))
    return rows.where(F.col("n") == len(wanted)).select("book_id")


def with_any_tag(books: DataFrame, pairs: DataFrame, tags: Sequence[int]) -> DataFrame:
    return books.join(pairs.where(F.col("tag_id").isin(list(tags))).select("book_id"), "book_id", "left_semi")


def select_books(books: DataFrame, pairs: DataFrame, compiled: Compiled) -> DataFrame:
    """books(book_id, ...) that satisfy a compiled expression; without clauses and exclusions, all books."""
    named = sorted({i for c in compiled.clauses for i in c} | compiled.excluded)
    if not named:
        return books
    joined = books.join(tag_sets(pairs, named).withColumnRenamed("tag_ids", "_tags"), "book_id", "left")
    return joined.where(matches(compiled, F.col("_tags"))).drop("_tags")


def search(books: DataFrame, pairs: DataFrame, tags: dict[str, int], text: str) -> DataFrame:
    return select_books(books, pairs, compile_expression(text, tags))
