"""Chapters of plain text: titles by pattern, slices by offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as w
from .ranking import first_by

#: Lines that title a chapter.
TITLES = [
    r"^\s*(第[零一二三四五六七八九十百千万\d]+[章节回卷部集篇])(?![\p{L}\p{N}])\s*.*$",
    r"(第[零一二三四五六七八九十百千万\d]+话)(?![\p{L}\p{N}])\s*.*$",
    r"^\s*[Cc]hapter\s+\d+.*$",
    r"^\s*(序章|楔子|前言|后记|尾声|番外[一二三四五六七八九十\d]*|附录[一二三四五六七八九十\d]*|尾声|终章|引子|写在前面)\s*.*$",
    r"^\s*(Prologue|Epilogue|Preface|Foreword|Afterword|Acknowledgments?)\s*.*$",
    r"^\s*[Pp]art\s+\d+.*$",
    r"^\s*[Bb]ook\s+\d+.*$",
    r"^\s*[Vv]olume\s+\d+.*$",
]
#: What a title holds or begins with where a book has over MANY chapters.
HOLDS, BEGINS, MANY = "[章回卷节部篇话]", "序|楔|前言|后记|尾声|番外|附录|终章|引子|Prologue|Epilogue|Chapter", 30
#: Fixed value: a chapter holds so many characters at least.
LEAST = 100


def title_of(line: Column, extra: list[str] | None = None) -> Column:
    """The text that the first matching pattern finds in a line; "" if none does. Invalid patterns are left out."""
    out = F.when(F.lit(False), "")
    for p in TITLES + [x for x in extra or [] if _valid(x)]:
        out = out.when(line.rlike(p), F.trim(F.regexp_extract(line, p, 0)))
    return out.otherwise("")


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def detect(texts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """texts(book_id, text) -> book_id, title, start, length, in order of start.

    Titles closer than LEAST to the next one are entries of a table of
    contents; of equal titles the first that is left counts. Books with over
    MANY chapters keep titles of known form only."""
    lines = texts.select("book_id", F.length("text").alias("_all"), F.posexplode(F.split("text", "\n")).alias("_i", "line"))
    start = F.coalesce(F.sum(F.length("line") + 1).over(w.before(["book_id"], ["_i"])), F.lit(0))
    titled = lines.withColumn("start", start).withColumn("title", title_of(F.col("line"), extra)).where("title <> ''")
    order = Window.partitionBy("book_id").orderBy("start")
    gap = F.coalesce(F.lead("start").over(order), F.col("_all")) - F.col("start")
    real = titled.withColumn("_gap", gap).where(F.col("_gap") >= LEAST).select("book_id", "title", "start", "_all")
    first = first_by(real, ["book_id", "title"], ["start"])
    counted = first.withColumn("_n", F.count("*").over(Window.partitionBy("book_id")))
    known = F.col("title").rlike(HOLDS) | F.col("title").rlike(f"^(?:{BEGINS})")
    kept = counted.where((F.col("_n") <= MANY) | known)
    return kept.select("book_id", "title", "start", (F.coalesce(F.lead("start").over(order), F.col("_all")) - F.col("start")).alias("length"))


def materialise(texts: DataFrame, chapters: DataFrame, name: str = "text") -> DataFrame:
    """Chapters with their content; text before the first is a chapter of the book's own, as is a book without any."""
    firsts = chapters.groupBy("book_id").agg(F.min("start").alias("_first"))
    joined = texts.join(firsts, "book_id", "left")
    head = joined.select("book_id", F.lit(name).alias("title"), F.lit(0).cast("long").alias("start"), F.coalesce("_first", F.length("text")).cast("long").alias("length")).where("length > 0")
    rows = head.unionByName(chapters.select("book_id", "title", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")))
    content = F.trim(F.substring(F.col("text"), (F.col("start") + 1).cast("int"), F.col("length").cast("int")))
    return rows.join(texts, "book_id").select("book_id", "title", "start", content.alias("content")).where("content <> ''")


def absorb(chapters: DataFrame, hidden: Column) -> DataFrame:
    """Hidden chapters join the one before; the first can't."""
    marked = w.islands(chapters, ["book_id"], ["start"], ~hidden, "_island")
    return marked.groupBy("book_id", "_island").agg(F.min_by("title", "start").alias("title"), F.min("start").alias("start"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "content"))), lambda x: x["content"]), "\n").alias("content")).drop("_island")


def sample_for_type(chapters: DataFrame, chars: int = 1000) -> DataFrame:
    """The first, middle and last chapter of each book, cut."""
    by = Window.partitionBy("book_id")
    rows = chapters.withColumn("_n", F.row_number().over(by.orderBy("start"))).withColumn("_all", F.count("*").over(by))
    middle = F.call_function("div", F.col("_all"), F.lit(2).cast("long")) + 1
    return rows.where((F.col("_n") == 1) | (F.col("_n") == middle) | (F.col("_n") == F.col("_all"))).select("book_id", "title", F.left("content", F.lit(chars)).alias("content"))


def digest(chapters: DataFrame) -> DataFrame:
    """One text per book: 【title】summary, in order."""
    parts = F.sort_array(F.collect_list(F.struct("start", F.concat(F.lit("【"), F.col("title"), F.lit("】"), F.col("summary")).alias("s"))))
    return chapters.groupBy("book_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "\n").alias("digest"))


def batches(chapters: DataFrame, size: int = 6, done: DataFrame | None = None) -> DataFrame:
    """Chapters that are still to be done, numbered into batches by book: a run picks up after what is stored."""
    rows = chapters if done is None else chapters.join(done.select("book_id", "title"), ["book_id", "title"], "left_anti")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("start")) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("long"))
