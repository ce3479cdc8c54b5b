"""Dictionary files as tables: word lists, frequency lists, and tab-separated JSON lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines without comments and blank ones; the number is the byte order within and across files."""
    rows = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    return rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def _first(df: DataFrame, key: str) -> DataFrame:
    names = [c for c in df.columns if c not in (key, "_at")]
    if not names:
        return df.select(key).distinct()
    return df.groupBy(key).agg(F.min_by(F.struct(*names), "_at").alias("_r")).select(key, "_r.*")


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """word freq [kind] -> word, freq, kind; the first of a word stands."""
    part = F.split("line", r"\s+")
    rows = _lines(spark, path).select(part[0].alias("word"), F.get(part, F.lit(1)).try_cast("long").alias("freq"), F.get(part, F.lit(2)).alias("kind"), "_at")
    return _first(rows.where("freq is not null"), "word")


def value_list(spark: SparkSession, path: str, separator: str = "\t", kind: str = "double") -> DataFrame:
    """word<separator>value -> word, value."""
    part = F.split("line", separator)
    rows = _lines(spark, path).select(F.trim(part[0]).alias("word"), F.trim(F.get(part, F.lit(1))).try_cast(kind).alias("value"), "_at")
    return _first(rows.where("value is not null"), "word")


def word_set(spark: SparkSession, path: str) -> DataFrame:
    return _first(_lines(spark, path).select(F.col("line").alias("word"), "_at"), "word")


def tsv_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """key<tab>json -> key, entry; JSON is parsed only for the rows that are left after filters on key."""
    part = F.split("line", "\t", 2)
    rows = _lines(spark, path).select(part[0].alias("key"), F.get(part, F.lit(1)).alias("json"), "_at").where("json is not null")
    return _first(rows, "key").select("key", F.from_json("json", schema).alias("entry"))


ENGLISH = "w string, p string, t string"
CHINESE = "heteronyms array<struct<pinyin:string,definitions:array<struct<type:string,def:string,example:array<string>>>>>"


def is_chinese(text: Column) -> Column:
    return text.rlike(r"[\x{4E00}-\x{9FFF}]")


def look_up(queries: DataFrame, english: DataFrame, chinese: DataFrame) -> DataFrame:
    """queries(id, text) -> id, lexicon, key, entry: Chinese words exactly, others in lower case; 80 characters at most."""
    asked = queries.select("id", F.left(F.trim("text"), F.lit(80)).alias("key")).where("key <> ''")
    zh = asked.where(is_chinese(F.col("key"))).join(chinese, "key").select("id", F.lit("chinese").alias("lexicon"), "key", F.to_json("entry").alias("entry"))
    en = asked.where(~is_chinese(F.col("key"))).withColumn("key", F.lower("key")).join(english, "key").select("id", F.lit("english").alias("lexicon"), "key", F.to_json("entry").alias("entry"))
    return zh.union(en)


def numbered(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(order)))
