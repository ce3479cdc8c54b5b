"""The roles of a document library, bound to the driver's tables.

``Tables`` gives each role as a DataFrame, ``VIEWS`` the same role as SQL. The
bindings only rename and derive columns, so that filters and column pruning
reach the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters on a page of a book, and of a chunk; characters that chunks share.
PAGE, CHUNK, OVERLAP = 600, 1000, 100

VIEWS = {
    "books": f"""SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source AS author, lang AS format,
        n_chars AS total_characters, (n_chars // {PAGE} + 1)::BIGINT AS total_pages,
        ((doc_id * 7) % (n_chars // {PAGE} + 2))::BIGINT AS current_page,
        ((doc_id * 7919) % 100003)::BIGINT AS last_read, ((doc_id * 104729) % 1000003)::BIGINT AS added,
        ((doc_id * 31) % 5000)::BIGINT AS reading_time FROM documents""",
    "tags": "SELECT DISTINCT substr(p_brand, 7)::BIGINT AS id, p_brand AS name FROM part",
    "book_tags": "SELECT DISTINCT l_orderkey AS book_id, substr(p_brand, 7)::BIGINT AS tag_id FROM lineitem JOIN part ON l_partkey = p_partkey",
    "relations": """SELECT least(c_custkey, (c_custkey * 17 + 3) % 1000) AS book_id, greatest(c_custkey, (c_custkey * 17 + 3) % 1000) AS related_id,
        (c_custkey % 3)::INT AS status FROM customer WHERE c_custkey <> (c_custkey * 17 + 3) % 1000""",
    "chunks": f"""SELECT doc_id AS book_id, i::BIGINT AS chunk_index, 'part ' || (i // 5)::VARCHAR AS chapter,
        substr(text, 1 + i * {CHUNK - OVERLAP}, {CHUNK}) AS content, (i * {CHUNK - OVERLAP})::BIGINT AS char_offset
        FROM documents, unnest(range(0, greatest(1, ceil((length(text) - {OVERLAP}) / {CHUNK - OVERLAP}.0))::BIGINT)) AS u(i)""",
    "readings": "SELECT ts::DATE AS day, user_id AS book_id, floor(value * 10)::BIGINT AS seconds, event_type FROM events",
    "messages": "SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations",
    "keywords": """SELECT book_id, keyword, weight, rank FROM (
        SELECT doc_id AS book_id, word AS keyword, round(n::DOUBLE / max(n) OVER (PARTITION BY doc_id), 6) AS weight,
          row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) - 1 AS rank
        FROM (SELECT doc_id, word, count(*) AS n FROM (
          SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM documents) GROUP BY ALL)) WHERE rank < 10""",
}


class Tables:
    """Role tables over sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @property
    def books(self) -> DataFrame:
        pages = F.expr(f"n_chars div {PAGE} + 1")
        return self.raw("documents").select(
            F.col("doc_id").alias("id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("source").alias("author"),
            F.col("lang").alias("format"),
            F.col("n_chars").alias("total_characters"),
            pages.alias("total_pages"),
            ((F.col("doc_id") * 7) % (pages + 1)).alias("current_page"),
            (F.col("doc_id") * 7919 % 100003).alias("last_read"),
            (F.col("doc_id") * 104729 % 1000003).alias("added"),
            (F.col("doc_id") * 31 % 5000).alias("reading_time"),
        )

    @property
    def tags(self) -> DataFrame:
        return self.raw("part").select(F.substring("p_brand", 7, 9).cast("long").alias("id"), F.col("p_brand").alias("name")).distinct()

    @property
    def book_tags(self) -> DataFrame:
        # distinct pairs of the narrow columns; the small side is left to the optimiser, which knows its size
        part = self.raw("part").select("p_partkey", F.substring("p_brand", 7, 9).cast("long").alias("tag_id"))
        return self.raw("lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("book_id"), "tag_id").distinct()

    @property
    def relations(self) -> DataFrame:
        other = (F.col("c_custkey") * 17 + 3) % 1000
        rows = self.raw("customer").where(F.col("c_custkey") != other)
        return rows.select(F.least("c_custkey", other).alias("book_id"), F.greatest("c_custkey", other).alias("related_id"), (F.col("c_custkey") % 3).cast("int").alias("status"))

    @property
    def chunks(self) -> DataFrame:
        from ..operators.retrieval import chunk

        return chunk(self.raw("documents").select(F.col("doc_id").alias("book_id"), "text"), CHUNK, OVERLAP)

    @property
    def readings(self) -> DataFrame:
        return self.raw("events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("book_id"), F.floor(F.col("value") * 10).alias("seconds"), "event_type")

    @property
    def messages(self) -> DataFrame:
        return self.raw("conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"))

    @property
    def keywords(self) -> DataFrame:
        from ..operators.keywords import simple_keywords

        return simple_keywords(self.raw("documents").select(F.col("doc_id").alias("book_id"), "text"))
