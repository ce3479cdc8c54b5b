"""Operator 8: language identification by compression.

For each language a raw-content zstandard dictionary is cut from labelled
texts. A text is compressed, block by block, with the dictionary of every
language; the language whose dictionary gives the fewest bytes is predicted.
Blocks are short so that the dictionary, not the text's own past, is what the
coder draws on. A narrow margin is marked as not confident (the contract of
the query still wants a learned language for it).
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lowest_by_hash, read, sized, small_batches

#: Bounds of the training sample: documents of each language, and bytes of a dictionary.
SAMPLE_DOCS, DICTIONARY_BYTES = 400, 32 * 1024
#: Training texts are cut into pieces of so many characters, dealt by hash.
PIECE = 512
#: Bytes compressed at once, and the compressor's level.
BLOCK, LEVEL = 512, 6
#: Relative margin under which a prediction is not confident.
NARROW = 0.01
_LETTER = regex.compile(r"\p{L}")


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Language -> raw dictionary content, from docs(doc_id, text, lang) that may be learned from."""
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\p{L}"))
    chosen = lowest_by_hash(fit.select("doc_id", "lang").distinct(), "doc_id", sample, "lang")
    texts = fit.join(sized(chosen), ["doc_id", "lang"], "left_semi").select("lang", "doc_id", "text")
    pieces = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?s).{1,%d}" % PIECE), F.lit(0))).alias("piece"))
    ranked = pieces.distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")))
    taken = ranked.where(F.col("n") <= size // PIECE).orderBy("lang", "n").collect()
    out: dict[str, list[bytes]] = {}
    for row in taken:
        out.setdefault(row["lang"], []).append(row["piece"].encode("utf-8"))
    return {lang: b"\n".join(p)[:size] for lang, p in out.items()}


@lru_cache(maxsize=4)
def _compressors(content: tuple[tuple[str, bytes], ...]):
    out = []
    for lang, raw in content:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, content: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """(language, score, confident) of a whole text."""
    if not text or not content or not _LETTER.search(text):
        return "und", 0.0, False
    raw = text.lower().encode("utf-8")  # capitals say nothing of the language
    sizes = []
    for lang, c in _compressors(content):
        sizes.append((sum(len(c.compress(raw[at : at + BLOCK])) for at in range(0, len(raw), BLOCK)), lang))
    sizes.sort()
    if len(sizes) == 1:
        return sizes[0][1], 1.0, True
    margin = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], margin, margin >= NARROW


def _predict(content: tuple[tuple[str, bytes], ...]):
    def run(batches):
        for batch in batches:
            got = [classify(t, content) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "confident"])

    return run


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score, confident.

    Learns from rows that are not held out and have a text with a letter and a
    lang; predicts every row from its text alone. A null text, or one without
    a letter, is "und" with score 0; so is every text if nothing can be
    learned from. Ties go to the language that sorts first. Repeated rows get
    equal rows; a row without a doc_id is not held out; other columns are
    ignored; an empty table gives an empty result. Very long texts are
    compressed whole, block by block. Numerals and marks are no letters."""
    small_batches(spark)
    content = tuple(sorted(learn(spark, docs.where(~held_out())).items()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(content), "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, read(spark, sf_dir, "documents"))
