"""The corpus pipeline: toxic documents go, then exact copies, then near
copies; what stays is mixed by source and packed into training sequences.

Each stage reads what the one before it wrote; ``run`` starts from the table
``documents``. ORACLE_SQL is None: stages 1, 3, 4 and 5 have no SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import exact_dedup, mixing, order_minhash, packing, toxicity
from quirelake.llm.common import read, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't reject; labels come from the table ``labels``."""
    return toxicity.drop_toxic(spark, docs, read(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least doc_id; rows without a doc_id stay."""
    return exact_dedup.drop_copies(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the least doc_id; rows without a doc_id stay."""
    return order_minhash.drop_near_copies(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files hold ascending runs of slots."""
    return mixing.mixed(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences numbered in the order of the mix.

    Files are read in the order of their sizes, so the mix is dealt again; it
    depends on the documents alone, so it's the same one."""
    return packing.pack(spark, mixing.mixed(spark, docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(spark, docs, f"stage-{name}")
    return docs
