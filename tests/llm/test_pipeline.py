"""The pipeline on small tables, and the registered queries on the driver's."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirelake import llm
from quirelake.llm import exact_dedup, mixing, order_minhash, packing, toxicity

from .test_operators import docs_of, odd  # noqa: F401  a fixture

DATA = "/root/testdata/sf0.001"


def test_stages(spark, odd, tmp_path):  # noqa: F811
    rows = [*odd, *[(1000 + i, f"calm words number {i} " * 5 + ("snarfle you " if i % 3 == 0 else "") + f"end{i} tail{i * 7} note{i * 11}", "en", "a") for i in range(60)]]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen[1] == seen[0] - 20  # every third of 60
    # each stage has done its whole work: another pass finds nothing
    assert exact_dedup.exact_groups(spark, docs.where("doc_id is not null")).where("not kept").count() == 0
    assert order_minhash.near_classes(spark, docs).where("not kept").count() == 0
    assert seen[4] == seen[3]
    total = packing.pack(spark, docs).agg(F.sum("length")).first()[0]
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == total


def test_stages_of_empty_tables(spark, tmp_path):
    docs_of(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sequences_follow_the_mix(spark, tmp_path):
    rng = random.Random(5)
    # the hot source's files, last in the mix, are the longest: its text is the least compressible
    hot = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(300)), "en", "hot") for i in range(1500)]
    small = [(5000 + i, f"calm {i} " + "words that come again " * 140, "en", "small") for i in range(400)]
    docs_of(spark, [*hot, *small]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    again = spark.read.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.pack_sequences(spark, again, "").select("sequence_id", "doc_id").collect()
    order = {s: i for i, s in enumerate(sorted({r["sequence_id"] for r in got}))}
    where = {}
    for r in got:
        where.setdefault(r["doc_id"], order[r["sequence_id"]])
    # slots of the documents, and places of their sequences: late slots come late
    slots = {r["doc_id"]: r["slot"] for r in mixing.mix(spark, docs).select("doc_id", "slot").collect()}
    ids = sorted(slots)
    assert np.corrcoef([slots[i] for i in ids], [where[i] for i in ids])[0, 1] > 0.9
    # none of the small source stands among the last sequences, where only the hot source is left
    end = max(s for i, s in slots.items() if i >= 5000)
    late = {where[i] for i in ids if slots[i] > end + 1}
    assert late and np.median([where[i] for i in ids if i >= 5000]) < min(np.median(list(late)), 0.6 * len(order))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))
    assert toxicity.held_out is not None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "sales", "sale_lines", "clients"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = llm.QUERIES[name](spark, DATA)
    want = con.execute(llm.ORACLES[name])
    order = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(order)
    assert sorted(map(str, (tuple(r) for r in df.select(order).collect()))) == sorted(map(str, want.fetchall()))
