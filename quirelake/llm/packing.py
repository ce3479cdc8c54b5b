"""Operator 6: cost-balanced packing into training sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention within a
document). Documents are gathered in groups of bounded size inside a task;
whole capacities are cut off long documents, and what is left is assigned in
descending length to the sequence of least cost that has room. What fits
nowhere whole is cut over the room that remains, so a group leaves less than
one capacity of padding. No row is shuffled: each task packs what it reads.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches
from .token_counts import _byte_letters, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens and documents that a group gathers before it is packed.
GROUP_TOKENS, GROUP_DOCS = 2_000_000, 4096
#: Runs that tiktoken's pattern is not given: it goes back over a run, which costs its square.
_LONG_RUN = re.compile(r"\s{200}")
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _SCHEMA.split(", ")])


def padded(length: int, capacity: int = CAPACITY) -> int:
    """Stored length of a sequence: the capacity, or itself at a power of two."""
    return length if length & (length - 1) == 0 else capacity


@lru_cache(maxsize=2)
def encoder(path: str, plain: bool = False):
    """text -> ids, of the byte-level BPE vocabulary in path; plain: special strings are text like any other.

    tiktoken runs the vocabulary of the tokenizers file (its ids are its merge
    ranks), five times as fast as the library itself; tests hold it against
    the library. Special strings in a text are taken as the library does. A
    text whose runs are too long for tiktoken's word pattern goes through the
    library."""
    import tiktoken
    import tokenizers

    spec = json.loads(open(path, encoding="utf-8").read())
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("a plain byte-level BPE file is needed")
    byte = {c: b for b, c in enumerate(_byte_letters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    bpe = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    names = set(special)
    library: list = []

    def encode(text: str) -> list[int]:
        if not _LONG_RUN.search(text):
            return bpe.encode_ordinary(text) if plain else bpe.encode(text, allowed_special=names, disallowed_special=())
        if not library:
            library.append(tokenizers.Tokenizer.from_file(path))
            library[0].no_truncation()
            library[0].no_padding()
            library[0].encode_special_tokens = plain
        return library[0].encode(text, add_special_tokens=False).ids

    return encode


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each token once."""
    sequences: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []  # (length, document, start)
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            sequences.append([(doc, start, capacity)])
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    if not rest:
        return sequences
    rest.sort(key=lambda x: (-x[0], x[1]))
    k = -(-sum(x[0] for x in rest) // capacity)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    room, cost = np.full(k, capacity), np.zeros(k)
    late = []
    for n, doc, start in rest:
        i = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[i] < n:
            late.append((n, doc, start))
            continue
        bins[i].append((doc, start, n))
        room[i] -= n
        cost[i] += linear * n + quadratic * n * n
    by_room = iter(np.argsort(-room, kind="stable").tolist())
    i = next(by_room) if late else -1
    for n, doc, start in late:
        while n:
            if not room[i]:
                i = next(by_room)
                continue
            take = min(n, int(room[i]))
            bins[i].append((doc, start, take))
            room[i] -= take
            start, n = start + take, n - take
    return sequences + [b for b in bins if b]


def _packer(name: str, capacity: int):
    def run(batches):
        encode = encoder(tokenizer_path(name))
        base = TaskContext.get().partitionId() << 36
        made, ids, docs, held = 0, [], [], 0

        def flush():
            nonlocal made, ids, docs, held
            rows: list[tuple] = []
            # numbered by where their tokens stood, so that ids follow the order of the rows
            stood = lambda pieces: sum(doc * n for doc, _, n in pieces) / sum(n for _, _, n in pieces)
            for pieces in sorted(assign([len(x) for x in ids], capacity), key=stood):
                offset = 0
                for doc, start, n in pieces:
                    piece = ids[doc][start : start + n]
                    rows.append((docs[doc], start, n, zlib.crc32(piece.tobytes()), len(ids[doc]), base + made, offset))
                    offset += n
                made += 1
            ids, docs, held = [], [], 0
            for at in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 8192])], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = np.array([*encode(text), END_ID] if text else [END_ID], dtype="<u4")
                ids.append(tokens)
                docs.append(doc)
                held += len(tokens)
                if held >= GROUP_TOKENS or len(ids) >= GROUP_DOCS:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> a row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    Each document ends with id 1; a null or empty text is that id alone.
    Repeated rows and rows without a doc_id are packed like any other; other
    columns are ignored; an empty table gives an empty result. Sequence ids
    are unique over the result. Very long texts are cut over as many sequences
    as they fill; equal lengths are taken in the order of the rows. Ids differ from run to run only if the rows
    reach other partitions."""
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, capacity), _SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read(spark, sf_dir, "documents"))
