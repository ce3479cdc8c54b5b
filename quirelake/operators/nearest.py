"""The k best rows for each row of a query set, exactly, by blocks.

Rows and queries are packed into blocks of Arrow bytes; every block of queries
meets every block of rows once, and a function scores the whole block of pairs
in numpy. A task holds two blocks, and the k best so far of each query: so
what is shuffled is k rows of a query for each task, not a row for each pair."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import small_batches
from .ranking import cap_by

#: Rows and queries of a block; queries up to which their blocks are broadcast.
ROWS, QUERIES, BROADCAST_QUERIES = 4096, 1024, 200_000


def packed(df: DataFrame, rows: int, flag: str | None = None, value: bool = True, first: int | None = None) -> DataFrame:
    """df -> data: its rows as Arrow streams of so many rows at most (the first of a task of so many, the next twice as many);
    with a flag, without it and only rows where it has the value.

    Rows are told apart here and not by a filter, which Spark would push below
    a shuffle: so both values come from one shuffle."""

    def chosen(batch):
        return batch if flag is None else batch.filter(pc.equal(batch[flag], value)).drop_columns([flag])

    return _packed(df, rows, chosen, first=first)


def repacked(df: DataFrame, rows: int, parts: int) -> DataFrame:
    """What ``packed`` gave, dealt to so many partitions, in as few streams of so many rows."""

    def all_of(batch):
        for data in batch.column("data"):
            yield from unpacked(data.as_buffer()).to_batches()

    return _packed(df.repartition(parts), rows, None, all_of)


def _packed(df: DataFrame, rows: int, chosen: Callable | None, parts: Callable = lambda batch: [batch], first: int | None = None) -> DataFrame:
    def run(batches):
        def out(held):
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

        held, n, limit = [], 0, min(first or rows, rows)
        for batch in (part for batch in batches for part in parts(batch)):
            batch = batch if chosen is None else chosen(batch)
            while batch.num_rows:
                held.append(batch.slice(0, limit - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == limit:
                    yield out(held)
                    held, n, limit = [], 0, min(2 * limit, rows)
        if n:
            yield out(held)

    return df.mapInArrow(run, "data binary")


def unpacked(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all().combine_chunks()


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Half away from zero, as SQL does."""
    y = x * 10.0**digits
    return np.trunc(y + np.copysign(0.5, y)) / 10.0**digits


class Best:
    """The k best (score, then least id) of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo("i8").max)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each query, a column for each id; -inf is no pair."""
        least = self.score[:, -1]
        if scores.shape[1] > self.k and (least == -np.inf).any():
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(q):
            return
        self.put(q, scores[q, r], ids[r])

    def put(self, q: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Scores and ids of queries q; none is -inf."""
        worst = self.score[q, -1]
        fit = (score > worst) | ((score == worst) & (ident < self.id[q, -1]))
        if not fit.any():
            return
        q, score, ident = q[fit], score[fit], ident[fit]
        known = np.unique(q)
        at, place = np.nonzero(self.score[known] > -np.inf)
        row = np.concatenate([known[at], q])
        score = np.concatenate([self.score[known[at], place], score])
        ident = np.concatenate([self.id[known[at], place], ident])
        order = np.lexsort((ident, -score, row))
        row, score, ident = row[order], score[order], ident[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[row[keep], place[keep]] = score[keep]
        self.id[row[keep], place[keep]] = ident[keep]


def best_of(queries: DataFrame, rows: DataFrame, k: int, prepare: Callable[[pa.Table], object], score: Callable[[object, object], np.ndarray]) -> DataFrame:
    """queries and rows (each with a long id, not null) -> query_id, id, score: the k best of each query by score, then id.

    prepare makes a block's table into what score takes; score(query block, row
    block) gives a matrix of doubles, -inf where there is no pair, never NaN."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = queries.select("id").limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES

    def whole(table: pa.Table) -> SimpleNamespace:
        return SimpleNamespace(ids=table["id"].to_numpy(), ready=prepare(table))

    def meet(asked: SimpleNamespace, block: SimpleNamespace, best: Best) -> None:
        best.add(score(asked.ready, block.ready), block.ids)

    return best_of_blocks(packed(queries, QUERIES), packed(rows, ROWS).repartition(n), k, "broadcast" if few else None, whole, meet)


def best_of_blocks(queries: DataFrame, rows: DataFrame, k: int, hint: str | None, prepare: Callable[[pa.Table], object], meet: Callable[[object, object, Best], None]) -> DataFrame:
    """queries and rows (data: what ``packed`` gives of tables with a long id) -> query_id, id, score, as ``best_of``; hint: how Spark joins blocks.

    prepare makes a block's table into what meet takes, with its ids in the
    order of its own rows; meet(query block, row block, best) adds what it
    finds to the best of the query block."""
    small_batches(rows.sparkSession)
    asked = queries.withColumnRenamed("data", "asked")
    both = rows.crossJoin(asked.hint(hint) if hint else asked)

    def run(batches):
        blocks: dict[bytes, tuple] = {}
        name, block = None, None
        for batch in batches:
            for data, question in zip(batch.column("data"), batch.column("asked")):
                data, question = data.as_buffer(), question.as_buffer()
                if (mark := blake2b(data, digest_size=16).digest()) != name:
                    name, block = mark, None  # the last one goes before the next comes
                    block = prepare(unpacked(data))
                if (mark := blake2b(question, digest_size=16).digest()) not in blocks:
                    ready = prepare(unpacked(question))
                    blocks[mark] = ready, Best(len(ready.ids), k)
                meet(blocks[mark][0], block, blocks[mark][1])
        for ready, best in blocks.values():
            q, place = np.nonzero(best.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ready.ids[q]), pa.array(best.id[q, place]), pa.array(best.score[q, place])], ["query_id", "id", "score"])

    found = both.mapInArrow(run, "query_id long, id long, score double")
    return cap_by(found, ["query_id"], [F.desc("score"), "id"], k)
