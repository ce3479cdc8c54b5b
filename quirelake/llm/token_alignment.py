"""Operator 11: alignment of the tokens of two tokenizers, as Spark relations.

A text with a space before it is cut before each space that follows something
other than white space. Neither tokenizer makes a token over such a place:
the byte-level one's word pattern takes white space only at the start of a
word, and the other one's vocabulary is checked to have no piece with a space
after something else (if it has, texts are not cut). So a word has the same
tokens wherever it stands, all texts' words are counted, and each distinct
word is encoded and aligned once:

- posexplode gives the tokens of both sides, a windowed sum of their lengths
  where each ends;
- an equi-join of both sides on word and end finds the cuts; a cut's two
  tokens are a link;
- a running count of the cuts before a token is its group.

Corpus-wide counts of id pairs follow from the words' counts. Then the texts'
words, in their places, are joined to the aligned words and summed. In joins,
keys that come up most are broadcast, as many as a fixed bound allows, and
only the others are shuffled: what is shuffled has no hot key.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, read, setting, sized, small_batches, written
from .packing import encoder
from .token_counts import _byte_letters, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = chr(0x2581)
#: What a cut's space must not follow: all that either side, or any version of Unicode, takes for white space.
BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
CUT = f" (?<=[^{BLANKS}] )"
#: Rows that are broadcast, and the bytes of their strings; others are shuffled.
HOT_ROWS, HOT_WORD, HOT_TEXT = 400_000, 64, 256
#: Partitions of the texts' words, for each of the session's.
WIDER = 4

_UNITS = "part string, n long, a array<int>, a_len array<int>, b array<int>, b_len array<int>, whole boolean"
_ARROW = pa.schema([("part", pa.string()), ("n", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("a", "a_len", "b", "b_len")], ("whole", pa.bool_())])
_COUNTS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str):
    """(encode words by A, by B, bytes of A's ids, of B's ids)."""
    import sentencepiece

    a = encoder(a_path, plain=True)
    byte = {c: b for b, c in enumerate(_byte_letters())}
    words = json.loads(open(a_path, encoding="utf-8").read())["model"]["vocab"]
    a_bytes = {i: bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode() for w, i in words.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = dict(enumerate(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)))
    space = [b.piece_to_id(SPACE)]

    def by_a(words: list[str]) -> list[list[int]]:
        return [a(" " + w) for w in words]

    def by_b(words: list[str]) -> list[list[int]]:
        # the library puts a space before each text but an empty one
        return [ids if w else space for w, ids in zip(words, b.encode(words, num_threads=1))] if words else []

    return by_a, by_b, a_bytes, b_bytes


def words_apart(b_path: str) -> bool:
    """Whether no piece of the second side has a space after something else."""
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    return not any(x != SPACE and y == SPACE for p in map(b.id_to_piece, range(b.get_piece_size())) for x, y in zip(p, p[1:]))


def _encoded(a_name: str, b_name: str):
    def run(batches):
        by_a, by_b, a_bytes, b_bytes = encoders(tokenizer_path(a_name), tokenizer_path(b_name))
        sides = [(by_a, _lengths(a_bytes), a_bytes), (by_b, _lengths(b_bytes), b_bytes)]
        for batch in batches:
            words = batch.column("part").to_pylist()
            raw = [b" " + w.encode() for w in words]
            columns, whole = [batch.column("part"), batch.column("n")], np.ones(len(words), bool)
            for encode, length, spelled in sides:
                ids = encode(words)
                whole &= np.fromiter((b"".join([spelled[i] for i in x]) == r for x, r in zip(ids, raw)), bool, len(words))
                ends = np.cumsum([0, *map(len, ids)], dtype="i4")
                flat = np.fromiter(chain.from_iterable(ids), "i4", int(ends[-1]))
                columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (flat, length[flat])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(whole)], schema=_ARROW)

    return run


def _lengths(spelled: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(spelled) + 1, "i4")
    for i, x in spelled.items():
        out[i] = len(x)
    return out


def joins_keep_partitions(spark: SparkSession):
    """Within, a join on (word, end) takes sides that are partitioned by word alone as they are: no key has more than a word's tokens."""
    return setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def _in_order(items: Column, sep: str) -> Column:
    """Text of collected (order, text) pairs."""
    return F.array_join(F.transform(F.sort_array(items), lambda x: x["text"]), sep)


def aligned(units: DataFrame, partitions: int) -> DataFrame:
    """units(unit, part, n, a, a_len, b, b_len) -> unit, part, n, n_a, n_b, n_groups, groups, links of (a, b).

    Both sides are partitioned by unit once; window, join, union and
    aggregation keep to that."""
    dealt = units.repartition(partitions, "unit")
    so_far = Window.partitionBy("unit").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def side(ids: str) -> DataFrame:
        tokens = dealt.select("unit", "part", "n", F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(f"{ids}_len").alias("len"))).alias("pos", "token"))
        first = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("part", "n")]
        return tokens.select("unit", *first, "pos", F.col("token.id").alias("id"), F.sum("token.len").over(so_far).alias("end"))

    b = side("b")
    # a cut is where tokens of both sides end: these two are a link
    a = side("a").join(b.select("unit", "end", F.col("id").alias("with")), ["unit", "end"], "left")
    both = a.select("unit", "part", "n", "end", F.lit(0).alias("side"), "id", "with").union(b.select("unit", F.lit(None).cast("string"), F.lit(None).cast("long"), "end", F.lit(1), "id", F.lit(None).cast("int")))
    before = Window.partitionBy("unit").orderBy("end").rangeBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("group", F.count("with").over(before))
    link = F.when(F.col("with").isNotNull(), F.struct(F.col("id").alias("a"), F.col("with").alias("b")))
    found = placed.groupBy("unit").agg(
        F.max("part").alias("part"), F.max("n").alias("n"), F.sum(1 - F.col("side")).alias("n_a"), F.sum("side").alias("n_b"), F.count("with").alias("n_groups"), F.collect_list(link).alias("links"), F.sort_array(F.collect_list(F.struct("group", "side", "end", "id"))).alias("tokens")
    )

    def with_mark(x: Column, i: Column) -> Column:
        last = F.col("tokens")[F.greatest(i - 1, F.lit(0))]
        mark = F.when(i == 0, "").when(last["group"] != x["group"], ";").when(last["side"] != x["side"], "|").otherwise(",")
        return F.concat(mark, x["id"].cast("string"))

    return found.withColumn("groups", F.array_join(F.transform("tokens", with_mark), "")).drop("tokens")


def hot_rows(table: DataFrame, weight: str, rows: int) -> Column:
    """A condition that holds for at most so many rows of table, those of the largest weights; what reaches the driver is a histogram of a few hundred bins."""
    size = F.floor(F.log2(F.greatest(F.col(weight), F.lit(1))) * 8)
    least, seen = None, 0
    for b, n in sorted(((r["b"], r["n"]) for r in table.groupBy(size.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True):
        seen += n
        if seen > rows:
            break
        least = b
    return F.lit(False) if least is None else size >= least


def pair_counts(spark: SparkSession, words: DataFrame) -> DataFrame:
    """words(n, links) -> a, b, count, best (1 if no other a has a higher count with b)."""
    pairs = written(spark, words.select("n", F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    out = written(spark, pairs.join(sized(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best")), "pair-counts")
    dropped(spark, pairs)
    return out


def weighed(spark: SparkSession, words: DataFrame) -> DataFrame:
    """aligned words -> with n_best and count_sum, without links."""
    pairs = pair_counts(spark, words)
    hot = hot_rows(pairs, "count", HOT_ROWS)
    links = words.select("unit", F.inline("links"))
    first = links.join(F.broadcast(pairs.where(hot)), ["a", "b"], "left")
    rest = first.where("count is null").select("unit", "a", "b").join(pairs.where(~hot), ["a", "b"])
    found = first.where("count is not null").select("unit", "count", "best").union(rest.select("unit", "count", "best"))
    sums = found.groupBy("unit").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    out = written(spark, words.drop("links").join(sums, "unit").drop("unit"), "words", "zstd")
    dropped(spark, pairs)
    return out


def align(spark: SparkSession, docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, a row for each row.

    groups is the text `a1,a2|b1;a3|b2,b3` of ids in order. A null or empty
    text has no tokens, nor has one whose tokens' bytes don't add up to the
    text with a space before it (as with U+2581, which the second side takes
    for a space): its counts are 0, its groups '', and its words don't count
    in the corpus. Special strings are plain text. Repeated rows count each
    and get the same result; rows without a doc_id are rows like others; a
    very long text is cut into words, and a text without spaces is one word.
    Other columns are ignored; an empty table gives an empty result."""
    small_batches(spark)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = F.split("text", CUT) if words_apart(tokenizer_path(b)) else F.array("text")
    key = [F.xxhash64(F.lit(i), "doc_id", "text").alias(f"k{i}") for i in (1, 2)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(*key, "doc_id", "text")
    spoken = rows.where("text <> ''")
    counted = lambda some: some.select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    units = written(spark, counted(spoken).mapInArrow(_encoded(a, b), _UNITS).withColumn("unit", F.monotonically_increasing_id()), "units")

    mute = rows.where("text = ''")
    odd = units.where("not whole").select("part")
    if odd.limit(1).count():
        lost = written(spark, spoken.select("k1", "k2", F.explode(parts).alias("part")).join(sized(odd), "part", "left_semi").select("k1", "k2").distinct(), "lost")
        mute = mute.union(spoken.join(sized(lost), ["k1", "k2"], "left_semi").select(mute.columns))
        spoken = spoken.join(sized(lost), ["k1", "k2"], "left_anti")
        units = written(spark, units.drop("n").join(counted(spoken), "part"), "recounted")
    with joins_keep_partitions(spark):
        found = written(spark, aligned(units, partitions), "aligned")
    dropped(spark, units)
    words = weighed(spark, found)
    dropped(spark, found)

    one = spoken.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    one = written(spark, one.select("doc_id", "text", "copies", F.monotonically_increasing_id().alias("row")), "texts", "zstd")
    placed = lambda texts: texts.select("row", F.posexplode(parts).alias("pos", "part"))
    hot = hot_rows(words, "n", HOT_ROWS) & (F.octet_length("part") <= HOT_WORD) & (F.octet_length("groups") <= HOT_TEXT)
    columns = ("row", "pos", *_COUNTS, "groups")
    common = written(spark, words.where(hot).drop("n"), "common", "zstd")
    # words that are not broadcast go to theirs and are written: the shuffle files of the way there don't lie beside those of the way back
    rare = placed(one).join(F.broadcast(common.select("part")), "part", "left_anti").join(words.where(~hot), "part").select(*columns)
    rare = written(spark, rare, "rare", "zstd")
    dropped(spark, words)

    # rows of words are ten times as large as the texts
    fine = WIDER * partitions
    # the texts look the others up, and what is broadcast stays in its partitions by row
    hits = placed(one.select("row", "text").repartition(fine, "row")).join(F.broadcast(common), "part").select(*columns)
    whose = one.select("row", "doc_id", "copies").repartition(fine, "row").select("row", *[F.lit(None).alias(c) for c in columns[1:]], "doc_id", "copies")
    both = whose.unionByName(hits, allowMissingColumns=True).unionByName(rare.repartition(fine, "row"), allowMissingColumns=True)
    total = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("copies").alias("copies"), *[F.sum(c).cast("long").alias(c) for c in _COUNTS], F.collect_list(F.struct("pos", F.col("groups").alias("text"))).alias("texts"))
    result = total.select("doc_id", *_COUNTS, _in_order(F.col("texts"), ";").alias("groups"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    none = mute.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in _COUNTS], F.lit("").alias("groups"))
    out = result.drop("_copy").union(none)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(spark, read(spark, sf_dir, "documents"))
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))).drop("groups")
