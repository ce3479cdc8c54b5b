"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds its adjacent pairs by
merge rank and place. The lowest is popped again and again and, if both of its
symbols still stand, merged. The count is the initial symbols less the merges;
no identifier is ever emitted. Words repeat, so each Python worker keeps the
counts of words in a table of bounded size.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Words whose counts a worker keeps; the table starts anew beyond.
KEPT_WORDS = 1_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def merges_made(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """How many merges byte-pair encoding makes in one word.

    symbols: a number for each symbol; ranks: the merge rank of the pair
    left << 20 | right; merged: the symbol that the merge of a rank gives.
    A heap entry is rank << 32 | place of the left symbol."""
    n, get = len(symbols), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << 32 | i for i in range(n - 1) if (r := get(symbols[i] << 20 | symbols[i + 1])) is not None]
    heapify(heap)
    done = 0
    while heap:
        entry = heappop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j >= n or get(symbols[i] << 20 | symbols[j]) != rank:
            continue  # one of the two has been merged meanwhile
        new = symbols[i] = merged[rank]
        symbols[j] = 0xFFFFF  # no pair holds it
        k = after[i] = after[j]
        done += 1
        if k < n:
            before[k] = i
            if (r := get(new << 20 | symbols[k])) is not None:
                heappush(heap, r << 32 | i)
        if (k := before[i]) >= 0 and (r := get(symbols[k] << 20 | new)) is not None:
            heappush(heap, r << 32 | k)
    return done


#: Numbers beyond decimal digits: the fast word pattern would take them for letters.
_ODD_NUMBERS = frozenset(chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl"))
_SPACE = r"\t-\r \x85\xa0  -     　"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w{_SPACE}]|_)+")
_EXACT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def _unassigned() -> re.Pattern:
    """Characters that Python's tables don't know: the library's may, as letters, numbers or parts of others."""
    none = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    edges = [none[0], *(x for a, b in zip(none, none[1:]) if b != a + 1 for x in (a, b)), none[-1]]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(edges[::2], edges[1::2])) + "]")


class WordCounter:
    """Token counts as the tokenizer file's library gives them."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("a BPE file with word ends is needed")
        end, letters = model["end_of_word_suffix"], _byte_letters()
        number: dict[str, int] = {}
        of = lambda symbol: number.setdefault(symbol, len(number))
        self.inner, self.final = [of(c) for c in letters], [of(c + end) for c in letters]
        self.ranks, self.merged = {}, []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[of(left) << 20 | of(right)] = len(self.merged)
            self.merged.append(of(left + right))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str | bytes, int] = {}
        self.letter = {c: b for b, c in enumerate(letters)}
        self.unassigned, self.path, self.library = _unassigned(), path, None

    def _by_library(self, text: str) -> int:
        """Words as the library's own normaliser and word pattern give them, merged here."""
        if self.library is None:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_file(self.path)
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum(self.word(bytes(self.letter[c] for c in w)) for w, _ in words if w)

    def word(self, word: str | bytes) -> int:
        got = self.known.get(word)
        if got is None:
            raw = word.encode("utf-8") if isinstance(word, str) else word
            symbols = [self.inner[b] for b in raw]
            symbols[-1] = self.final[raw[-1]]
            got = len(raw) - merges_made(symbols, self.ranks, self.merged)
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = got
        return got

    def _plain(self, text: str) -> int:
        if not text.isascii():
            if self.unassigned.search(text):
                return self._by_library(text)
            # lower case letter by letter: a final sigma has no form of its own here
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        words = (_FAST if text.isascii() or not _odd(text) else _EXACT).findall(text)
        known, total = self.known, 0
        try:
            return sum([known[w] for w in words])
        except KeyError:
            for w in words:
                got = known.get(w)
                total += self.word(w) if got is None else got
            return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(self._plain(p) for p in parts if p) + len(parts) - 1


def _odd(text: str) -> bool:
    return not _ODD_NUMBERS.isdisjoint(set(text))


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def _counts(name: str, limit: int):
    def run(batches):
        words = counter(tokenizer_path(name))
        for batch in batches:
            tokens = [words.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, a row for each row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and rows
    without a doc_id are counted like any other; other columns are ignored; an
    empty table gives an empty result. The plan has no shuffle."""
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counts(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, read(spark, sf_dir, "documents"))
