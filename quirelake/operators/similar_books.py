"""Recommendations for one book: those of the library that are like it."""

from __future__ import annotations

import math
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import nearest
from .joins import NO_AUTHOR
from .nearest import Best, best_of_blocks, packed, repacked, rounded
from .recommend import SIGNALS

#: A title that holds the other gives a score of so much at least; books in a result.
CONTAINED, MOST = 0.40, 10
#: Letters that a title needs for its containment to count.
LEAST_TITLE = 2
#: Array columns of which the common words count.
WORDS = ("tags", "title_words", "description_words")
#: A tag that one in so many books has is held as a row of zeros and ones; books in which a first bound is sought; what rounding may be off; less than any score.
OFTEN, TRIED, SLACK, TINY = 16, 2048, 2e-6, 5e-7
#: Seeds of a group at most, and places of their words, unless one seed has more.
GROUP, HITS = 32, 1 << 17
#: Blocks are so many times those of dense matrices, as no matrix of pairs is made; rows of a task's first block, which gives
#: later ones their bounds; blocks of books in a task at most; tasks for each core at least.
WIDE, FIRST, BLOCKS, TASKS = 8, 4096, 32, 4


def _prepared(books: DataFrame, seeds: DataFrame, keywords: DataFrame) -> DataFrame:
    """asked (false for books, true for seeds), id, author and title (null where they don't count), and the arrays as hashes; keywords with weights by ln(1 + df)."""
    # counted in the one shuffle that deals the keywords out, so that texts are read for them once
    df = F.count("*").over(Window.partitionBy("keyword"))
    weighed = keywords.where("keyword is not null").select(F.col("book_id").alias("id"), F.xxhash64("keyword").alias("contents"), (F.col("weight") * s.collection_weight(df)).alias("w"))
    listed = weighed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("contents", "w"))).alias("_k"))
    author, title = F.lower(F.trim("author")), F.lower(F.trim("title"))
    arrays = [F.transform(F.array_distinct(F.coalesce(c, F.array())), lambda x: F.xxhash64(x)).alias(c) for c in WORDS]
    columns = [F.col("id").cast("long").alias("id"), F.when(~F.trim("author").isin("", NO_AUTHOR[0]), author).alias("author"), F.when(F.length(title) >= LEAST_TITLE, title).alias("title"), *arrays]
    named = [df.where("id is not null").select(F.lit(asked).alias("asked"), *columns) for asked, df in ((False, books), (True, seeds))]
    return named[0].union(named[1]).join(listed, "id", "left").select("asked", "id", "author", "title", *WORDS, F.col("_k.contents").alias("contents"), F.col("_k.w").alias("w"))


class _Words:
    """An array column of a block, row by row: how many words a row has, where they end, and the words' numbers."""

    def __init__(self, column):
        self.n = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype("i8")
        self.end = np.cumsum(self.n)
        words = pc.list_flatten(column).to_numpy()
        self.by_word = np.argsort(words, kind="stable")
        words = words[self.by_word]
        new = np.ones(len(words), bool)
        np.not_equal(words[1:], words[:-1], out=new[1:])
        self.known, self.word = words[new], np.empty(len(words), "i8")
        self.word[self.by_word] = np.cumsum(new) - 1

    def of(self, row: int) -> np.ndarray:
        return self.word[self.end[row] - self.n[row] : self.end[row]]


class _Postings:
    """The same column, word by word: the rows that have it, in order."""

    def __init__(self, words: _Words):
        self.rows = np.repeat(np.arange(len(words.n)), words.n)[words.by_word]
        self.end = np.cumsum(np.bincount(words.word, minlength=len(words.known)))
        self.start = np.concatenate([[0], self.end[:-1]]).astype("i8")
        self.known = words.known

    def places(self, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of another block its number here, and where its rows begin and end; both 0 if it isn't here."""
        if not len(self.known):
            return (np.zeros(len(words.known), "i8"),) * 3
        place = np.minimum(np.searchsorted(self.known, words.known), len(self.known) - 1)
        here = self.known[place] == words.known
        return place, np.where(here, self.start[place], 0), np.where(here, self.end[place], 0)


class _Block:
    """Books in the order in which authors first come, then by how many tags they have."""

    def __init__(self, table):
        author = pc.fill_null(table["author"], "").combine_chunks().dictionary_encode()
        tags, code = pc.fill_null(pc.list_value_length(table["tags"]), 0).to_numpy(), author.indices.to_numpy()
        order = np.lexsort((tags, code))
        table = table.take(order)
        self.ids, self.code, self.authors, self._title = table["id"].to_numpy(), code[order], [a or None for a in author.dictionary.to_pylist()], table["title"]
        self.arrays = [_Words(table[c].combine_chunks()) for c in WORDS]
        self.contents, self.w = _Words(table["contents"].combine_chunks()), pc.list_flatten(table["w"].combine_chunks()).to_numpy()

    @cached_property
    def author(self) -> list[str | None]:
        return [self.authors[c] for c in self.code.tolist()]

    @cached_property
    def title(self) -> list[str | None]:
        return self._title.to_pylist()

    @cached_property
    def tags(self) -> list[bytes]:
        """A name for each book's set of tags."""
        return [np.sort(self.arrays[0].of(i)).tobytes() for i in range(len(self.ids))]

    @cached_property
    def order(self) -> list[int]:
        """Books of the same tags, then author, are neighbours."""
        return sorted(range(len(self.ids)), key=lambda i: (self.tags[i], self.author[i] or ""))

    @cached_property
    def titles(self) -> _Titles:
        return _Titles(self.title, range(len(self.ids)))

    @cached_property
    def index(self) -> _Index:
        return _Index(self)


class _Index:
    """What is asked of a block of books for each seed."""

    def __init__(self, block: _Block):
        n = len(block.ids)
        self.postings = [_Postings(x) for x in (*block.arrays, block.contents)]
        self.sizes = [x.n.astype("f8") for x in block.arrays]
        tags, contents = self.postings[0], self.postings[3]
        self.often = {int(a): np.bincount(tags.rows[a:b], minlength=n).astype("u1") for a, b in zip(tags.start, tags.end) if b - a > n // OFTEN}
        self.weights = block.w[block.contents.by_word]
        # word and row of each place of contents as one ascending number
        self.order = np.repeat(np.arange(len(contents.known)), contents.end - contents.start) * n + contents.rows
        # by author (tags, first, last): books of so many tags are neighbours
        self.spans: dict[str | None, list[tuple[int, int, int]]] = {}
        edges = [0, *(1 + np.flatnonzero((np.diff(block.code) != 0) | (np.diff(block.arrays[0].n) != 0))).tolist(), n]
        for i, j in zip(edges, edges[1:]):
            self.spans.setdefault(block.authors[block.code[i]], []).append((int(block.arrays[0].n[i]), i, j))
        self.authors = {a: (spans[0][1], spans[-1][2]) for a, spans in self.spans.items() if a is not None}
        self.by_id = {a: first + np.argsort(block.ids[first:last], kind="stable") for a, (first, last) in self.authors.items()}
        self.sorted_ids = np.sort(block.ids)


class _Titles:
    def __init__(self, titles: list, rows):
        self.titles: dict[str, list[int]] = {}
        for i in rows:
            if titles[i] is not None:
                self.titles.setdefault(titles[i], []).append(i)
        self.lengths: dict[int, list[str]] = {}
        for x in self.titles:
            self.lengths.setdefault(len(x), []).append(x)

    def within(self, other: _Titles):
        """(rows of self, rows of other) of which the ones' title is a part of the others', or the same."""
        for n, short in self.lengths.items():
            for m, long in other.lengths.items():
                if m == n:
                    pairs = [(x, x) for x in short if x in other.titles]
                elif m > n and len(short) <= m - n:
                    pairs = [(x, y) for x in short for y in long if x in y]
                elif m > n:
                    known = set(short)
                    pairs = [(x, y) for y in long for x in {y[i : i + n] for i in range(m - n + 1)} & known]
                else:
                    continue
                yield from ((self.titles[x], other.titles[y]) for x, y in pairs)


def _meet(seeds: _Block, books: _Block, best: Best) -> None:
    """The best books of a block for each seed of another, added to best.

    A book's score is bounded by that of tags and author with, if a word of
    title or description is common, that of both, and what contents can add.
    Only books of which this reaches the last of the best so far are scored in
    full. Seeds are taken in groups, whose common words are found together."""
    meeting = _Meeting(seeds, books, best)
    before = best.score.copy(), best.id.copy()
    meeting.run(seeds.order, None)
    # a title that holds the other changes nothing above CONTAINED
    late = [i for i in np.flatnonzero(best.score[:, -1] <= CONTAINED).tolist() if seeds.title[i] is not None]
    if late:
        titles, held = _Titles(seeds.title, late), {}
        for mine, its in chain(titles.within(books.titles), ((i, j) for j, i in books.titles.within(titles))):
            for i in mine:
                held.setdefault(i, []).append(its)
        again = list(held)
        best.score[again], best.id[again] = before[0][again], before[1][again]
        meeting.run([i for i in seeds.order if i in held], {i: np.unique(np.concatenate(lists)) for i, lists in held.items()})


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them) of each."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Meeting:
    def __init__(self, seeds: _Block, books: _Block, best: Best):
        x = books.index
        self.seeds, self.books, self.best, self.n = seeds, books, best, len(books.ids)
        self.shift = max(1, (self.n - 1).bit_length())
        self.places = [p.places(w) for p, w in zip(x.postings, (*seeds.arrays, seeds.contents))]
        self.own = np.searchsorted(x.sorted_ids, seeds.ids, "right") - np.searchsorted(x.sorted_ids, seeds.ids, "left")
        self.total = np.maximum(np.bincount(np.repeat(np.arange(len(seeds.ids)), seeds.contents.n), seeds.w, len(seeds.ids)), 1e-9)
        span = np.array([x.authors.get(a, (0, 0)) for a in seeds.author])
        self.first, self.last = span[:, 0], span[:, 1]
        self.both = np.zeros((GROUP, self.n), "u1" if max(seeds.arrays[0].n) < 256 else "i4")
        self.local = np.full(len(books.contents.known), -1)

    def hits(self, signal: int) -> np.ndarray:
        """For each seed, how many places of its words there are in the block."""
        words, (_, start, end) = (*self.seeds.arrays, self.seeds.contents)[signal], self.places[signal]
        return np.bincount(np.repeat(np.arange(len(words.n)), words.n), (end - start)[words.word], len(words.n))

    def run(self, order: list[int], held: dict[int, np.ndarray] | None) -> None:
        weight = 1 + sum(self.hits(s) for s in (1, 2, 3))
        group, n = [], 0
        for i in order:
            if group and (len(group) == GROUP or n + weight[i] > HITS):
                self.meet(np.array(group), held)
                group, n = [], 0
            group.append(i)
            n += weight[i]
        if group:
            self.meet(np.array(group), held)

    def common(self, g: np.ndarray, signal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word of each seed of g that the block has: which of g, place of the word among the seeds' words, number among the block's, and rows from and to."""
        words, (number, start, end) = (*self.seeds.arrays, self.seeds.contents)[signal], self.places[signal]
        at = _ragged(words.end[g] - words.n[g], words.n[g])
        word, which = words.word[at], np.repeat(np.arange(len(g)), words.n[g])
        here = end[word] > start[word]
        word = word[here]
        return which[here], at[here], number[word], start[word], end[word]

    def meet(self, g: np.ndarray, held: dict[int, np.ndarray] | None) -> None:
        seeds, books, x, n, shift, best = self.seeds, self.books, self.books.index, self.n, self.shift, self.best
        sizes = [a.n[g].astype("f8") for a in seeds.arrays]
        first, last = self.first[g], self.last[g]
        line = self.tags(g)  # of both, by seed
        least = best.score[g, -1]
        for j in np.flatnonzero(least == -np.inf).tolist():
            least[j] = self.bound(self.both[line[j]], sizes[0][j], first[j], last[j], best.k + self.own[g[j]])
        least -= SLACK
        # books of another author without a common word in title or description can't reach the best
        alone = least > SIGNALS[0] * (sizes[0] > 0) + SIGNALS[4]
        flat = self.both.reshape(-1)

        def plain(which: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """The score by tags and author."""
            y = flat.take(line[which] * n + rows).astype("f8")
            return SIGNALS[0] * (y / np.maximum(sizes[0][which] + x.sizes[0].take(rows) - y, 1)) + SIGNALS[1] * ((rows >= first[which]) & (rows < last[which]))

        # pairs as (seed, row, kind): a common word of the title is 0, one of the description 1, a title that holds the other 2
        pairs = []
        for kind, signal in enumerate((1, 2)):
            which, _, _, start, end = self.common(g, signal)
            which, rows = np.repeat(which, end - start), x.postings[signal].rows[_ragged(start, end - start)]
            keep = plain(which, rows) >= least[which] - sum(SIGNALS[2:])
            pairs.append((((which[keep] << shift) + rows[keep]) << 2) + kind)
        if held is not None:
            pairs += [(((j << shift) + held[i]) << 2) + 2 for j, i in enumerate(g.tolist())]
        pairs = np.sort(np.concatenate(pairs))
        key, kind = pairs >> 2, pairs & 3
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        near = key[begin]
        which, rows = near >> shift, near & ((1 << shift) - 1)
        score = plain(which, rows)
        counts = [np.add.reduceat(kind == c, begin, dtype="i8") if len(begin) else begin for c in (0, 1, 2)]
        for signal in (1, 2):
            y = counts[signal - 1]
            score += SIGNALS[signal + 1] * (y / np.maximum(sizes[signal][which] + x.sizes[signal].take(rows) - y, 1))
        inside = counts[2] > 0
        keep = (score >= least[which] - SIGNALS[4]) | inside
        found, score, inside = near[keep], score[keep], inside[keep]
        which, rows = found >> shift, found & ((1 << shift) - 1)
        own, at, number, start, end = self.common(g, 3)
        score += SIGNALS[4] * np.minimum(1.0, self.contents(rows, which, own, at, number, len(g)) / self.total[g[which]])

        # books that have only contents in common; of seeds that are alone, only those of their author
        lone = np.flatnonzero(alone[own])
        start[lone] = np.searchsorted(x.order, number[lone] * n + first[own[lone]])
        end[lone] = np.searchsorted(x.order, number[lone] * n + last[own[lone]])
        place, far, weight = _ragged(start, end - start), np.repeat(own, end - start), np.repeat(seeds.w[at], end - start)
        far_rows = x.postings[3].rows[place]
        base = plain(far, far_rows)
        keep = np.flatnonzero(base >= least[far] - SIGNALS[4])
        far = (far[keep] << shift) + far_rows[keep]
        order = np.argsort(far, kind="stable")
        far, keep = far[order], keep[order]
        begin = np.flatnonzero(np.diff(far, prepend=-1))
        hit = np.add.reduceat(weight[keep] * x.weights[place[keep]], begin) if len(begin) else np.empty(0)
        far, base = far[begin], base[keep[begin]]
        base += SIGNALS[4] * np.minimum(1.0, hit / self.total[g[far >> shift]])
        keep = base >= least[far >> shift]
        if len(near):
            keep &= near[np.minimum(np.searchsorted(near, far), len(near) - 1)] != far
        far = far[keep]
        found, score, inside = np.concatenate([found, far]), np.concatenate([score, base[keep]]), np.concatenate([inside, np.zeros(len(far), bool)])
        which, rows = found >> shift, found & ((1 << shift) - 1)
        score[inside] = np.maximum(score[inside], CONTAINED)
        keep = score >= least[which]
        self.add(g, which[keep], rows[keep], score[keep])

        # books without a common word
        found, mine = np.sort(found), np.bincount(which, minlength=len(g))
        least, lists = np.maximum(least, best.score[g, -1] - SLACK), []
        for j, i in enumerate(g.tolist()):
            lists += [(j << shift) + rows for rows in self.without(self.both[line[j]], int(sizes[0][j]), seeds.author[i], float(least[j]), best.k + int(self.own[i] + mine[j]))]
        if lists:
            rest = np.concatenate(lists)
            if len(found):
                rest = rest[found[np.minimum(np.searchsorted(found, rest), len(found) - 1)] != rest]
            which, rows = rest >> shift, rest & ((1 << shift) - 1)
            self.add(g, which, rows, plain(which, rows))

    def contents(self, rows: np.ndarray, which: np.ndarray, own: np.ndarray, at: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        """Sums of products of weights of pairs of a row and one of n seeds; own, at and number are ``common``'s."""
        known, local = np.unique(number, return_inverse=True)
        weights = np.zeros((n, max(1, len(known))))
        weights[own, local] = self.seeds.w[at]
        self.local[known] = np.arange(len(known))
        words = self.books.contents
        at = _ragged(words.end[rows] - words.n[rows], words.n[rows])
        local = self.local.take(words.word.take(at)) if len(at) else at
        here = np.flatnonzero(local >= 0)
        pair = np.repeat(np.arange(len(rows)), words.n[rows])[here]
        self.local[known] = -1
        return np.bincount(pair, weights[which[pair], local[here]] * self.books.w[at[here]], len(rows))

    def tags(self, g: np.ndarray) -> np.ndarray:
        """The numbers of common tags of each book go to a line of both for each set of tags; which line is a seed's."""
        tags, (_, starts, ends), x, line, key = self.seeds.arrays[0], self.places[0], self.books.index, -1, None
        lines = []
        for i in g.tolist():
            if key != self.seeds.tags[i]:
                key, line = self.seeds.tags[i], line + 1
                both = self.both[line]
                both.fill(0)
                for w in tags.of(i).tolist():
                    a, b = int(starts[w]), int(ends[w])
                    if b > a and a in x.often:
                        np.add(both, x.often[a], out=both)
                    elif b > a:
                        both[x.postings[0].rows[a:b]] += 1
            lines.append(line)
        return np.array(lines)

    def bound(self, both: np.ndarray, size: float, first: int, last: int, k: int) -> float:
        """What k books of some reach by tags and author."""
        step = max(1, self.n // TRIED)
        y = both[::step].astype("f8")
        tried = SIGNALS[0] * (y / np.maximum(self.books.index.sizes[0][::step] + size - y, 1))
        tried[-(-first // step) : -(-last // step)] += SIGNALS[1]
        return float(np.partition(tried, len(tried) - k)[len(tried) - k]) if len(tried) >= k else -np.inf

    def without(self, both: np.ndarray, size: int, author: str | None, least: float, k: int):
        """Rows of which tags and author alone reach least, and more than nothing; of those of the author alone the k of least id."""
        x = self.books.index
        if author in x.authors and (reach := least - SIGNALS[1]) <= SIGNALS[0]:
            if reach <= 0:
                rows = x.by_id[author]
                yield rows[both.take(rows) == 0][:k] if size else rows[:k]
            yield from self._within(both, size, x.spans[author], max(reach, TINY))
        if size and least <= SIGNALS[0]:
            for name, spans in x.spans.items():
                if name is None or name != author:
                    yield from self._within(both, size, spans, max(least, TINY))

    def _within(self, both: np.ndarray, size: int, spans: list[tuple[int, int, int]], reach: float):
        for n, first, last in spans:
            # common / (size + n - common) * SIGNALS[0] >= reach
            common = max(1, math.ceil(reach * (size + n) / (SIGNALS[0] + reach) - 1e-9))
            if common <= min(size, n) and len(rows := np.flatnonzero(both[first:last] >= common)):
                yield first + rows

    def add(self, g: np.ndarray, which: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        score, q = rounded(score), g[which]
        keep = (score > TINY) & (self.books.ids[rows] != self.seeds.ids[q])
        self.best.put(q[keep], score[keep], self.books.ids[rows[keep]])


def single_book(books: DataFrame, keywords: DataFrame, seeds: DataFrame, most: int = MOST, counts: tuple[int, int] | None = None) -> DataFrame:
    """books and seeds (id, title, author, tags, title_words, description_words), keywords(book_id, keyword, weight)
    -> seed, id, score, rank: the ``most`` best of each seed, ties by id.

    The score has five signals (tags, author, title, description, contents) by
    their weights; a title that holds the other makes it CONTAINED at least.
    Words are compared by their 64-bit hashes. Every seed meets every book, in
    blocks; no row is made for a pair, and only pairs that may be among the
    best are scored in full. Null arrays count as empty, null texts as '';
    rows without an id are left out. counts: how many books and seeds there
    are at most, if that is known."""
    n, asked = counts or (books.count(), seeds.count())
    rows, queries = WIDE * nearest.ROWS, WIDE * nearest.QUERIES
    tasks = TASKS * books.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // (BLOCKS * rows)), math.isqrt(tasks // 4))
    asked_parts = max(-(-asked // queries), -(-tasks // parts))
    # books and seeds come from one shuffle, so what is before it runs once; Python parts them. The key isn't that of the
    # join before it, or Spark would leave the shuffle out and run the join for each pair of partitions
    both = _prepared(books, seeds, keywords).repartition(parts, F.xxhash64("id"))
    # small blocks of seeds, so that they are dealt out evenly
    dealt = repacked(packed(both, min(queries, -(-asked // (8 * asked_parts)) or 1), "asked", True), queries, asked_parts).coalesce(asked_parts)
    found = best_of_blocks(dealt, packed(both, rows, "asked", False, FIRST).coalesce(parts), most, "shuffle_replicate_nl", _Block, _meet)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select(F.col("query_id").alias("seed"), "id", "score", rank.alias("rank"))
