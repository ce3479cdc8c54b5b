"""Operator 7: near-duplicate texts by Order MinHash.

A text is its lower-case words; its k-mers are runs of words, each labelled
with its occurrence number. In each table the two smallest labelled k-mers
under a hash are taken and kept in text order; texts with the same two in the
same order share a bucket, so that the rate at which texts meet follows their
edit similarity. K-mers have five words, in more tables three, as edits that
are spread evenly leave few runs of five; short texts have k-mers of two words
or one. FAMILIES gives tables for each; ``missed`` calculates the chance that a
pair at SIMILARITY shares no bucket. Candidates are verified by banded
alignment of the whole word sequences; the classes are the connected
components of verified pairs.

Equal word sequences are one representative. First each text is aligned with
the one before it in its buckets of FIRST tables, which connects large groups
of copies at a linear cost. What is left then is compared whole: buckets that
hold several components are put together by the smallest of them, and in such
a meeting every pair of different components is aligned, unless their sizes,
word counts or shared word pairs and triples exclude it. No pair of a bucket is
given up, however many texts share its passage. A meeting of many texts is
parted into cells by size and into blocks, so a task holds two blocks; it
gives one link for components that it joins, not all pairs.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, joined_by_count, read, sized, small_batches, without_ids, written
from .words import POWERS, mixed, word_hashes

SIMILARITY = 0.8
#: (words of a k-mer, tables, least and most words of a text that has such keys): similar texts have a family in common.
FAMILIES = ((1, 24, 2, 12), (2, 36, 10, 64), (5, 48, 50, None), (3, 80, 50, None))
#: Tables of a family whose buckets are read for neighbours first.
FIRST = 12
#: Texts and words of a block of a meeting.
BLOCK, BLOCK_WORDS = 512, 4_000_000
#: Places of a text's word counts, least and most; bytes of them that are compared at once.
SKETCH, COUNTS = (32, 4096), 1 << 22
#: Candidates of a text from which they are aligned together, and words of a text up to which that is done.
TOGETHER = (24, 4096)
#: K-mers of a text times tables that are hashed at once.
CHUNK = 1 << 18
#: Edits up to which the alignment runs diagonal by diagonal; words up to which the rest of the band is kept in bits.
SCALAR, BITS = 12, 1 << 15
#: 32-bit seeds: the tables of a family are SEEDS[first : first + tables].
_SEEDS = (mixed(np.arange(1, 1 + sum(f[1] for f in FAMILIES), dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("u4")


def words_of(text: str | None) -> np.ndarray:
    if not text:
        return np.array([], "u8")
    return word_hashes(np.frombuffer(text.lower().encode("utf-8"), "u1"))[0]


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers in text order, each mixed with its occurrence number."""
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        if n < 1:
            h = np.array([(words * POWERS[: len(words)]).sum(dtype="u8")]) if len(words) else words
        else:
            h = words[:n].copy()
            for i in range(1, k):
                h += words[i : i + n] * POWERS[i]
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(h) else np.array([], bool)
        at = np.arange(len(h))
        number = np.empty(len(h), "u8")
        number[order] = at - np.maximum.accumulate(np.where(first, at, 0)) if len(h) else 0
        return mixed(h + number * np.uint64(0xC2B2AE3D27D4EB4F))


def order_keys(words: np.ndarray) -> np.ndarray:
    """The text's keys: the two smallest labelled k-mers of each table, in text order.

    A key's last bit tells whether its table is one of the FIRST. Memory stays
    under CHUNK numbers, however long the text. A k-mer alone is its own pair."""
    out, start = [], 0
    for k, tables, least, most in FAMILIES:
        if len(words) >= least and (most is None or len(words) <= most):
            g = labelled_kmers(words, k)
            low = (g >> np.uint64(32)).astype("u4")
            step = max(1, CHUNK // len(g))
            for t in range(0, tables, step):
                seeds = _SEEDS[start + t : start + min(t + step, tables)]
                v = (low[None, :] ^ seeds[:, None]) * (seeds[:, None] | np.uint32(1))
                a = v.argmin(axis=1)
                v[np.arange(len(a)), a] = 0xFFFFFFFF
                b = v.argmin(axis=1)
                with np.errstate(over="ignore"):
                    h = mixed(g[np.minimum(a, b)] + g[np.maximum(a, b)] * POWERS[1] + seeds.astype("u8") * np.uint64(0x9E3779B97F4A7C15))
                early = np.arange(t, t + len(seeds)) < FIRST
                out.append((h & ~np.uint64(1)) | early)
        start += tables
    return np.concatenate(out).view("i8") if out else np.array([], "i8")


def missed(n: int, similarity: float = SIMILARITY, spread: bool = False) -> float:
    """The chance that a text of n words and one at similarity (words replaced) share no bucket.

    The edits fall at random places or, with spread, at even distances, which
    is the worst case: each takes k of the n - k + 1 k-mers, and adds k."""
    edits = int((1 - similarity) * n + 1e-9)
    out = 1.0
    for k, tables, least, most in FAMILIES:
        own = n - k + 1
        if not least <= n <= (most or n) or own < 2:
            continue
        whole = float(np.prod([(n - edits - i) / (n - i) for i in range(k)]))
        shared = max(0.0, own - k * edits) if spread else own * whole
        union = 2 * own - shared
        out *= (1 - max(0.0, shared * (shared - 1)) / (union * (union - 1))) ** tables
    return out


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance in words (insert, delete, replace), None if over most.

    Furthest-reaching alignment in the band of most diagonals to each side:
    reach[k] is how far a gets on diagonal k with e edits. Most slides end at
    once; a long one is found by comparing arrays. Pairs that are further
    apart than SCALAR go through the band column by column."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return n + m
    x, y = a.tolist(), b.tolist()

    def slide(i: int, k: int) -> int:
        """From a[i], b[i + k] along equal words."""
        end = min(n, m - k)
        near = min(end, i + 16)
        while i < near and x[i] == y[i + k]:
            i += 1
        if i < near:
            return i
        while i < end:
            stop = min(end, i + 1024)
            differ = a[i:stop] != b[i + k : stop + k]
            at = int(differ.argmax())
            if differ[at]:
                return i + at
            i = stop
        return i

    goal, low = m - n, -(most + 2)
    none = -(n + m + 2)
    reach = [none] * (2 * most + 5)  # place k - low; places off the band are never reached
    reach[-low] = slide(0, 0)
    if goal == 0 and reach[-low] >= n:
        return 0
    for e in range(1, most + 1):
        if e > SCALAR and max(n, m) <= BITS:
            return _band_of_bits(x, y, most)
        if e > SCALAR:
            return _wide_band(a, b, np.array(reach), low, e, most, slide)
        new = [none] * len(reach)
        for k in range(max(-e, goal - (most - e)), min(e, goal + (most - e)) + 1):
            at = k - low
            best = max(reach[at] + 1, reach[at + 1] + 1, reach[at - 1])  # replace, delete from a, insert from b
            best = min(best, n, m - k)
            if best >= 0 and best + k >= 0:
                new[at] = slide(best, k) if best < n and best + k < m and x[best] == y[best + k] else best
        if new[goal - low] >= n:
            return e
        reach = new
    return None


def _band_of_bits(x: list[int], y: list[int], most: int) -> int | None:
    """The whole of ``distance``: a column of the band is two integers, whose bits are steps up or down between rows.

    What lies off the band is taken as one more than its neighbour inside,
    which no alignment within most edits needs."""
    n, m = len(x), len(y)
    places: dict[int, int] = {}
    wanted = set(y)
    for i, w in enumerate(x):
        if w in wanted:
            places[w] = places.get(w, 0) | 1 << i
    last = min(n, most)  # the lowest row of the band, from 1
    score, first = last, 0  # score: distance at the lowest row; first: rows above the band
    up, down = (1 << last) - 1, 0
    for j, w in enumerate(y, 1):
        if last < n:
            up |= 1 << (last - first)
            last += 1
            score += 1
        if j - most > first + 1:
            first += 1
            up >>= 1
            down >>= 1
        whole = (1 << (last - first)) - 1
        equal = (places.get(w, 0) >> first) & whole
        level = ((((equal & up) + up) ^ up) | equal | down) & whole
        right, left = down | (whole & ~(level | up)), level & up
        lowest = 1 << (last - first - 1)
        if right & lowest:
            score += 1
        elif left & lowest:
            score -= 1
        if last == n and score - (m - j) > most:
            return None
        right, left = (right << 1 | 1) & whole, (left << 1) & whole
        up, down = left | (whole & ~(level | right)), right & level
    return score if score <= most else None


def _wide_band(a: np.ndarray, b: np.ndarray, reach: np.ndarray, low: int, start: int, most: int, slide) -> int | None:
    """The rest of ``distance`` from start edits on: all diagonals of a step at once."""
    n, m = len(a), len(b)
    goal, none = m - n, -(n + m + 2)
    for e in range(start, most + 1):
        ks = np.arange(max(-e, goal - (most - e)), min(e, goal + (most - e)) + 1)
        if not len(ks):
            return None
        at = ks - low
        best = np.minimum(np.maximum(np.maximum(reach[at] + 1, reach[at + 1] + 1), reach[at - 1]), np.minimum(n, m - ks))
        new = np.full(len(reach), none)
        live = np.flatnonzero((best >= 0) & (best + ks >= 0))
        go = live[(best[live] < n) & (best[live] + ks[live] < m)]
        for _ in range(8):
            go = go[a[best[go]] == b[best[go] + ks[go]]]
            best[go] += 1
            go = go[(best[go] < n) & (best[go] + ks[go] < m)]
            if not len(go):
                break
        for i in go.tolist():
            best[i] = slide(int(best[i]), int(ks[i]))
        new[at[live]] = best[live]
        if new[goal - low] >= n:
            return e
        reach = new
    return None


def distances(a: np.ndarray, others: list[np.ndarray], most: int) -> np.ndarray:
    """Edit distance of a to each of others (sorted by length), exact where it is most or less, else over most.

    The band of ``distance`` for many pairs at once: 64 rows of a column are a
    number for each pair, and steps to the right are carried from one run of
    rows to the next; what lies off the band counts as one more."""
    n, lengths = len(a), np.array([len(b) for b in others])
    blocks = -(-n // 64)
    words, inverse = np.unique(a, return_inverse=True)
    at = np.arange(n)
    equal = np.zeros((blocks, len(words) + 1), "u8")
    np.bitwise_or.at(equal, (at >> 6, inverse), np.uint64(1) << (at & 63).astype("u8"))
    ids = np.full((int(lengths.max(initial=0)), len(others)), len(words), "i4")
    for j, b in enumerate(others):
        place = np.minimum(np.searchsorted(words, b), len(words) - 1)
        ids[: len(b), j] = np.where(words[place] == b, place, len(words))
    up, down = np.full((blocks, len(others)), np.uint64(2**64 - 1)), np.zeros((blocks, len(others)), "u8")
    one, top = np.uint64(1), np.uint64(63)
    first, last = 0, min(blocks - 1, most // 64)
    score = np.full(len(others), (last + 1) * 64)  # at the lowest row of the band
    out = np.full(len(others), most + 1)
    done = 0  # shorter texts have ended
    pad = np.uint64(2**64 - 1) << np.uint64(n % 64) if n % 64 else np.uint64(0)
    for c in range(1, len(ids) + 1):
        while last < blocks - 1 and (last + 1) * 64 < c + most:
            last += 1
            score += 64
        while first < last and (first + 1) * 64 < c - most:
            first += 1
        here = ids[c - 1, done:]
        right, left = one, np.uint64(0)
        for k in range(first, last + 1):
            u, d = up[k, done:], down[k, done:]
            e = equal[k][here]
            x = e | d
            e |= left
            level = (((e & u) + u) ^ u) | e
            r, l = d | ~(level | u), u & level
            r_out, l_out = r >> top, l >> top
            r, l = r << one | right, l << one | left
            up[k, done:], down[k, done:] = l | ~(x | r), r & x
            right, left = r_out, l_out
        score[done:] += right.astype("i8") - left.astype("i8")
        end = int(np.searchsorted(lengths, c, "right"))
        if end > done and last == blocks - 1:
            # rows below a's last are taken back
            out[done:end] = score[done:end] - np.bitwise_count(up[last, done:end] & pad) + np.bitwise_count(down[last, done:end] & pad).astype("i8")
        done = max(done, end)
        if done == len(others):
            break
    return out


def shared_grams(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """How many k-grams (with repeats) the two have in common."""
    if min(len(a), len(b)) < k:
        return 0
    grams = []
    for words in (a, b):
        h = words[: len(words) - k + 1].astype("u8")
        with np.errstate(over="ignore"):
            for i in range(1, k):
                h = h + words[i : i + len(h)] * POWERS[i]
        grams.append(h)
    _, place = np.unique(np.concatenate(grams), return_inverse=True)
    n = int(place.max()) + 1
    cut = len(grams[0])
    return int(np.minimum(np.bincount(place[:cut], minlength=n), np.bincount(place[cut:], minlength=n)).sum())


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length reaches similarity."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    # an edit takes away k k-grams of the longer text at most
    if any(shared_grams(a, b, k) < longer - k + 1 - k * most for k in (1, 2, 3)):
        return False
    return distance(a, b, most) is not None


_SIGNED = "doc_id long, key binary, size int, keys array<long>"


def _digest(words: np.ndarray, text: str | None) -> bytes:
    return blake2b(words.tobytes() if len(words) else (text or "").encode("utf-8") + b"\0", digest_size=16).digest()


def _sign(batches):
    for batch in batches:
        digests, sizes, keys = [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            digests.append(_digest(words, text))
            sizes.append(len(words))
            keys.append(order_keys(words) if len(words) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "key", "size", "keys"])


def _sequences(batches):
    for batch in batches:
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_digest(w, "") for w in words], pa.binary()), pa.array([w.astype("<u4").tobytes() for w in words], pa.binary())], ["doc_id", "key", "seq"])


def sequences(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, seq) of the texts of ids(doc_id); a doc_id with several texts has a row for each."""
    few = texts.join(sized(ids), "doc_id", "left_semi")
    return few.mapInArrow(_sequences, "doc_id long, key binary, seq binary").dropDuplicates(["doc_id", "key"]).select("doc_id", "seq")


def _align(similarity: float):
    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity) for x, y in zip(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(spark: SparkSession, texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose texts are similar."""
    ids = written(spark, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    seqs = written(spark, sequences(texts, ids), "sequences")
    full = pairs.join(seqs.select(F.col("doc_id").alias("b"), F.col("seq").alias("seq_b")), "b").join(seqs.select(F.col("doc_id").alias("a"), F.col("seq").alias("seq_a")), "a")
    return written(spark, full.select("a", "b", "seq_a", "seq_b").mapInArrow(_align(similarity), "a long, b long"), "verified")


_ROWS = "key long, doc_id long, size int, before long"


def _neighbours(similarity: float):
    """Sorted rows (key, size, doc_id) -> those that may share their key: a row next to them in this task has it, or they are its first or last.

    before: the row before, if it has the same key, is another and may be similar, in a FIRST table."""

    def run(batches):
        held, start = None, True
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if not rows.num_rows:
                continue
            n = rows.num_rows
            yield from pick(rows, 0 if held is None else held.num_rows - 1, n - 1, start, False)
            start = start and n == 1
            held = rows.slice(max(0, n - 2))
        if held is not None and held.num_rows:
            yield from pick(held, held.num_rows - 1, held.num_rows, start, True)

    def pick(rows: pa.Table, begin: int, end: int, start: bool, stop: bool):
        key, doc, size = (rows[c].to_numpy() for c in ("key", "doc_id", "size"))
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        take = same[:-1] | same[1:]
        if start:
            take[0] = True
        if stop:
            take[-1] = True
        at = np.flatnonzero(take[begin:end]) + begin
        if len(at):
            prev = np.maximum(at - 1, 0)
            near = same[at] & (key[at] & 1 == 1) & (doc[prev] != doc[at]) & (np.minimum(size[prev], size[at]) >= np.maximum(size[prev], size[at]) * similarity - 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(doc[at]), pa.array(size[at]), pa.array(doc[prev], mask=~near)], ["key", "doc_id", "size", "before"])

    return run


def sketches(seqs: list[np.ndarray], n: int) -> np.ndarray:
    """Counts of each text's words by hash in n places, 255 at most: an edit moves two of them by one at most."""
    return np.stack([np.minimum(np.bincount(s & np.uint32(n - 1), minlength=n), 255).astype("u1") for s in seqs])


class WordBags:
    """The words of texts with their counts, to count what one text shares with many."""

    def __init__(self, seqs: list[np.ndarray]):
        bags = [np.unique(s, return_counts=True) for s in seqs]
        self.starts = np.cumsum([0, *(len(u) for u, _ in bags)])
        words, self.flat = np.unique(np.concatenate([u for u, _ in bags]), return_inverse=True)
        self.counts = np.concatenate([c for _, c in bags]).astype("i4")
        self.dense = np.zeros(len(words), "i4")

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Words (with repeats) that text i has in common with each of others."""
        own = slice(self.starts[i], self.starts[i + 1])
        self.dense[self.flat[own]] = self.counts[own]
        out, n = [], self.starts[others + 1] - self.starts[others]
        ends = np.cumsum(n)
        at = 0
        while at < len(others):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTS, "right")))
            m, first = n[at:stop], np.cumsum(n[at:stop]) - n[at:stop]
            place = np.arange(m.sum()) + np.repeat(self.starts[others[at:stop]] - first, m)
            out.append(np.add.reduceat(np.minimum(self.dense[self.flat[place]], self.counts[place]), first))
            at = stop
        self.dense[self.flat[own]] = 0
        return np.concatenate(out)


def may_be_similar(size: np.ndarray, seqs: list[np.ndarray], component: np.ndarray, similarity: float):
    """Pairs (i, others j > i, nearest first) of texts sorted by size, of different components, that sizes and words don't exclude."""
    upto = np.searchsorted(size, (size / similarity + 1e-6).astype("i8"), "right")
    bags = WordBags(seqs)
    row = 0
    while row < len(size):
        # rows of about the same size share a length of word counts
        stop = max(row + 1, int(np.searchsorted(size, size[row] * 1.25, "right")))
        n = min(max(SKETCH[0], 1 << int(size[row]).bit_length()), SKETCH[1])
        counts = sketches(seqs[row : int(upto[stop - 1])], n)
        for i in range(row, stop):
            found = []
            for j in range(i + 1, int(upto[i]), max(1, COUNTS // n)):
                end = min(int(upto[i]), j + max(1, COUNTS // n))
                other = counts[j - row : end - row]
                moved = (np.maximum(other, counts[i - row]) - np.minimum(other, counts[i - row])).sum(axis=1, dtype="u4").astype("i8")
                most = ((1 - similarity) * size[j:end] + 1e-9).astype("i8")
                found.append(np.flatnonzero((component[j:end] != component[i]) & (moved + size[j:end] - size[i] <= 2 * most) & (size[j:end] - size[i] <= most)) + j)
            if found and len(others := np.concatenate(found)):
                # no alignment keeps more words than the texts share
                changed = size[others] - bags.shared(i, others)
                may = changed <= ((1 - similarity) * size[others] + 1e-9).astype("i8")
                if may.any():
                    yield i, others[may][np.argsort(changed[may], kind="stable")]
        row = stop


def _meet(similarity: float):
    """Rows sorted by group and size (group: leader, cell, low, high) -> a link (a, b) for components that a similar pair joins.

    Every pair of different components meets in the first meeting that both
    texts are in; of two blocks (low < high), rows of the same block have met
    elsewhere; rows that are not own are there to be met by smaller ones."""

    def links(rows: pa.Table):
        leader, apart = rows["leader"][0].as_py(), rows["low"][0].as_py() != rows["high"][0].as_py()
        doc, size, component, block, own = (rows[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "size", "component", "block", "own"))
        seqs = [np.frombuffer(x, "<u4") for x in rows["seq"].to_pylist()]
        leaders = [frozenset(x) for x in rows["leaders"].to_pylist()]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        size = size.astype("i8")
        for i, others in may_be_similar(size, seqs, component, similarity):
            if not own[i]:
                continue
            here = [j for j in others.tolist() if not (apart and block[i] == block[j]) and min(leaders[i] & leaders[j]) == leader and find(int(component[i])) != find(int(component[j]))]
            together = len(here) >= TOGETHER[0] and size[here[-1]] <= TOGETHER[1]
            if together:
                here.sort()
                most = ((1 - similarity) * size[here] + 1e-9).astype("i8")
                near = distances(seqs[i], [seqs[j] for j in here], int(most.max())) <= most
                here = [j for j, yes in zip(here, near) if yes]
            for j in here:
                x, y = find(int(component[i])), find(int(component[j]))
                if x != y and (together or similar(seqs[i], seqs[j], similarity)):
                    root[max(x, y)] = min(x, y)
                    yield int(doc[i]), int(doc[j])

    def run(batches):
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("leader", "cell", "low", "high")], axis=1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and name != tuple(group[start]):
                    yield from out(held)
                    held = []
                name = tuple(group[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from out(held)

    def out(held: list[pa.RecordBatch]):
        found = list(links(pa.Table.from_batches(held)))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def leaders_of(spark: SparkSession, placed: DataFrame, buckets: DataFrame) -> DataFrame:
    """placed(key, component, doc_id, size), buckets(key, leader, n) -> doc_id, component, size, leader of the texts' keys that are buckets.

    Texts that have a passage in common share many keys of one leader. So the
    largest bucket of each leader is joined first; a text's other keys give a
    row only if they lead to a leader that it doesn't have by then."""
    few, total = buckets.agg(F.count("*"), F.sum("n")).first()
    # if buckets are many, those of very many texts are broadcast and the others shuffled
    led = lambda rows, some: rows.join(F.broadcast(some), "key") if few <= BROADCAST_ROWS else joined_by_count(rows, some, "key", total)
    largest = written(spark, buckets.groupBy("leader").agg(F.max(F.struct("n", "key")).alias("_most")).select("_most.key", "leader", "_most.n"), "largest-buckets")
    first = written(spark, led(placed, largest).select("doc_id", "component", "size", "leader").distinct(), "first-leaders")
    known = first.groupBy("doc_id").agg(F.collect_set(F.struct("leader", "size")).alias("known"))  # one for each of a text's keys at most
    others = led(placed.join(known, "doc_id", "left"), buckets.join(sized(largest.select("key")), "key", "left_anti"))
    others = others.where(~F.coalesce(F.array_contains("known", F.struct("leader", "size")), F.lit(False)))
    return first.union(others.select(first.columns))


def _met(spark: SparkSession, texts: DataFrame, near: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the components of members, from all pairs of near(key, doc_id, size) that share a key."""
    placed = near.select("key", "doc_id", "size").join(sized(members.withColumnRenamed("node", "doc_id")), "doc_id", "left")
    placed = placed.select("key", F.coalesce("component", "doc_id").alias("component"), "doc_id", "size")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts_of = [F.bit_xor(F.xxhash64(F.lit(i), "doc_id")).alias(f"texts{i}") for i in (1, 2)]
    buckets = placed.groupBy("key").agg(F.min("component").alias("leader"), F.max("component").alias("last"), F.count("*").alias("n"), *texts_of).where("leader < last")
    # keys of the same texts, as of a long passage, are one bucket
    buckets = written(spark, buckets.groupBy("leader", "last", "n", "texts1", "texts2").agg(F.min("key").alias("key")).select("key", "leader", "n"), "buckets")
    every = leaders_of(spark, placed, buckets)
    meeting = every.groupBy("doc_id", "component").agg(F.max("size").alias("size"), F.collect_set("leader").alias("leaders"))
    meeting = written(spark, meeting, "meetings")  # a leader for each of a text's keys at most
    differ = F.min("component") < F.max("component")
    step = F.lit(float(np.log(1.01 / similarity)))  # similar texts are in one cell or the next
    rows = meeting.select("doc_id", "size", "component", "leaders", F.explode("leaders").alias("leader"))
    large = rows.groupBy("leader").agg(F.count("*").alias("n"), F.sum("size").alias("words")).where((F.col("n") > BLOCK) | (F.col("words") > BLOCK_WORDS))
    large = written(spark, large.select("leader", F.lit(True).alias("large")), "large-meetings")
    at = F.floor(F.log("size") / step).cast("int")
    cells = rows.join(sized(large), "leader", "left").withColumn("_at", F.when(F.col("large"), at).otherwise(0))
    cells = cells.withColumn("cell", F.explode(F.when(F.col("large"), F.array(F.col("_at"), F.col("_at") - 1)).otherwise(F.array(F.col("_at"))))).withColumn("own", F.col("cell") == F.col("_at")).drop("_at", "large")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_WORDS)).cast("int")
    counts = cells.groupBy("leader", "cell").agg(blocks.alias("blocks"), F.max("own").alias("any"), differ.alias("differ"))
    counts = written(spark, counts.where("any and differ").select("leader", "cell", "blocks"), "cells")
    seqs = sequences(texts, meeting.select("doc_id"))
    dealt = cells.join(sized(counts), ["leader", "cell"]).join(seqs, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ("leader", "cell", "low", "high")
    dealt = dealt.select("leader", "cell", F.least("block", "_with").alias("low"), F.greatest("block", "_with").alias("high"), "block", "doc_id", "size", "component", "own", "leaders", "seq")
    return written(spark, dealt.repartition(n, *group).sortWithinPartitions(*group, "size", "doc_id").mapInArrow(_meet(similarity), "a long, b long"), "met")


def _joined(spark: SparkSession, members: DataFrame, links: DataFrame) -> DataFrame:
    """members(node, component) with the components that links(a, b) join put together: only those are put together again."""
    at = lambda c: members.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(spark, between).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    direct = members.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    alone = joined.join(members.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("joined").alias("component"))
    return direct.union(alone)


def near_classes(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id (the smallest doc_id of its class), kept.

    Texts of the same words are in one class; so are texts without a word that
    are equal (null counts as empty). Texts of under five words are in a class
    only with texts of the same words: they allow no edit. Very long texts are
    compared whole. Rows without a doc_id are classes of their own. Rows that
    share a doc_id are one node, with the links of each of its texts. Other
    columns are ignored; an empty table gives an empty result."""
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = texts.where("doc_id is not null")
    signed = written(spark, named.mapInArrow(_sign, _SIGNED), "signatures")
    copies = written(spark, signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("key", "rep"), "same-words")
    reps = signed.join(sized(copies), "key", "left").where("rep is null or rep = doc_id")
    keys = reps.select(F.explode("keys").alias("key"), "size", "doc_id")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ("key", "size", "doc_id")
    near = written(spark, keys.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(similarity), _ROWS), "neighbours")

    pairs = written(spark, near.where("before is not null").select(F.least("doc_id", "before").alias("a"), F.greatest("doc_id", "before").alias("b")).distinct(), "pairs")
    members = written(spark, connected_components(spark, _verified(spark, named, pairs, similarity)), "members")
    members = _joined(spark, members, _met(spark, named, near, members, similarity))

    one = signed.select("doc_id", "key").join(sized(copies), "key", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    joined = one.join(members.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    out = joined.union(texts.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class; rows without a doc_id stay."""
    gone = near_classes(spark, docs, similarity).where("not kept").select("doc_id")
    return without_ids(docs, written(spark, gone, "near-copies"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark, read(spark, sf_dir, "documents"))
