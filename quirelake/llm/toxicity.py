"""Operator 9: toxicity by a weighted finite-state pattern grammar.

Texts are read clause by clause. Five lexicon transducers read a word letter by
letter and write a symbol with a weight at its end: insult (learned stems, each
with a weight), threat, target, negation, reported speech. They run side by side
as one product. The clause transducer reads symbols; each of its paths assumes
at its start which of target, negation and speech the clause holds, sends the
weights of insults and threats to the features of that assumption, and is
accepted at the clause's end if the assumption has come true. So words before
and after an insult count alike, and of all paths one is accepted. ``compose``
puts lexicons and clause together. A logistic layer over the features of all
clauses gives the score: clauses are scored, not isolated words.

Stems and their weights, and the weights of the clause features, are learned
from labelled rows that are not held out. A text is first run through one
Aho-Corasick automaton of all stems and threats; clauses without a match can't
change the score and are skipped.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest_by_hash, read, small_batches, without_ids, written

#: Bounds of the training sample: labelled documents of each label.
SAMPLE = 6000
#: Stems kept at most, their letters, documents that must hold one, how much likelier toxic ones must be to (as a
#: logarithm), and the least log-likelihood ratio: rare stems that toxic documents hold by chance stay under it.
STEMS, SHORTEST, LONGEST, LEAST_DOCS, LEAST_ODDS, LEAST_RATIO = 4000, 4, 12, 3, 3.0, 30.0
PLAIN, TARGETED, NEGATED, REPORTED, THREAT, THREAT_TARGET = range(6)
FEATURES = 6
OTHER, INSULT, MENACE, TARGET, NEGATION, SPEECH = "OIMTNS"
_WORD = re.compile(r"\w+(?:['’]\w+)*|[\"“”«»„]")
_CLAUSE_END = re.compile(r"[.!?;\n]")
QUOTES = "\"“”«»„"
#: Closed word classes of the grammar, by symbol.
WORDS = {
    TARGET: "you your yours he his him she her they them their du dich dir dein deine ihr euch sie tu te toi ton ta vous votre vos il elle ils tú ti usted ustedes él ella ellos su sus".split(),
    NEGATION: "not no never none nobody cannot nicht kein keine keinen nie niemals pas jamais ne aucun nunca jamás ningún tampoco".split(),
    SPEECH: "said says say told claimed called wrote quoted according sagte sagt nannte behauptete dit disait affirme selon dijo dice llamó según".split(),
    MENACE: "kill hurt destroy beat murder shoot töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split(),
}
#: The end of a word, and what stands for any other letter or symbol.
END, ANY = "\0", None
_SAW = {TARGET: 1, NEGATION: 2, SPEECH: 4}


class Transducer:
    """Weighted arcs (state, input) -> [(output, weight, next state)]; an ANY arc serves inputs that have none of their own."""

    def __init__(self, starts: list):
        self.starts, self.arcs = starts, {}

    def arc(self, state, symbol, output, weight: float, to) -> None:
        self.arcs.setdefault((state, symbol), []).append((output, weight, to))

    def step(self, state, symbol) -> list:
        return self.arcs.get((state, symbol)) or self.arcs.get((state, ANY), [])

    def accepts(self, state) -> bool:
        return True


class Lexicon(Transducer):
    """Letters to a symbol at the word's end: for whole words, or for words that begin with an entry (the shortest counts)."""

    def __init__(self, symbol: str, entries: dict[str, float], begins: bool):
        super().__init__([""])
        held: dict[str, float | None] = {"": None}
        for word in sorted(entries, key=len):
            for n in range(1, len(word) + 1):
                if word[:n] not in held:
                    held[word[:n]] = held[word[: n - 1]] if begins else None
                    self.arc(word[: n - 1], word[n - 1], "", 0.0, word[:n])
            if held[word] is None:
                held[word] = entries[word]
        for state, weight in held.items():
            tail = ("tail", weight if begins else None)
            self.arc(state, ANY, "", 0.0, tail)
            self.arc(tail, ANY, "", 0.0, tail) if (tail, ANY) not in self.arcs else None
            for at, w in ((state, weight), (tail, tail[1])):
                if (at, END) not in self.arcs:
                    self.arc(at, END, OTHER if w is None else symbol, w or 0.0, "")


class SideBySide(Transducer):
    """Transducers that read the same letters; at a word's end the first that knows it gives the symbol."""

    def __init__(self, parts: list[Transducer]):
        super().__init__([tuple(p.starts[0] for p in parts)])
        self.parts = parts

    def step(self, state, symbol) -> list:
        got = [p.step(s, symbol)[0] for p, s in zip(self.parts, state)]
        output, weight = next(((o, w) for o, w, _ in got if o not in ("", OTHER)), (got[0][0] and OTHER, 0.0))
        return [(output, weight, tuple(to for _, _, to in got))]


class Clause(Transducer):
    """Symbols to features. State: (what the clause is assumed to hold, what it has held so far)."""

    def __init__(self):
        super().__init__([(assumed, 0) for assumed in range(8)])
        for assumed in range(8):
            insult = [REPORTED if assumed & 4 else NEGATED if assumed & 2 else PLAIN] + [TARGETED] * (assumed & 1)
            threat = [THREAT] + [THREAT_TARGET] * (assumed & 1)
            for saw in range(8):
                here = (assumed, saw)
                self.arc(here, INSULT, insult, 1.0, here)
                self.arc(here, MENACE, threat, 1.0, here)
                self.arc(here, ANY, [], 0.0, here)
                for symbol, bit in _SAW.items():
                    if assumed & bit:  # else the path ends: the assumption was that there is none
                        self.arc(here, symbol, [], 0.0, (assumed, saw | bit))
                    else:
                        self.arcs[here, symbol] = [(None, 0.0, None)]

    def accepts(self, state) -> bool:
        return state[0] == state[1]


class Composed(Transducer):
    """first's outputs are second's inputs; weights multiply. The arcs of a word are found letter by letter, once."""

    #: Words whose symbol is remembered.
    KEPT = 100_000

    def __init__(self, first: Transducer, second: Transducer):
        super().__init__(second.starts)
        self.first, self.second, self.known = first, second, {}

    def symbol(self, word: str) -> tuple[str, float]:
        got = self.known.get(word)
        if got is None:
            state = self.first.starts[0]
            for letter in word:
                ((_, _, state),) = self.first.step(state, letter)
            ((output, weight, _),) = self.first.step(state, END)
            if len(self.known) >= self.KEPT:
                self.known.clear()
            got = self.known[word] = (output, weight)
        return got

    def run(self, words: list[str]) -> dict:
        """Final state -> [(feature, weight)] of each accepted path."""
        paths = {state: [] for state in self.starts}
        for word in words:
            symbol, weight = (SPEECH, 1.0) if word in QUOTES else self.symbol(word)
            if symbol == OTHER:
                continue  # a loop without output in every state
            after = {}
            for state, told in paths.items():
                for features, w, to in self.second.step(state, symbol):
                    if to is not None:
                        after[to] = told + [(f, w * weight) for f in features]
            paths = after
        return {s: told for s, told in paths.items() if self.second.accepts(s)}


def compose(stems: dict[str, float]) -> Composed:
    ones = lambda k: dict.fromkeys(WORDS[k], 1.0)
    lexicons = [Lexicon(k, ones(k), False) for k in (TARGET, NEGATION, SPEECH)] + [Lexicon(MENACE, ones(MENACE), True), Lexicon(INSULT, stems, True)]
    return Composed(SideBySide(lexicons), Clause())


def words_in(clause: str) -> list[str]:
    """Words and quotation marks; n't is a negation, other words with an apostrophe are read in parts."""
    out: list[str] = []
    for m in _WORD.finditer(clause):
        parts = m[0].replace("’", "'").split("'")
        if len(parts) > 1 and parts[-1] == "t" and parts[-2].endswith("n"):
            out += [*parts[:-2], parts[-2][:-1], "not"]
        else:
            out += parts
    return [w for w in out if w]


class Grammar:
    """The composed transducer, and the layer over the features of clauses."""

    def __init__(self, stems: dict[str, float], layer: list[float]):
        import ahocorasick

        self.layer, self.machine = np.array(layer, "f8"), compose(stems)
        self.finder = ahocorasick.Automaton()
        for s in {*stems, *WORDS[MENACE]}:
            self.finder.add_word(s, len(s))
        self.finder.make_automaton()

    def clause(self, text: str, features: np.ndarray) -> None:
        """Add what the accepted path of one clause tells."""
        for told in self.machine.run(words_in(text)).values():
            for f, weight in told:
                features[f] += weight

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(FEATURES)
        if not text:
            return out
        low = text.lower()
        done = -1
        for end, n in self.finder.iter(low):
            start = end - n + 1
            if start < done or start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            ends = [low.rfind(c, 0, start) for c in ".!?;\n"]
            stop = _CLAUSE_END.search(low, end + 1)
            done = stop.start() if stop else len(low)
            self.clause(low[max(ends) + 1 : done], out)
        return out

    def evidence(self, text: str | None) -> np.ndarray:
        """The features, and the features for each hundred words: a long text holds a stray match or two."""
        f = self.features(text)
        return np.concatenate([f, f * (100 / (text.count(" ") + 1 if text else 1))])

    def score(self, text: str | None) -> float:
        x = self.layer[0] + float(np.log1p(self.evidence(text)) @ self.layer[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


@lru_cache(maxsize=2)
def grammar(model: str) -> Grammar:
    spec = json.loads(model)
    return Grammar(spec["stems"], spec["layer"])


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _count_stems(batches):
    """Documents of each label that hold a stem, counted within the task."""
    toxic: dict[str, int] = {}
    clean: dict[str, int] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            into = toxic if label else clean
            stems = {w[:n] for w in set(re.findall(r"[^\W\d_]+", text.lower())) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}
            for s in stems:
                into[s] = into.get(s, 0) + 1
    rows = list({*toxic, *clean})
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"stem": part, "toxic": [toxic.get(s, 0) for s in part], "clean": [clean.get(s, 0) for s in part]})


def likelihood_ratio(a: int, b: int, toxic: int, clean: int) -> float:
    """Twice the log-likelihood ratio of a toxic and b clean documents against chance."""
    share = toxic / (toxic + clean)
    return 2 * sum(x * math.log(x / ((a + b) * p)) for x, p in ((a, share), (b, 1 - share)) if x)


def choose_stems(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Stems with the logarithm of their odds as weight: of stems that begin each other, the one that tells most.

    What a stem tells is its toxic documents times its weight: a longer stem
    wins if it leaves clean words behind, a shorter one if it gathers more forms."""
    counts = [(s, a, b) for s, a, b in counts if likelihood_ratio(a, b, toxic, clean) >= LEAST_RATIO]
    odds = {s: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for s, a, b in counts}
    out: dict[str, float] = {}
    begun: set[str] = set()
    for s, _, _ in sorted(counts, key=lambda x: (-x[1] * odds[x[0]], len(x[0]), x[0])):
        if odds[s] >= LEAST_ODDS and s not in begun and not any(s[:n] in out for n in range(SHORTEST, len(s))):
            out[s] = odds[s]
            begun.update(s[:n] for n in range(SHORTEST, len(s)))
    return out


def fit_layer(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps; only negated and reported insults may count against toxicity."""
    x = np.hstack([np.ones((len(x), 1)), np.log1p(x)])
    free = [0]
    w = np.zeros(x.shape[1])
    free = list(range(x.shape[1]))
    for _ in range(x.shape[1]):
        w[:] = 0
        z = x[:, free]
        v = np.zeros(len(free))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
            h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.eye(len(free)) * 0.05
            step = np.linalg.solve(h, z.T @ (y - p) - 0.05 * v)
            v += step
            if np.abs(step).max() < 1e-6:
                break
        w[free] = v
        bad = [f for f in free if f and w[f] < 0 and (f - 1) % FEATURES not in (NEGATED, REPORTED)]
        if not bad:
            break
        free = [f for f in free if f not in bad]
    return w.tolist()


def _features_of(stems: dict[str, float]):
    def run(batches):
        g = Grammar(stems, [0.0] * (2 * FEATURES + 1))
        for batch in batches:
            got = [g.evidence(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(got, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> str:
    """The model, as JSON, from docs(doc_id, text) and labels(doc_id, toxic) that may be learned from."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = lambda label: lowest_by_hash(known.where(F.col("toxic") == label), "doc_id", SAMPLE)
    ids = written(spark, of(1).union(of(0)), "labelled")
    # a text for each document, of repeated rows the least: 2 * SAMPLE rows at most
    texts = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    texts = written(spark, texts, "labelled-texts")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return json.dumps({"stems": {}, "layer": [-3.0] + [1.0] * (2 * FEATURES)})
    stems = texts.mapInArrow(_count_stems, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEAST_DOCS)
    telling = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    # likelihood_ratio as a column: of the stems that pass both bounds the most telling, STEMS at most
    both = F.col("toxic") + F.col("clean")
    part = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (both * share))).otherwise(0.0)
    ratio = 2 * (part("toxic", n[1] / (n[1] + n[0])) + part("clean", n[0] / (n[1] + n[0])))
    top = stems.where((telling >= LEAST_ODDS) & (ratio >= LEAST_RATIO)).orderBy(ratio.desc(), "stem").limit(STEMS).collect()
    chosen = choose_stems([(r["stem"], r["toxic"], r["clean"]) for r in top], n[1], n[0])
    rows = texts.mapInArrow(_features_of(chosen), "toxic int, x array<double>").collect()  # 2 * SAMPLE rows at most
    y = np.array([r["toxic"] for r in rows], "f8")
    return json.dumps({"stems": chosen, "layer": fit_layer(np.array([r["x"] for r in rows]), y)})


def _scores(model: str):
    def run(batches):
        g = grammar(model)
        for batch in batches:
            got = [g.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted.

    Scores each row's whole text. A null or empty text has the score of a text
    without any matched clause. A document with labels 0 and 1 counts as
    toxic; labels without a doc_id, or other than 0 and 1, are left out. With
    no usable label of either kind all scores are under 0.5. Repeated rows get
    equal rows; a row without a doc_id is not held out; other columns are
    ignored; an empty table gives an empty result. Of a very long text every
    clause that holds a stem or a threat is read."""
    small_batches(spark)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(spark, rows, labels)
    return rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_scores(model), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic; rows without a doc_id stay."""
    bad = score(spark, docs, labels).where("predicted = 1 and doc_id is not null").select("doc_id")
    return without_ids(docs, written(spark, bad, "toxic"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
