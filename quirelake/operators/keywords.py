"""Keyword mining: counts, cohesion, neighbour entropy, fragments, scores, diversity.

Dictionaries (words with counts and parts of speech, stop words, surnames,
idioms, document frequencies) are tables or parameters. Counts are exact
aggregations with a HAVING; substring relations are equi-joins on generated
substrings, never nested loops."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import small_batches
from ..functions import scalars as s
from ..functions.text import CJK

#: Lengths of n-grams and words, least counts, cohesion, entropy, and how many keywords a book has.
LONGEST, LONGEST_WORD, LEAST, LEAST_NAME, PMI, PMI_TITLE, ENTROPY, KEPT, PENALTY = 6, 8, 3, 2, 3.0, 2.0, 1.5, 50, 0.6
#: Parts of speech that a keyword may have.
KINDS = ("n", "nr", "ns", "nt", "nz", "vn", "v", "a", "an")
#: Characters of function words.
FUNCTION = "的了得着过被把们吗呢吧啊呀嘛哦嗯呃哈嘎这那每各某我你他她它们没只但却将已不很更最太别再也就才在里中地上下前后内外间处于以向朝往对从由又却仍虽且若便即第个些种样其者等此彼何谁怎多少几哪和与及或而是到另俩两句未会还什么都让使叫给来去出进要应能可愿该用为"
#: Numerals, characters of dates, verbs that no name ends with, and fragments.
NUMERALS, DATES = "〇零一二三四五六七八九十百千万亿两", "月日年时号"
NOT_LAST = "做说问答听走吃喝拿打放坐站跑跳带送陪等跟找买卖谈聊唱写读学教睡醒道笑看想望叹惊怒哭喊"
FRAGMENTS = ("成一", "华面", "华阿")

#: Fixed value: words that count as keywords without a dictionary. Books of several rows up to which they are told apart by broadcast.
LONG_WORD, SEVERAL = "[a-z]{6,}", 200_000


@dataclass
class Lexicon:
    """Words with counts and parts of speech, and the word sets that filters need."""

    words: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    stop: frozenset[str] = frozenset()
    function: frozenset[str] = frozenset()
    idioms: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()

    @property
    def total(self) -> int:
        return max(1, sum(self.words.values()))


def cut(text: str, lexicon: Lexicon) -> list[str]:
    """Words of the most likely path through each Chinese run, and lower-case ASCII runs."""
    out: list[str] = []
    log_total = math.log(lexicon.total)
    for m in re.finditer(r"[A-Za-z0-9]+|[一-鿿㐀-䶿豈-﫿]+", text):
        run = m[0]
        if run[0].isascii():
            out.append(run.lower())
            continue
        best = [0.0] * (len(run) + 1)
        step = [1] * len(run)
        for i in range(len(run) - 1, -1, -1):
            options = [(math.log(lexicon.words[run[i : i + n]]) - log_total + best[i + n], -n) for n in range(1, min(LONGEST_WORD, len(run) - i) + 1) if run[i : i + n] in lexicon.words]
            score, n = max(options, default=(best[i + 1] - log_total, -1))
            best[i], step[i] = score, -n
        i = 0
        while i < len(run):
            out.append(run[i : i + step[i]])
            i += step[i]
    return out


def segmented(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """texts(book_id, text) -> book_id, word, n: counts of words in each book."""
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)  # a dictionary given as a parameter

    @F.pandas_udf("array<string>")
    def words(col: pd.Series) -> pd.Series:
        return col.map(lambda t: cut(t or "", sent.value))

    return texts.select("book_id", F.explode(words("text")).alias("word")).groupBy("book_id", "word").agg(F.count("*").alias("n"))


def short_text_keywords(text: str, lexicon: Lexicon) -> list[str]:
    """Distinct words of two characters or more that may be keywords, in order."""
    return [w for w in dict.fromkeys(cut(text, lexicon)) if len(w) >= 2 and w not in lexicon.stop and lexicon.kinds.get(w, "n") in KINDS]


def ngrams(texts: DataFrame, longest: int = LONGEST, pattern: str = f"{CJK}+") -> DataFrame:
    """texts(book_id, text) -> book_id, gram, left, right, times: each n-gram of each run, with its neighbours ("\\n" at an edge).

    A book's equal runs are one, cut once; times says how many they are."""
    runs = texts.select("book_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run")).groupBy("book_id", "run").agg(F.count("*").alias("times"))
    at = runs.select("book_id", "run", "times", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    sized = at.select("book_id", "run", "times", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("i") + 1))).alias("n"))
    edge = lambda c: F.when(c == "", "\n").otherwise(c)
    left = edge(F.when(F.col("i") == 1, "").otherwise(F.substring(F.col("run"), F.col("i") - 1, F.lit(1))))
    right = edge(F.substring(F.col("run"), F.col("i") + F.col("n"), F.lit(1)))
    return sized.select("book_id", F.substring(F.col("run"), F.col("i"), F.col("n")).alias("gram"), left.alias("left"), right.alias("right"), "times")


def _times(grams: DataFrame) -> Column:
    """How many grams the rows stand for: one each, unless they say so."""
    return F.sum("times") if "times" in grams.columns else F.count("*")


def gram_counts(grams: DataFrame, least: int = 1) -> DataFrame:
    return grams.groupBy("book_id", "gram").agg(_times(grams).alias("n")).where(F.col("n") >= least)


def cohesion(counts: DataFrame) -> DataFrame:
    """book_id, gram, n, pmi: the least PMI over all ways to split a gram in two; grams with an unseen part drop out."""
    total = counts.where(F.length("gram") == 1).groupBy("book_id").agg(F.sum("n").alias("_total"))
    parts = counts.where(F.length("gram") > 1).select("book_id", "gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    parts = parts.withColumn("a", F.substring(F.col("gram"), F.lit(1), F.col("k"))).withColumn("b", F.substring(F.col("gram"), F.col("k") + 1, F.lit(99)))
    seen = lambda name, n: counts.select("book_id", F.col("gram").alias(name), F.col("n").alias(n))
    joined = parts.join(seen("a", "na"), ["book_id", "a"]).join(seen("b", "nb"), ["book_id", "b"]).join(total, "book_id")
    scored = joined.groupBy("book_id", "gram", "n").agg(F.min(s.pmi(F.col("n"), F.col("_total"), F.col("na"), F.col("nb"))).alias("pmi"), F.count("*").alias("_k"))
    return scored.where(F.col("_k") == F.length("gram") - 1).drop("_k")


def neighbour_entropy(grams: DataFrame) -> DataFrame:
    """book_id, gram, and by side the entropy, the distinct neighbours and all of them."""
    out = None
    for side in ("left", "right"):
        by = grams.groupBy("book_id", "gram", side).agg(_times(grams).alias("c"))
        # the entropy of counts c with sum t is ln t - sum(c ln c) / t: one aggregation
        one = by.groupBy("book_id", "gram").agg((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias(f"{side}_entropy"), F.count("*").alias(f"{side}_distinct"), F.sum("c").alias(f"{side}_total"))
        out = one if out is None else out.join(one, ["book_id", "gram"])
    return out


def _inside(gram: Column, chars: str) -> Column:
    return gram.rlike(f"[{chars}]")


def is_title(gram: Column) -> Column:
    """X之Y, where no numeral follows."""
    return gram.rlike(f"^[^之]+之(?![{NUMERALS}]).")


def is_name(gram: Column, surnames: Iterable[str]) -> Column:
    """A surname and one or two more characters, the last not a verb's."""
    one, two = [x for x in surnames if len(x) == 1], [x for x in surnames if len(x) == 2]
    n = F.length(gram)
    return ~gram.rlike(f"[{NOT_LAST}]$") & ((n.between(2, 3) & F.left(gram, F.lit(1)).isin(one)) | (n.between(3, 4) & F.left(gram, F.lit(2)).isin(two)))


def new_words(texts: DataFrame, lexicon: Lexicon, words: DataFrame) -> DataFrame:
    """book_id, gram, n: words that the dictionary table words(word) lacks, by cohesion and free neighbours."""
    grams = ngrams(texts)
    counts = gram_counts(grams)
    g = F.col("gram")
    title, name = is_title(g), is_name(g, lexicon.surnames)
    known = words.select(F.col("word").alias("gram"))
    banned = sorted({*lexicon.stop, *lexicon.function, *lexicon.idioms, *FRAGMENTS})
    long = counts.where(F.length("gram").between(2, LONGEST) & ~g.isin(banned)).join(known, "gram", "left_anti")
    tail = words.where(F.length("word") >= 2).select(F.col("word").alias("_tail"), F.lit(True).alias("_fragment"))
    scored = long.join(cohesion(counts).select("book_id", "gram", "pmi"), ["book_id", "gram"], "left").withColumn("_tail", F.substring(g, 2, 99)).join(tail, "_tail", "left")
    edge = _inside(F.left(g, F.lit(1)), FUNCTION) | _inside(F.right(g, F.lit(1)), FUNCTION)
    date = g.rlike(f"^[{DATES}][{NUMERALS}]")
    fragment = F.coalesce("_fragment", F.lit(False)) & (F.length("gram") >= 3)
    fit = (
        F.when(title, ~edge & (F.col("n") >= LEAST) & (F.col("pmi") >= PMI_TITLE))
        .when(_inside(g, FUNCTION) | date, False)
        .when(name, F.col("n") >= LEAST_NAME)
        .otherwise((F.col("n") >= LEAST) & ~fragment & (F.col("pmi") >= PMI))
    )
    candidates = scored.where(F.coalesce(fit, F.lit(False))).select("book_id", "gram", "n")
    around = neighbour_entropy(grams.join(candidates.select("book_id", "gram"), ["book_id", "gram"], "left_semi"))
    free = (
        F.when(name, (F.col("left_distinct") >= 2) & (F.col("right_total") >= 1))
        .when(title, (F.col("left_total") >= 1) & (F.col("right_total") >= 1))
        .otherwise((F.col("left_total") >= 2) & (F.col("right_total") >= 2) & (F.least("left_entropy", "right_entropy") >= ENTROPY))
    )
    return candidates.join(around, ["book_id", "gram"]).where(free).select("book_id", "gram", "n")


def without_name_verbs(cands: DataFrame, surnames: Iterable[str]) -> DataFrame:
    """Without names of three characters or more whose start is a name three times as frequent."""
    name = is_name(F.col("gram"), surnames)
    prefix = cands.where(name).select("book_id", F.col("gram").alias("_p"), F.col("n").alias("_np"))
    long = cands.where(name & (F.length("gram") >= 3)).withColumn("_p", F.expr("left(gram, length(gram) - 1)"))
    gone = long.join(prefix, ["book_id", "_p"]).where("_np >= 3 * n").select("book_id", "gram")
    return cands.join(gone, ["book_id", "gram"], "left_anti")


def _proper_substrings(cands: DataFrame) -> DataFrame:
    n = F.length("gram")
    cut_ = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("gram"), i, k))))
    return cands.where(n > 1).select("book_id", F.col("gram").alias("whole"), F.col("n").alias("whole_n"), F.explode(F.array_distinct(cut_)).alias("gram"))


def without_substrings(cands: DataFrame, words: DataFrame) -> DataFrame:
    """Without a part of a longer one that is no more frequent, and without unlisted starts or ends at most twice as frequent as what they start or end."""
    pairs = _proper_substrings(cands).join(cands, ["book_id", "gram"])
    swallowed = pairs.where("n <= whole_n").select("book_id", "gram")
    sums = pairs.groupBy("book_id", "gram", "n").agg(F.sum(F.when(F.col("whole").startswith(F.col("gram")), F.col("whole_n"))).alias("starts"), F.sum(F.when(F.col("whole").endswith(F.col("gram")), F.col("whole_n"))).alias("ends"))
    part = sums.where("n <= 2 * starts or n <= 2 * ends").join(words.select(F.col("word").alias("gram")), "gram", "left_anti").select("book_id", "gram")
    return cands.join(swallowed.union(part).distinct(), ["book_id", "gram"], "left_anti")


def without_given_names(cands: DataFrame, surnames: Iterable[str]) -> DataFrame:
    """Without the given part of a full name, unless it is over twice as frequent."""
    two = [x for x in surnames if len(x) == 2]
    size = F.when(F.left("gram", F.lit(2)).isin(two), 2).otherwise(1)
    given = cands.where(is_name(F.col("gram"), surnames)).select("book_id", F.substring(F.col("gram"), size + 1, F.lit(99)).alias("gram"), F.col("n").alias("full_n")).where(F.length("gram") >= 2)
    gone = given.join(cands, ["book_id", "gram"]).where("n <= 2 * full_n").select("book_id", "gram").distinct()
    return cands.join(gone, ["book_id", "gram"], "left_anti")


def diverse(scored: Sequence[tuple[str, float]], most: int = KEPT) -> list[tuple[str, float]]:
    """Terms by score, less a penalty while they hold or are part of a chosen one; X之Y may hold one."""
    left, out = list(scored), []
    title = re.compile(f"^[^之]+之(?![{NUMERALS}]).")
    while left and len(out) < most:
        chosen = [t for t, _ in out]
        best = max(range(len(left)), key=lambda i: (left[i][1] - PENALTY * any(left[i][0] in c or (not title.match(left[i][0]) and c in left[i][0]) for c in chosen), -i))
        out.append(left.pop(best))
    return out


def ranked(scored: DataFrame, most: int = KEPT) -> DataFrame:
    """scored(book_id, keyword, score) -> book_id, keyword, weight, rank: diverse, weights by the largest within .05 and 1.

    Only the best few hundred of a book reach the sequential choice, which can't choose others: a penalty is PENALTY at most."""
    listed = scored.groupBy("book_id").agg(F.collect_list(F.struct("keyword", F.col("score").cast("double").alias("score"))).alias("_all"))
    bound = F.try_element_at(F.sort_array(F.transform("_all", lambda x: x["score"]), asc=False), F.lit(most)) - PENALTY
    fit = listed.withColumn("_least", bound).select("book_id", F.filter("_all", lambda x: F.col("_least").isNull() | (x["score"] >= F.col("_least"))).alias("_all"))

    def place(x: dict) -> tuple:
        """Descending scores, NaN first and null last, then keywords."""
        v = x["score"]
        return (2, 0.0, x["keyword"]) if v is None else (0, 0.0, x["keyword"]) if math.isnan(v) else (1, -v, x["keyword"])

    def choice(rows) -> list[dict]:
        picked = diverse([(x["keyword"], math.nan if x["score"] is None else x["score"]) for x in sorted(rows, key=place)], most)
        picked.sort(key=lambda x: -x[1])
        largest = max(picked[0][1], 1e-9) if picked else 1.0
        return [{"keyword": t, "weight": min(1.0, max(0.05, v / largest)), "rank": i} for i, (t, v) in enumerate(picked)]

    @F.pandas_udf("array<struct<keyword string, weight double, rank bigint>>")
    def choose(col: pd.Series) -> pd.Series:
        return col.map(choice)

    # a row for each book goes to Python, not a group
    return fit.select("book_id", F.inline(choose("_all")))


def _counted_keywords(texts: DataFrame, most: int) -> DataFrame:
    words = texts.select("book_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LONG_WORD), F.lit(0))).alias("keyword"))
    counts = words.groupBy("book_id", "keyword").agg(F.count("*").alias("n"))
    by = Window.partitionBy("book_id")
    rows = counts.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "keyword")) - 1).withColumn("weight", F.round(F.col("n") / F.max("n").over(by), 6))
    return rows.where(F.col("rank") < most).select("book_id", "keyword", "weight", "rank")


def most_frequent(counts: dict[str, int], most: int) -> list[tuple[str, int]]:
    """The most frequent words, then by the word; only those that are among them are sorted."""
    last = sorted(counts.values(), reverse=True)[most - 1] if 0 < most <= len(counts) else 0
    out = sorted((-n, w) for w, n in counts.items() if n > last)
    return [(w, -n) for n, w in out[:most]] + [(w, last) for w in sorted(w for w, n in counts.items() if n == last)[: most - len(out)]]


def simple_keywords(texts: DataFrame, most: int = 10) -> DataFrame:
    """texts(book_id, text) -> book_id, keyword, weight, rank: the most frequent long ASCII words.

    A book that is one row is counted where it is read; only rows that share
    a book_id (or have none) are counted through a shuffle of their words."""
    small_batches(texts.sparkSession)
    several = texts.groupBy("book_id").agg(F.count("*").alias("_rows")).where("_rows > 1 or book_id is null").select("book_id")
    n = several.limit(SEVERAL + 1).count()
    if n > SEVERAL:
        return _counted_keywords(texts, most)
    find = re.compile(LONG_WORD).findall

    @F.pandas_udf("array<struct<keyword string, n bigint>>")
    def top(col: pd.Series) -> pd.Series:
        return col.map(lambda t: most_frequent(Counter(find(t)), most) if t else [])

    one = texts.join(F.broadcast(several), "book_id", "left_anti").where("book_id is not null") if n else texts
    listed = one.select("book_id", top(F.lower("text")).alias("_top"))
    # the outer form, as the plain one has Spark call Python a second time in a filter for books without keywords
    rows = listed.select("book_id", "_top", F.posexplode_outer("_top").alias("rank", "_word")).where("rank is not null")
    rows = rows.select("book_id", F.col("_word.keyword").alias("keyword"), F.round(F.col("_word.n") / F.col("_top")[0]["n"], 6).alias("weight"), "rank")
    if not n:
        return rows
    key = F.col("texts.book_id").eqNullSafe(F.col("several.book_id"))
    rest = texts.alias("texts").join(F.broadcast(several).alias("several"), key, "left_semi")
    return rows.union(_counted_keywords(rest, most))


def mine(texts: DataFrame, lexicon: Lexicon, words: DataFrame, idf: DataFrame, df: DataFrame, median: float = 6.0) -> DataFrame:
    """Weighted keywords of each book.

    words(word), idf(word, idf) and df(word, df) are dictionary tables."""
    listed = segmented(texts, lexicon).where(F.col("n") >= LEAST)
    kinds = texts.sparkSession.createDataFrame(list(lexicon.kinds.items()) or [("", "")], "word string, kind string")
    banned = sorted({*lexicon.stop, *lexicon.function, *lexicon.idioms})
    known = listed.join(kinds, "word").where(F.col("kind").isin(*KINDS) & (F.length("word") >= 2) & ~F.col("word").isin(banned)).select("book_id", F.col("word").alias("gram"), "n")
    rescued = gram_counts(ngrams(texts), LEAST).join(words.select(F.col("word").alias("gram")), "gram", "left_anti").join(df.select(F.col("word").alias("gram")), "gram", "left_semi").where((F.length("gram") >= 2) & ~F.col("gram").isin(banned)).select("book_id", "gram", "n")
    every = known.unionByName(new_words(texts, lexicon, words)).unionByName(rescued).groupBy("book_id", "gram").agg(F.max("n").alias("n"))
    kept = without_given_names(without_substrings(without_name_verbs(every, lexicon.surnames), words), lexicon.surnames)
    scored = kept.withColumnRenamed("gram", "word").join(idf, "word", "left").join(df, "word", "left").join(kinds, "word", "left")
    score = F.col("n") * s.idf(F.col("idf"), F.when(F.col("df") > 0, F.col("df")), F.lit(median)) * s.pos_weight(F.col("kind"))
    return ranked(scored.select("book_id", F.col("word").alias("keyword"), score.alias("score")))


def missing(books: DataFrame, keywords: DataFrame) -> DataFrame:
    """Books that have no keyword yet."""
    return books.join(keywords.select("book_id").distinct(), "book_id", "left_anti")
