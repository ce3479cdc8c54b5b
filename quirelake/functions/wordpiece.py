"""WordPiece ids by greedy longest match, and pooled vectors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of special pieces, the id of the unknown one if a vocabulary lacks it, and the longest input.
CLS, SEP, UNKNOWN, UNKNOWN_ID, LONGEST, LONGEST_WORD = "[CLS]", "[SEP]", "[UNK]", 100, 512, 100


def split_words(text: str) -> list[str]:
    """Lower case, accents off; Chinese characters and punctuation stand alone."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[一-鿿㐀-䶿豈-﫿]|[^\W_]+|[^\w\s]|_", re.sub(r"([一-鿿㐀-䶿豈-﫿])", r" \1 ", plain))


def encode(text: str, vocab: Mapping[str, int], longest: int = LONGEST) -> list[int]:
    unknown = vocab.get(UNKNOWN, UNKNOWN_ID)
    ids: list[int] = []
    for word in split_words(text):
        pieces, at = [], 0
        while at < len(word) and len(word) <= LONGEST_WORD:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
            if end is None:
                break
            pieces.append(vocab[("##" if at else "") + word[at:end]])
            at = end
        ids += pieces if at == len(word) else [unknown]
    return [vocab.get(CLS, 101), *ids[: longest - 2], vocab.get(SEP, 102)]


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the states under the mask, of unit length; (texts, tokens, size) -> (texts, size)."""
    m = mask[:, :, None].astype("f8")
    mean = (states * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.where(norm < 1e-9, mean, mean / np.maximum(norm, 1e-9))


def with_ids(texts: DataFrame, vocab: DataFrame, column: str = "text") -> DataFrame:
    """texts with token_ids; vocab(piece, id) is a vocabulary of bounded size, sent to each task once."""
    table = {r["piece"]: r["id"] for r in vocab.limit(1_000_001).collect()}
    if len(table) > 1_000_000:
        raise ValueError("a vocabulary holds at most a million pieces")
    sent = texts.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda t: encode(t or "", sent.value))

    return texts.withColumn("token_ids", ids(column))
