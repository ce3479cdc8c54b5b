"""Character sets of text and HTML files."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes looked at, and the character sets tried, in order.
SAMPLE = 135_168
CANDIDATES = ("utf-8", "gbk", "gb18030", "gb2312", "big5")
_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le"))


def _bom(raw: bytes) -> str | None:
    return next((name for mark, name in _BOMS if raw.startswith(mark)), None)


def _chinese(text: str) -> int:
    return sum("㐀" <= c <= "䶿" or "一" <= c <= "鿿" for c in text)


def text_charset(raw: bytes) -> str:
    """A mark decides; else the clean reading with most Chinese; else the one with fewest replacements. Ties go to the earlier."""
    raw = raw[:SAMPLE]
    if mark := _bom(raw):
        return mark
    read = [(name, raw.decode(name, "replace")) for name in CANDIDATES]
    clean = [(name, _chinese(t)) for name, t in read if "�" not in t]
    if clean and (best := max(clean, key=lambda x: x[1]))[1]:
        return best[0]
    return min(read, key=lambda x: x[1].count("�"))[0]


def _valid_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def html_charset(raw: bytes) -> str:
    """A mark, else what the head declares (UTF-8 only if the bytes are), else UTF-8 or GB18030 by the bytes."""
    if mark := _bom(raw):
        return mark
    head = raw[:1024].decode("latin-1")
    for pattern in (r"encoding\s*=\s*[\"']([^\"']+)[\"']", r"<meta[^>]+charset\s*=\s*[\"']?([^\"'>\s/]+)"):
        if m := re.search(pattern, head, re.I):
            try:
                name = codecs.lookup(m[1].strip()).name
            except LookupError:
                continue
            return "gb18030" if name == "utf-8" and not _valid_utf8(raw) else name
    return "utf-8" if _valid_utf8(raw) else "gb18030"


def decode(raw: bytes, charset: str) -> str:
    return raw.decode(charset, "replace").removeprefix("﻿")


@F.pandas_udf(T.StringType())
def text_charsets(s: pd.Series) -> pd.Series:
    return s.map(text_charset, na_action="ignore")


@F.pandas_udf(T.StringType())
def html_charsets(s: pd.Series) -> pd.Series:
    return s.map(html_charset, na_action="ignore")


@F.pandas_udf(T.StringType())
def decoded_texts(s: pd.Series) -> pd.Series:
    return s.map(lambda raw: decode(raw, text_charset(raw)), na_action="ignore")
