"""Text functions. Columns where built-ins can say it; the rest are Arrow UDFs over whole batches."""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
#: Characters of traditional script that mark a text.
TRADITIONAL = "這們麼語書說見開關東車馬門時間會來個那為應該覺得讓對還樣種點現過進從長問聞間風飛飯飲魚鳥龍龜體齊齒齋舊國與學愛爾邊頭實際續"
#: Marks that close a sentence that has ended.
CLOSERS = "\"'”’」』）)】》〉"
#: Marks at which lists of genres are parted.
GENRE_MARKS = "[|,，、;；]"


def xml_safe(text: Column) -> Column:
    """Without byte-order marks, noncharacters, private-use and control characters (tab and line ends stay)."""
    return F.regexp_replace(text, r"[\x{FEFF}\x{FFFE}\x{FFFF}\x{FDD0}-\x{FDEF}\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def without_watermarks(text: Column) -> Column:
    """From U+0A00 up to the line's end."""
    return F.regexp_replace(text, r"\x{0A00}[^\n]*", "")


def _odd(c: str) -> bool:
    o = ord(c)
    return not (0x20 <= o <= 0x7E or o in (0x9, 0xA, 0xD, 0xA0, 0xB7, 0xD7, 0xF7, 0x2026) or 0x2013 <= o <= 0x2014 or 0x2018 <= o <= 0x201D or 0x3000 <= o <= 0x303F or 0x4E00 <= o <= 0x9FFF or 0xFF00 <= o <= 0xFFEF)


def drop_garbled(text: str, window: int = 6, most: int = 2) -> str:
    """Without each run of six characters that holds two or more odd ones. For Chinese text only: it takes accented Latin for garbage."""
    odd = [_odd(c) for c in text]
    if len(text) < window or sum(odd) < most:
        return text
    gone = [False] * len(text)
    count = sum(odd[:window])
    for i in range(len(text) - window + 1):
        if i:
            count += odd[i + window - 1] - odd[i - 1]
        if count >= most:
            gone[i : i + window] = [True] * window
    return "".join(c for c, g in zip(text, gone) if not g)


@F.pandas_udf(T.StringType())
def without_garbled(s: pd.Series) -> pd.Series:
    return s.map(drop_garbled, na_action="ignore")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@F.pandas_udf(T.StringType())
def entities_decoded(s: pd.Series) -> pd.Series:
    return s.map(_html.unescape, na_action="ignore")


def repaired_ampersands(text: Column) -> Column:
    return F.regexp_replace(text, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#\d+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def cut_after_html(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)(</html\s*>).*\S.*$", "$1")


def with_head_style(text: Column, css: str) -> Column:
    return F.regexp_replace(text, r"(?i)(<head[^>]*>)", "$1<style>" + css.replace("\\", "\\\\").replace("$", "\\$") + "</style>")


def body(text: Column) -> Column:
    """Between <body> and its end, or the end of the text; all of it without a body."""
    inner = F.regexp_extract(text, r"(?is)<body[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    return F.when(text.rlike(r"(?i)<body[^>]*>"), inner).otherwise(text)


def percent_decode(text: str) -> str:
    """%XX as UTF-8 bytes; a plus sign stays."""
    return unquote_to_bytes(text).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def percent_decoded(s: pd.Series) -> pd.Series:
    return s.map(percent_decode, na_action="ignore")


def without_stamp(name: Column) -> Column:
    """Without a leading run of ten digits or more and an underscore."""
    return F.regexp_replace(name, r"^\d{10,}_", "")


def resolve_path(base: str, href: str) -> str:
    """href from the folder of base, with . and .. followed."""
    parts = [] if href.startswith("/") else base.split("/")[:-1]
    for p in href.lstrip("/").split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in (".", ""):
            parts.append(p)
    return "/".join(parts)


def plain_text(text: Column) -> Column:
    """HTML as one line: head, style and script go, tags are spaces, common entities are read, spaces run together."""
    t = F.regexp_replace(text, r"(?is)<(head|style|script)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))


#: Tags that begin a block of text.
BLOCK_TAGS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "tr", "table", "hr", "section", "article", "mbp:pagebreak", "mbp:section"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style")
        if tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("head", "script", "style")))
        if tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def block_text(markup: str) -> str:
    """HTML as text, a line break on each side of a block, blank lines not over one."""
    parser = _Blocks()
    parser.feed(markup)
    parser.close()
    return re.sub(r"(?:\s*\n){3,}", "\n\n", "".join(parser.out)).strip()


@F.pandas_udf(T.StringType())
def block_texts(s: pd.Series) -> pd.Series:
    return s.map(block_text, na_action="ignore")


ELEMENT = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("language", T.StringType()), T.StructField("selector", T.StringType()), T.StructField("progression", T.DoubleType())])
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Elements(HTMLParser):
    """Content in reading order: text blocks and media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, str, str | None]] = []
        self.text, self.items = "", []
        self.at: tuple[str, str | None, str] | None = None

    def _flush(self):
        text = re.sub(r"\s+", " ", self.text).strip()
        if text and self.at:
            role, language, selector = self.at
            self.items.append({"kind": "text", "role": role, "text": text, "source": None, "language": language, "selector": selector})
        self.text, self.at = "", None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        name = f"#{a['id']}" if a.get("id") else tag
        language = a.get("xml:lang") or a.get("lang") or (self.path[-1][2] if self.path else None)
        if tag in BLOCK_TAGS or tag in ("img", "audio", "video", "ul", "ol", "td", "th", "body", "head"):
            self._flush()
        if tag in ("img", "audio", "video"):
            kind = {"img": "image"}.get(tag, tag)
            self.items.append({"kind": kind, "role": None, "text": a.get("alt"), "source": a.get("src"), "language": language, "selector": self._selector(name)})
        if tag not in _VOID:
            self.path.append((tag, name, language))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS or tag in ("ul", "ol", "td", "th", "body", "head"):
            self._flush()
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                break

    def _selector(self, last: str | None = None) -> str:
        names = [p[1] for p in self.path if p[0] not in ("html",)] + ([last] if last else [])
        for i in range(len(names) - 1, -1, -1):
            if names[i].startswith("#"):
                names = names[i:]
                break
        return " > ".join(names)

    def handle_data(self, data):
        tags = [p[0] for p in self.path]
        if any(t in ("head", "script", "style") for t in tags):
            return
        if self.at is None and data.strip():
            heading = next((t for t in reversed(tags) if re.fullmatch("h[1-6]", t)), None)
            role = f"heading{heading[1]}" if heading else "quote" if "blockquote" in tags else "body"
            self.at = (role, self.path[-1][2] if self.path else None, self._selector())
        self.text += data


def content_elements(markup: str) -> list[dict]:
    parser = _Elements()
    parser.feed(markup)
    parser.close()
    parser._flush()
    n = len(parser.items)
    return [{**x, "progression": i / n} for i, x in enumerate(parser.items)]


@F.pandas_udf(ELEMENT)
def elements(s: pd.Series) -> pd.Series:
    return s.map(lambda m: content_elements(m) if isinstance(m, str) else None)


def text_with_offsets(markup: str) -> tuple[str, list[int]]:
    """Text outside of tags, and each character's place in the source."""
    text, places, at = [], [], 0
    while at < len(markup):
        if markup[at] == "<" and (end := markup.find(">", at)) > 0:
            at = end + 1
            continue
        if markup[at] == "&" and (m := re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);").match(markup, at)):
            piece, step = _html.unescape(m[0]), len(m[0])
        else:
            piece, step = markup[at], 1
        text.append(piece)
        places += [at] * len(piece)
        at += step
    return "".join(text), places


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))]))
def offset_texts(s: pd.Series) -> pd.DataFrame:
    got = [text_with_offsets(x) if isinstance(x, str) else (None, None) for x in s]
    return pd.DataFrame({"text": [g[0] for g in got], "offsets": [g[1] for g in got]})


def sentences(text: Column) -> Column:
    """Sentences by their closing marks; closers and bare marks go to the sentence before."""
    closers = "".join("\\" + c for c in CLOSERS)
    raw = F.filter(F.transform(F.split(text, r"(?<=[。！？.!?])\s*"), lambda x: F.trim(x)), lambda x: x != "")

    def fold(acc, seg):
        lead = F.regexp_extract(seg, f"^[{closers}]*", 0)
        rest = F.substring(seg, F.length(lead) + 1, F.lit(2**31 - 1))
        joins = ~rest.rlike(r"[\p{L}\p{N}]")
        last = F.concat(F.element_at(acc, -1), F.when(joins, seg).otherwise(lead))
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return F.when(F.size(acc) == 0, F.array(seg)).when(joins, F.concat(head, F.array(last))).otherwise(F.concat(head, F.array(last), F.array(rest)))

    got = F.aggregate(raw, F.array().cast("array<string>"), fold)
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).when(F.size(raw) == 0, F.array(text)).otherwise(got)


def words(text: Column) -> Column:
    """Words: runs of letters, marks and digits, with inner apostrophes."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{M}]+(?:['’][\p{L}\p{N}]+)*"), F.lit(0))


def language_boost(text: Column) -> Column:
    """1.0 for simplified Chinese, 0.5 for traditional, -0.4 without Chinese, 0 for nothing."""
    return F.when(text == "", 0.0).when(~text.rlike(r"[\x{4E00}-\x{9FFF}]"), -0.4).when(text.rlike(f"[{TRADITIONAL}]"), 0.5).otherwise(1.0)


def is_chinese_name(name: Column) -> Column:
    return name.rlike(r"^[\x{4E00}-\x{9FFF}]+$")


def simplified(text: Column, traditional: str, simple: str) -> Column:
    """Character by character, by two strings of equal length."""
    return F.translate(text, traditional, simple)


def is_traditional(text: Column, traditional: str, simple: str, sample: int = 3000) -> Column:
    part = F.left(text, F.lit(sample))
    return F.translate(part, traditional, simple) != part


def sections(text: Column, labels: list[str]) -> Column:
    """【label】 text, for allowed labels, as a map; the first of a label stands."""
    names = "|".join(re.escape(x) for x in labels)
    pattern = F.lit(rf"(?s)【({names})】(.*?)(?=【(?:{names})】|\z)")
    keys, values = (F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"^\s+|\s+$", ""))).alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(first)


def numbered_lines(text: Column) -> Column:
    """Lines without their "1." or "1、" or bullets, blank ones dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:\d{1,3}\s*[.、)）:：]|[-*•])\s*", "")))
    return F.filter(lines, lambda x: x != "")


def first_numbers(text: Column) -> Column:
    """The first number of up to three digits in each line."""
    found = F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(x, r"(?<!\d)(\d{1,3})(?!\d)", 1))
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: x.cast("int"))


def indexed_summaries(text: Column) -> Column:
    """Lines "[N]: summary" as a map from N."""
    pattern = F.lit(r"(?m)^\s*\[(\d+)\]\s*[:：]\s*(.+?)\s*$")
    keys = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: x.cast("int"))
    pairs = F.arrays_zip(keys.alias("k"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"))
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def genre_tags(translated: Column, least: int = 3) -> Column:
    return F.filter(F.transform(F.split(translated, GENRE_MARKS), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def renamed(text: str, names: dict[str, str]) -> str:
    """Names replaced in a text, written plainly or percent-encoded."""
    from urllib.parse import quote

    for old, new in names.items():
        text = text.replace(old, new).replace(quote(old), new)
    return text


def obfuscated(name: Column) -> Column:
    """Whether a base name holds characters that file systems refuse."""
    return F.element_at(F.split(name, "/"), -1).rlike("[*:]")
