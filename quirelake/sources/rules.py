"""Rule-driven extraction of lists from HTML and JSON, links from pages, and JSON embedded in scripts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from itertools import zip_longest
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ends a rule as an attribute, and words of links that lead to no book.
ATTRIBUTES = ("text", "href", "src", "alt", "title", "content", "onclick")
NOT_BOOKS = ("首页", "排行", "分类", "搜索", "书签", "阅读记录", "登录", "注册")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass(frozen=True)
class Step:
    """Down to what find names; at: only that one of what a node has below, else all."""

    find: str
    at: int | None


@dataclass(frozen=True)
class Rule:
    """Steps down, then which of the nodes is left out, what is read of a node, and what is replaced in it."""

    steps: tuple[Step, ...]
    without: int | None = None
    take: str = "text"
    swaps: tuple[tuple[re.Pattern, str], ...] = ()

    def nodes(self, start) -> list:
        """The walk, over any nodes that know what is ``below`` them."""
        here = [start]
        for step in self.steps:
            here = [y for x in here for y in (x.below(step.find) if step.at is None else x.below(step.find)[step.at : step.at + 1])]
        return [x for i, x in enumerate(here) if i != self.without]

    def value(self, start) -> str | None:
        """What the first node holds, after the replacements; None without a node or a value."""
        found = next((x.holds(self.take) for x in self.nodes(start)), None)
        for pattern, put in self.swaps if found is not None else ():
            found = pattern.sub(put, found)
        return found


class Node:
    """An element of a page."""

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def below(self, find: str) -> list[Node]:
        return self.select(find)

    def holds(self, what: str) -> str:
        return self.text() if what == "text" else self.attrs.get(what, "")

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        parts: list[str] = []

        def collect(n: Node):
            for c in n.children:
                if isinstance(c, str):
                    parts.append(c)
                elif c.tag not in ("script", "style"):
                    collect(c)

        collect(self)
        return re.sub(r"\s+", " ", " ".join(parts)).strip()

    def matches(self, simple: str) -> bool:
        for mark, value in re.findall(r"([.#\[]?)([\w:-]+(?:[~|^$*]?=[^\]]*)?)\]?", simple):
            if mark == "." and value not in self.attrs.get("class", "").split():
                return False
            if mark == "#" and self.attrs.get("id") != value:
                return False
            if mark == "[":
                m = re.match(r"([\w:-]+)(?:([*^$]?)=[\"']?(.*?)[\"']?)?$", value)
                have = self.attrs.get(m[1])
                if have is None or (m[3] is not None and not {"": have == m[3], "*": m[3] in have, "^": have.startswith(m[3]), "$": have.endswith(m[3])}[m[2]]):
                    return False
            if mark == "" and value not in ("*", self.tag):
                return False
        return True

    def select(self, selector: str) -> list[Node]:
        """Elements below by a selector: tags, .class, #id, [attr=value], descendants and children (>)."""
        out = []
        for alternative in selector.split(","):
            steps = re.findall(r">|[^\s>]+", alternative)
            if not steps:
                continue
            for n in self.walk():
                if n not in out and self._fits(n, steps):
                    out.append(n)
        return out

    def _fits(self, n: Node, steps: list[str]) -> bool:
        if not steps or not n.matches(steps[-1]):
            return False
        rest, child = steps[:-1], False
        if rest and rest[-1] == ">":
            rest, child = rest[:-1], True
        if not rest:
            return not child or n.parent is self
        up = n.parent
        while up is not None and up is not self.parent:
            if self._fits(up, rest):
                return True
            if child:
                return False
            up = up.parent
        return False


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(markup: str) -> Node:
    t = _Tree()
    t.feed(markup)
    t.close()
    return t.root


@dataclass(frozen=True)
class Member:
    """A value in JSON."""

    value: object

    def below(self, find: str) -> list[Member]:
        """The member of that name, the item at that place, or for a star the list itself."""
        place = find.strip("[]")
        match self.value:
            case dict() as members:
                found = members.get(find)
            case list() as items if place == "*":
                found = items
            case list() as items if place.isdecimal():
                found = dict(enumerate(items)).get(int(place))
            case _:
                found = None
        return [] if found is None else [Member(found)]

    def holds(self, _: str) -> str | None:
        return None if self.value is None else str(self.value)


#: A selector, maybe by kind (tag.x, class.x, id.x), and which of the matches (.3) is meant.
_STEP = re.compile(r"\s*(?:(?P<kind>tag|class|id)\.)?(?P<name>.+?)(?:\.(?P<at>\d+))?\s*", re.S)
_SIGNS = {"tag": "", "class": ".", "id": "#", None: ""}


def _down(chain: str) -> list[Step]:
    found = [_STEP.fullmatch(part) for part in chain.split("@") if part.strip()]
    return [Step(_SIGNS[m["kind"]] + m["name"], int(m["at"] or 0)) for m in found if m]


@lru_cache(maxsize=1024)
def list_rule(text: str) -> Rule:
    """a@b.N@c!K: the N-th of each step, all of the last, without the K-th."""
    chain, mark, without = text.rpartition("!")
    if not (mark and without.isdecimal()):
        chain, without = text, None
    steps = _down(chain)
    if not steps:
        return NOTHING
    return Rule((*steps[:-1], Step(steps[-1].find, None)), None if without is None else int(without))


@lru_cache(maxsize=1024)
def value_rule(text: str) -> Rule:
    """Steps to one element, then an attribute or its text, then ##pattern##replacement pairs; a pattern that is none is left out."""
    chain, *pairs = text.split("##")
    names = [part for part in chain.split("@") if part.strip()]
    if not names:
        return NOTHING
    take = names[-1] if names[-1] in ATTRIBUTES or "-" in names[-1] else None
    swaps = []
    for pattern, put in zip_longest(pairs[::2], pairs[1::2], fillvalue=""):
        with suppress(re.error):
            swaps.append((re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", put)))
    return Rule(tuple(_down("@".join(names[:-1] if take else names))), take=take or "text", swaps=tuple(swaps))


@lru_cache(maxsize=1024)
def json_rule(text: str) -> Rule:
    """$.a.b.[0].*: members and places; a star keeps the list."""
    path = text.strip().removeprefix("@json:").removeprefix("$")
    return Rule(tuple(Step(part.strip(), 0) for part in path.split(".") if part.strip()))


#: Finds no node.
NOTHING = Rule((Step("", 0),), without=0)
_PLACE = re.compile(r"\{\{\$([^}]+)\}\}")


def read_json(item: Member, rule: str) -> str | None:
    """A path, or a template that holds paths as {{$.a.b}}."""
    if "{{" not in rule:
        return json_rule(rule).value(item)
    return _PLACE.sub(lambda m: json_rule("$" + m[1]).value(item) or "", rule)


def items_of(page: str, rule: str) -> tuple[list, Callable[[object, str], str | None]]:
    """The items of a page or of JSON, and how to read a field of one."""
    if not rule.startswith(("$", "@json:")):
        return list_rule(rule).nodes(tree(page)), lambda x, r: value_rule(r).value(x)
    found = [x.value for x in json_rule(rule).nodes(Member(json.loads(page)))]
    return [Member(x) for some in found if isinstance(some, list) for x in some], read_json


def extract(page: str, rules: dict[str, str], base: str = "") -> list[dict[str, str | None]]:
    """Items by rules: bookList, then name, author, cover and url of each; rules for JSON begin with $ or @json:."""
    fields = [k for k in rules if k != "bookList"]
    items, get = items_of(page, rules["bookList"])
    out = []
    for x in items:
        row = {k: get(x, rules[k]) for k in fields}
        if row.get("name"):
            for k in ("url", "cover"):
                if row.get(k):
                    row[k] = urljoin(base, row[k])
            out.append(row)
    return out


def extract_all(pages: DataFrame, rules: dict[str, str], key: str = "page_id", content: str = "html", base: str = "url") -> DataFrame:
    """A row per item found in each page."""
    fields = [k for k in rules if k != "bookList"]
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for k, page, at in zip(pdf[key], pdf[content], pdf[base]):
                try:
                    found = extract(page or "", rules, at or "")
                except ValueError:  # a page that isn't JSON gives nothing
                    found = []
                out += [(k, i, *[x.get(f) for f in fields]) for i, x in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "position", *fields])

    return pages.select(key, content, base).mapInPandas(run, f"{key} {kind}, position long, " + ", ".join(f"{f} string" for f in fields))


def book_links(pages: DataFrame, base: str) -> DataFrame:
    """pages(page_id, html) -> page_id, title, href: links that look like books, one per title."""
    pattern = F.lit(r'<a[^>]+href="([^"]+)"[^>]*>([^<]{2,40})</a>')
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("h"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("t"))
    rows = pages.select("page_id", F.posexplode(pairs).alias("i", "x")).select("page_id", "i", F.trim("x.h").alias("href"), F.trim("x.t").alias("title"))
    fit = F.length("title").between(2, 40) & F.col("href").rlike(r"book|info|article|/\d+") & ~F.col("title").rlike("|".join(NOT_BOOKS))
    first = rows.where(fit).groupBy("page_id", "title").agg(F.min_by("href", "i").alias("href"))
    return first.withColumn("href", F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/")), F.col("href"))))


def embedded_json(page: str | None, mark: str = "window.__DATA__ = ") -> str | None:
    """The JSON object or array that follows a mark in a script, by matching brackets outside of strings."""
    if not page or (at := page.find(mark)) < 0:
        return None
    at += len(mark)
    depth, quoted, i = 0, False, at
    while i < len(page):
        c = page[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return page[at : i + 1]
        i += 1
    return None


@F.pandas_udf(T.StringType())
def embedded_jsons(s: pd.Series) -> pd.Series:
    return s.map(embedded_json)


def minimal_path(json_text: Column, path: str) -> Column:
    return F.get_json_object(json_text, path)
