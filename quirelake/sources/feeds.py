"""Catalogue feeds (Atom and JSON), publication manifests, locators."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .archives import local, read_xml, rows

ATOM, OPDS, THREAD = "{http://www.w3.org/2005/Atom}", "{http://opds-spec.org/2010/catalog}", "{http://purl.org/syndication/thread/1.0}"
ENTRY = "kind string, group string, title string, href string, rel string, media_type string, author string, identifier string, summary string, items long"

#: What both kinds of feed are read into: rows of kind publication, navigation, facet or link.


def _links(e: ET.Element) -> list[ET.Element]:
    return [x for x in e if x.tag == f"{ATOM}link" and x.get("href")]


def _text(e: ET.Element, name: str) -> str | None:
    return next((" ".join("".join(x.itertext()).split()) for x in e if local(x.tag) == name), None)


def parse_atom(raw: bytes, base: str = "") -> Iterator[tuple]:
    """Rows of an Atom catalogue. An entry with an acquisition link is a publication, any other leads on; an entry's
    collection or group link puts it in a group; feed links with a facet group are facets."""
    root = read_xml(raw)
    if local(root.tag) == "entry":
        entries, links = [root], []
    else:
        if _text(root, "title") is None:
            raise ValueError("a feed needs a title")
        entries, links = [e for e in root if e.tag == f"{ATOM}entry"], _links(root)
    count = lambda e: int(e.get(f"{THREAD}count")) if (e.get(f"{THREAD}count") or "").isdigit() else None
    for entry in entries:
        own = _links(entry)
        rel = [x.get("rel") or "" for x in own]
        group = next((x.get("title") or urljoin(base, x.get("href")) for x in reversed(own) if x.get("rel") in ("collection", "http://opds-spec.org/group")), None)
        acquired = [x for x in own if (x.get("rel") or "").startswith("http://opds-spec.org/acquisition")]
        author = ", ".join(n for a in entry if a.tag == f"{ATOM}author" and (n := _text(a, "name"))) or None
        if acquired:
            at = acquired[0]
            yield "publication", group, _text(entry, "title"), urljoin(base, at.get("href")), at.get("rel"), at.get("type"), author, _text(entry, "identifier") or _text(entry, "id"), _text(entry, "summary") or _text(entry, "content"), None
        elif own:
            yield "navigation", group, _text(entry, "title"), urljoin(base, own[0].get("href")), rel[0] or None, own[0].get("type"), author, _text(entry, "id"), _text(entry, "summary") or _text(entry, "content"), count(own[0])
    for x in links:
        facet = x.get(f"{OPDS}facetGroup") if x.get("rel") == "http://opds-spec.org/facet" else None
        yield "facet" if facet else "link", facet, x.get("title"), urljoin(base, x.get("href")), x.get("rel"), x.get("type"), None, None, None, count(x) if facet else None


def localized(value) -> str | None:
    """A string, or the first value of a map from language."""
    if isinstance(value, dict):
        return next(iter(value.values()), None)
    return value if isinstance(value, str) else None


def names(value) -> str | None:
    """Contributors: a name, a map with a name, or a list of them."""
    many = value if isinstance(value, list) else [value]
    return ", ".join(n for v in many if (n := localized(v.get("name")) if isinstance(v, dict) and "name" in v else localized(v))) or None


def parse_json_feed(raw: bytes, base: str = "") -> Iterator[tuple]:
    """Rows of a JSON catalogue: facets, links, publications and navigation, also within groups; or of one publication."""
    feed = json.loads(raw)

    def link(kind: str, group, x: dict) -> tuple:
        rel = x.get("rel")
        return kind, group, x.get("title"), urljoin(base, x.get("href", "")), rel[0] if isinstance(rel, list) and rel else rel or None, x.get("type"), None, None, None, (x.get("properties") or {}).get("numberOfItems")

    def publication(group, x: dict) -> tuple:
        meta, links = x.get("metadata") or {}, x.get("links") or []
        best = next((y for y in links if "acquisition" in str(y.get("rel"))), links[0] if links else {})
        row = link("publication", group, best)
        return row[0], group, localized(meta.get("title")), *row[3:6], names(meta.get("author")), meta.get("identifier"), localized(meta.get("description")), None

    if "publications" not in feed and "navigation" not in feed and "groups" not in feed and "links" in feed and "title" in (feed.get("metadata") or {}):
        yield publication(None, feed)
        return
    for part, group in [(feed, None)] + [(g, localized((g.get("metadata") or {}).get("title"))) for g in feed.get("groups") or []]:
        for x in part.get("publications") or []:
            yield publication(group, x)
        for x in part.get("navigation") or []:
            yield link("navigation", group, x)
    for f in feed.get("facets") or []:
        for x in f.get("links") or []:
            yield link("facet", localized((f.get("metadata") or {}).get("title")), x)
    for x in feed.get("links") or []:
        yield link("link", None, x)


def read_feeds(files: DataFrame, key: str = "path") -> DataFrame:
    """Atom or JSON, by the first character that isn't white space."""
    return rows(files, lambda raw: parse_json_feed(raw) if raw.lstrip()[:1] == b"{" else parse_atom(raw), ENTRY, key)


LINK = "struct<href:string,type:string,title:string,rel:string>"
#: A web publication's manifest; titles and names may be strings or maps, so they stay JSON.
MANIFEST = f"metadata struct<title:string,author:string,language:string,identifier:string,modified:string,subject:string>, links array<{LINK}>, readingOrder array<{LINK}>, resources array<{LINK}>, toc array<{LINK}>"


def manifest(json_text: Column) -> Column:
    return F.from_json(json_text, MANIFEST)


LOCATOR = T.StructType(
    [
        T.StructField("href", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("locations", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.MapType(T.StringType(), T.StringType())),
    ]
)


def locator(json_text: Column) -> Column:
    """A place in a publication: known places typed, others kept in a map; null without href and type."""
    loc = F.from_json(json_text, LOCATOR)
    at = loc["locations"]
    known = ("fragments", "progression", "position", "totalProgression")
    fields = [
        loc["href"].alias("href"),
        loc["type"].alias("type"),
        loc["title"].alias("title"),
        F.from_json(at["fragments"], "array<string>").alias("fragments"),
        F.when(at["progression"].try_cast("double").between(0, 1), at["progression"].try_cast("double")).alias("progression"),
        F.when(at["position"].try_cast("int") > 0, at["position"].try_cast("int")).alias("position"),
        F.when(at["totalProgression"].try_cast("double").between(0, 1), at["totalProgression"].try_cast("double")).alias("total_progression"),
        F.map_filter(at, lambda k, _: ~k.isin(*known)).alias("other"),
        loc["text"].alias("text"),
    ]
    return F.when(loc["href"].isNotNull() & loc["type"].isNotNull(), F.struct(*fields))


def rating(json_text: Column) -> Column:
    """A rating that is a number, a string, or an object with average, value or score; else the score or average; above 0."""
    v = F.try_parse_json(json_text)
    raw = F.try_variant_get(v, "$.rating", "string").try_cast("double")
    inner = F.coalesce(*[F.try_variant_get(v, f"$.rating.{k}", "string") for k in ("average", "value", "score")]).try_cast("double")
    outer = [F.try_variant_get(v, f"$.{k}", "string").try_cast("double") for k in ("score", "average")]
    return F.coalesce(*[F.when(x > 0, x) for x in (raw, inner, *outer)])


ONLINE = ("title", "author", "description", "rating", "link", "source", "popularity", "tags")


def google_books(json_text: Column) -> Column:
    """An array of books from a volumes answer."""
    kind = "struct<items:array<struct<volumeInfo:struct<title:string,authors:array<string>,description:string,averageRating:double,ratingsCount:long,infoLink:string,categories:array<string>>>>>"
    items = F.from_json(json_text, kind)["items"]
    return F.transform(items, lambda i: _book(i["volumeInfo"]["title"], F.array_join(i["volumeInfo"]["authors"], ", "), i["volumeInfo"]["description"], i["volumeInfo"]["averageRating"].cast("string"), i["volumeInfo"]["infoLink"], "Google Books", i["volumeInfo"]["ratingsCount"], i["volumeInfo"]["categories"]))


def open_library(json_text: Column) -> Column:
    kind = "struct<docs:array<struct<key:string,title:string,author_name:array<string>,subject:array<string>,edition_count:long,ratings_average:double>>>"
    return F.transform(F.from_json(json_text, kind)["docs"], lambda d: _book(d["title"], F.array_join(d["author_name"], ", "), F.lit(None).cast("string"), d["ratings_average"].cast("string"), F.concat(F.lit("https://openlibrary.org"), d["key"]), "Open Library", d["edition_count"], d["subject"]))


def douban(json_text: Column) -> Column:
    kind = "struct<items:array<struct<title:string,author:string,abstract:string,url:string,rating:struct<value:double,count:long>>>>"
    return F.transform(F.from_json(json_text, kind)["items"], lambda d: _book(d["title"], d["author"], d["abstract"], d["rating"]["value"].cast("string"), d["url"], "豆瓣", d["rating"]["count"], F.array().cast("array<string>")))


def list_api(json_text: Column, source: str) -> Column:
    """A plain list of {title, author, description, link, count}."""
    kind = "array<struct<title:string,author:string,description:string,link:string,rating:string,count:long,tags:array<string>>>"
    return F.transform(F.from_json(json_text, kind), lambda d: _book(d["title"], d["author"], d["description"], d["rating"], d["link"], source, d["count"], d["tags"]))


def _book(title, author, description, rating_, link, source: str, count, tags) -> Column:
    return F.struct(
        title.alias("title"),
        F.coalesce(author, F.lit("")).alias("author"),
        description.alias("description"),
        rating_.alias("rating"),
        link.alias("link"),
        F.lit(source).alias("source"),
        F.log10(F.coalesce(count, F.lit(0)).cast("double") + 1).alias("popularity"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
    )
