"""ZIP-based documents: entries, EPUB and DOCX. Parsers take bytes, and ``rows``
runs one over a binaryFile table, a row out for each item, so that a large
library is read by many tasks and one damaged file gives no rows but an error."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_elements, percent_decode, resolve_path

#: Rows of parsed files that a task holds before it passes them on.
HELD_ROWS = 1000
ITEM = "position long, href string, title string, media_type string, text string"


def rows(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str, key: str = "path") -> DataFrame:
    """files(key, content) -> key, the columns of schema, error."""
    kind = files.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for name, raw in zip(pdf[key], pdf["content"]):
                try:
                    out += [(name, *r, None) for r in parse(bytes(raw) if raw is not None else b"")]
                except Exception as e:  # noqa: BLE001  a damaged file is a row with its error
                    out.append((name, *[None] * len(names), f"{type(e).__name__}: {e}"[:200]))
                if len(out) >= HELD_ROWS:
                    yield pd.DataFrame(out, columns=[key, *names, "error"])
                    out = []
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, {schema}, error string")


def read_xml(raw: bytes) -> ET.Element:
    if b"<!ENTITY" in raw:
        raise ValueError("entity declarations are refused")
    return ET.fromstring(raw)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def zip_entries(raw: bytes) -> Iterator[tuple]:
    """(position, name, size, packed size); names that leave the archive's folder are refused."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for i, e in enumerate(z.infolist()):
            name = posixpath.normpath(e.filename)
            if name.startswith(("/", "..")):
                raise ValueError(f"entry leaves its folder: {e.filename}")
            yield i, e.filename, e.file_size, e.compress_size


def docx_paragraphs(raw: bytes) -> Iterator[tuple]:
    """(position, text) of each paragraph that isn't blank."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = read_xml(z.read("word/document.xml"))
    i = 0
    for p in root.iter():
        if local(p.tag) == "p":
            text = "".join(t.text or "" for t in p.iter() if local(t.tag) == "t").strip()
            if text:
                yield i, text
                i += 1


def write_docx(paragraphs: list[str]) -> bytes:
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


# --- EPUB -----------------------------------------------------------------------------------


#: Methods that only obfuscate fonts, and where a licence's key is said to be.
FONT_METHODS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
LICENCE_KEY = "license.lcpl#/encryption/content_key"


def archive_kind(raw: bytes | None) -> str | None:
    """What an archive is by its central directory: epub, webpub_package, lpf or zip; None for bytes that are no whole archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            names = set(z.namelist())
            if "META-INF/container.xml" in names or "mimetype" in names and z.read("mimetype")[:64].strip() == b"application/epub+zip":
                return "epub"
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, ValueError, zlib.error):
        return None
    return next((kind for name, kind in (("manifest.json", "webpub_package"), ("publication.json", "lpf")) if name in names), "zip")


@F.pandas_udf(T.StringType())
def archive_kinds(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: archive_kind(None if raw is None else bytes(raw)))


def encrypted_entries(raw: bytes) -> Iterator[tuple]:
    """(position, href, algorithm, scheme, compression, original length) of what META-INF/encryption.xml names."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if "META-INF/encryption.xml" not in z.namelist():
            return
        root = read_xml(z.read("META-INF/encryption.xml"))
    within = lambda e, name: (x for x in e.iter() if local(x.tag) == name)
    for i, data in enumerate(within(root, "EncryptedData")):
        method = next((m.get("Algorithm") for m in within(data, "EncryptionMethod")), None)
        to = next((c.get("URI") for c in within(data, "CipherReference")), None)
        key = next((k.get("URI") for k in within(data, "RetrievalMethod")), None)
        packed = next(within(data, "Compression"), None)
        size = packed.get("OriginalLength", "") if packed is not None else ""
        if method and to:
            yield i, percent_decode(to).lstrip("/"), method, "lcp" if key == LICENCE_KEY else None, None if packed is None else "deflate" if packed.get("Method") == "8" else "none", int(size) if size.isdigit() else None


def protection(raw: bytes) -> str | None:
    """lcp, adept or unknown if an archive's contents are encrypted; fonts that are only obfuscated don't count."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
    if names & {"META-INF/license.lcpl", "license.lcpl"}:
        return "lcp"
    real = [e for e in encrypted_entries(raw) if e[2] not in FONT_METHODS]
    if any(e[3] == "lcp" for e in real):
        return "lcp"
    return None if not real else "adept" if "META-INF/rights.xml" in names else "unknown"


def protection_items(raw: bytes) -> Iterator[tuple]:
    yield (protection(raw),)


def read_encryption(files: DataFrame, key: str = "path") -> DataFrame:
    """A row for each encrypted or obfuscated entry of each archive."""
    return rows(files, encrypted_entries, "position long, href string, algorithm string, scheme string, compression string, original_length long", key)


def read_protection(files: DataFrame, key: str = "path") -> DataFrame:
    """Each archive's protection, null if it has none."""
    return rows(files, protection_items, "protection string", key)


def parse_package(raw: bytes, path: str = "OEBPS/content.opf") -> dict:
    """An OPF package: metadata, manifest (by id), spine (in order), guide, and fallback chains without cycles."""
    root = read_xml(raw)
    find = lambda name: next((e for e in root if local(e.tag) == name), None)
    meta, items, spine = {}, {}, find("spine")
    refined: dict[str, list[tuple[str, str]]] = {}
    people: dict[str, list[str]] = {}
    for e in find("metadata") if find("metadata") is not None else []:
        name, value = local(e.tag), (e.text or "").strip()
        if name == "meta":
            prop = e.get("property") or e.get("name")
            if e.get("refines"):
                refined.setdefault(e.get("refines").lstrip("#"), []).append((prop, value))
            elif prop:
                meta.setdefault(prop, []).append(value or e.get("content", ""))
        elif name in ("creator", "contributor"):
            role = next((v for k, v in e.attrib.items() if local(k) == "role"), None) or ("aut" if name == "creator" else "ctb")
            people.setdefault(e.get("id", f"_{len(people)}"), []).extend([role, value])
        elif value:
            meta.setdefault(name, []).append(value)
    roles: dict[str, list[str]] = {}
    for ident, (role, value) in people.items():
        roles.setdefault(next((v for p, v in refined.get(ident, []) if p == "role"), role), []).append(value)
    subjects = meta.get("subject", [])
    if len(subjects) == 1:
        meta["subject"] = [s.strip() for s in re.split("[,;]", subjects[0]) if s.strip()]
    for e in find("manifest") if find("manifest") is not None else []:
        items[e.get("id")] = {"href": resolve_path(path, percent_decode(e.get("href", ""))), "media_type": e.get("media-type"), "properties": (e.get("properties") or "").split(), "fallback": e.get("fallback")}
    for item in items.values():
        chain, nxt = [], item["fallback"]
        while nxt in items and nxt not in chain:
            chain.append(nxt)
            nxt = items[nxt]["fallback"]
        item["alternates"] = [items[x]["href"] for x in chain]
    order = [(e.get("idref"), e.get("linear", "yes") != "no") for e in (spine if spine is not None else [])]
    guide = [{"type": e.get("type"), "title": e.get("title"), "href": resolve_path(path, e.get("href", ""))} for e in (find("guide") if find("guide") is not None else [])]
    return {"metadata": meta, "roles": roles, "manifest": items, "spine": [x for x in order if x[0] in items], "guide": guide, "toc": spine.get("toc") if spine is not None else None}


def flat_toc(nodes: list[dict], level: int = 0) -> Iterator[tuple]:
    for n in nodes:
        yield level, n["title"], n["href"]
        yield from flat_toc(n["children"], level + 1)


def parse_nav(raw: bytes, path: str, kind: str = "toc") -> list[dict]:
    """An EPUB 3 navigation document: nested links of the nav of a kind."""
    root = read_xml(raw)

    def items(ol) -> list[dict]:
        out = []
        for li in ol:
            head = next((e for e in li if local(e.tag) in ("a", "span")), None)
            inner = next((e for e in li if local(e.tag) == "ol"), None)
            title = re.sub(r"\s+", " ", "".join(head.itertext())).strip() if head is not None else ""
            href = head.get("href") if head is not None else None
            children = items(inner) if inner is not None else []
            if title and (href or children):
                out.append({"title": title, "href": resolve_path(path, href) if href else "#", "children": children})
        return out

    for nav in root.iter():
        if local(nav.tag) == "nav" and kind in next((v for k, v in nav.attrib.items() if local(k) == "type"), "").split():
            return next((items(e) for e in nav if local(e.tag) == "ol"), [])
    return []


def parse_ncx(raw: bytes, path: str) -> list[dict]:
    """An NCX table of contents: nested navPoints."""
    root = read_xml(raw)

    def points(parent) -> list[dict]:
        out = []
        for e in parent:
            if local(e.tag) != "navPoint":
                continue
            title = re.sub(r"\s+", " ", "".join(t.text or "" for label in e if local(label.tag) == "navLabel" for t in label if local(t.tag) == "text")).strip()
            src = next((c.get("src") for c in e if local(c.tag) == "content"), None)
            children = points(e)
            if title and (src or children):
                out.append({"title": title, "href": resolve_path(path, src) if src else "#", "children": children})
        return out

    return next((points(e) for e in root if local(e.tag) == "navMap"), [])


def open_epub(raw: bytes) -> tuple[zipfile.ZipFile, dict, str]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    container = read_xml(z.read("META-INF/container.xml"))
    path = next(e.get("full-path") for e in container.iter() if local(e.tag) == "rootfile")
    return z, parse_package(z.read(path), path), path


def epub_items(raw: bytes) -> Iterator[tuple]:
    """(position, href, title, media type, text) of each item of the spine."""
    z, package, path = open_epub(raw)
    titles: dict[str, str] = {}
    for _, title, href in epub_toc_of(z, package):
        titles.setdefault(href.partition("#")[0], title)
    for i, (ref, _) in enumerate(package["spine"]):
        item = package["manifest"][ref]
        markup = z.read(item["href"]).decode("utf-8", "replace")
        text = "\n".join(e["text"] for e in content_elements(markup) if e["kind"] == "text")
        yield i, item["href"], titles.get(item["href"]), item["media_type"], text


def epub_toc_of(z: zipfile.ZipFile, package: dict) -> list[tuple]:
    nav = next((i["href"] for i in package["manifest"].values() if "nav" in i["properties"]), None)
    if nav and (tree := parse_nav(z.read(nav), nav)):
        return list(flat_toc(tree))
    ncx = package["manifest"].get(package["toc"]) or next((i for i in package["manifest"].values() if i["media_type"] == "application/x-dtbncx+xml"), None)
    return list(flat_toc(parse_ncx(z.read(ncx["href"]), ncx["href"]))) if ncx else []


def epub_toc(raw: bytes) -> Iterator[tuple]:
    """(position, level, title, href) of the table of contents."""
    z, package, _ = open_epub(raw)
    for i, row in enumerate(epub_toc_of(z, package)):
        yield (i, *row)


def epub_metadata(raw: bytes) -> Iterator[tuple]:
    _, package, _ = open_epub(raw)
    first = lambda k: next(iter(package["metadata"].get(k, [])), None)
    yield first("title"), ", ".join(package["roles"].get("aut", [])) or None, first("language"), first("identifier"), package["metadata"].get("subject", []), len(package["spine"])


def write_epub(title: str, author: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """One XHTML file for each (title, text), with a navigation document and an NCX."""
    out = io.BytesIO()
    names = [f"chapter{i + 1}.xhtml" for i in range(len(chapters))]
    links = "".join(f"<li><a href={quoteattr(n)}>{escape(t)}</a></li>" for n, (t, _) in zip(names, chapters))
    points = "".join(f'<navPoint id="p{i}" playOrder="{i + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src={quoteattr(n)}/></navPoint>' for i, (n, (t, _)) in enumerate(zip(names, chapters)))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        manifest = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' + "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
        dc = "http://purl.org/dc/elements/1.1/"
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="{dc}"><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>{escape(language)}</dc:language></metadata><manifest>{manifest}</manifest><spine toc="ncx">{spine}</spine></package>')
        z.writestr("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        for name, (t, text) in zip(names, chapters):
            paragraphs = "".join(f"<p>{escape(p)}</p>" for p in text.split("\n"))
            z.writestr(f"OEBPS/{name}", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(t)}</title></head><body>{paragraphs}</body></html>')
    return out.getvalue()


def read_epubs(files: DataFrame, key: str = "path") -> DataFrame:
    return rows(files, epub_items, ITEM, key)


def read_docx(files: DataFrame, key: str = "path") -> DataFrame:
    return rows(files, docx_paragraphs, "position long, text string", key)


def read_zips(files: DataFrame, key: str = "path") -> DataFrame:
    return rows(files, zip_entries, "position long, name string, size long, packed long", key)
