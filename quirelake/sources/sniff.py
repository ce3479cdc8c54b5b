"""A file's format from hints (extension, media type) and then from its first bytes; an archive's from its directory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .archives import archive_kinds

#: Formats by extension and by media type; the order of FORMATS is the order of trial.
FORMATS: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("html", ("htm", "html", "xht", "xhtml"), ("text/html", "application/xhtml+xml")),
    ("opds1", (), ("application/atom+xml;profile=opds-catalog",)),
    ("opds2", (), ("application/opds+json", "application/opds-publication+json")),
    ("lcp_license", ("lcpl",), ()),
    ("bitmap", ("avif", "bmp", "gif", "jpg", "jpeg", "jxl", "png", "tif", "tiff", "webp"), ("image/avif", "image/bmp", "image/gif", "image/jpeg", "image/jxl", "image/png", "image/tiff", "image/webp")),
    ("audio", ("aac", "aiff", "flac", "m4a", "m4b", "mp3", "oga", "ogg", "opus", "wav", "webm"), ("audio/aac", "audio/aiff", "audio/flac", "audio/mp4", "audio/mpeg", "audio/ogg", "audio/opus", "audio/wav", "audio/webm")),
    ("webpub_manifest", ("json",), ("application/webpub+json", "application/audiobook+json", "application/divina+json")),
    ("webpub_package", ("audiobook", "divina", "webpub", "lcpa", "lcpau", "lcpdf"), ("application/webpub+zip", "application/audiobook+zip", "application/divina+zip", "application/audiobook+lcp", "application/pdf+lcp")),
    ("epub", ("epub",), ("application/epub+zip",)),
    ("lpf", ("lpf",), ("application/lpf+zip",)),
    ("rar", ("rar", "cbr"), ("application/vnd.rar", "application/x-rar", "application/vnd.comicbook-rar")),
    ("mobi", ("mobi", "azw", "azw3", "prc"), ("application/x-mobipocket-ebook",)),
    ("zip", ("zip", "cbz", "zab"), ("application/zip", "application/x-cbz", "application/vnd.comicbook+zip")),
    ("pdf", ("pdf",), ("application/pdf",)),
    ("css", ("css",), ("text/css",)),
    ("javascript", ("js", "mjs"), ("text/javascript", "application/javascript")),
]


def by_hints(extension: Column, media_type: Column) -> Column:
    ext = F.lower(F.coalesce(extension, F.lit("")))
    kind = F.lower(F.regexp_replace(F.coalesce(media_type, F.lit("")), r"\s+", ""))
    out = F.when(F.lit(False), "")
    for name, extensions, types in FORMATS:
        hit = F.lit(False)
        if types:
            hit = hit | kind.isin(*types) | F.substring_index(kind, ";", 1).isin(*[t for t in types if ";" not in t])
        out = out.when(hit, name)
    for name, extensions, _ in FORMATS:
        if extensions and name != "webpub_manifest":
            out = out.when(ext.isin(*extensions), name)
    return out


def by_content(content: Column) -> Column:
    """Magic bytes, then what the first characters say."""
    head = F.substring(content, 1, 4096)
    starts = lambda raw, at=1: F.substring(content, at, len(raw)) == F.lit(raw)
    # read byte by byte: a cut character at the end must not spoil it, and what is looked for is ASCII
    text = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"^(?:\x{EF}\x{BB}\x{BF})?\s*", "")
    holds = lambda p: text.rlike(p)
    zipped = starts(b"PK\x03\x04")
    return (
        F.when(zipped & (F.substring(content, 31, 28) == F.lit(b"mimetypeapplication/epub+zip")), "epub")
        .when(zipped, F.coalesce(archive_kinds(F.when(zipped, content)), F.lit("zip")))
        .when(starts(b"Rar!\x1a\x07"), "rar")
        .when(starts(b"%PDF-"), "pdf")
        .when(starts(b"BOOKMOBI", 61), "mobi")
        .when(starts(b"\x89PNG") | starts(b"GIF8") | starts(b"\xff\xd8\xff") | starts(b"BM") | (starts(b"RIFF") & starts(b"WEBP", 9)), "bitmap")
        .when(starts(b"ID3") | starts(b"fLaC") | starts(b"OggS") | (starts(b"RIFF") & starts(b"WAVE", 9)), "audio")
        .when(holds(r"(?is)^(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<(feed|entry)\b[^>]*http://www\.w3\.org/2005/Atom"), "opds1")
        .when(holds(r"(?is)^(<\?xml[^>]*>\s*)?(<!doctype html[^>]*>\s*)?<html\b"), "html")
        .when(holds(r'(?s)^\{.*"rel"\s*:\s*"[^"]*opds-spec') | holds(r'(?s)^\{.*application/opds\+json'), "opds2")
        .when(holds(r'(?s)^\{.*"provider"\s*:') & holds(r'(?s)"encryption"\s*:') & holds(r'"issued"\s*:'), "lcp_license")
        .when(holds(r'(?s)^\{.*"(readingOrder|spine)"\s*:'), "webpub_manifest")
        .when(holds(r'(?s)^\{.*"@context"\s*:.*w3\.org/ns/wp-context'), "w3c_manifest")
        .when(holds(r"^[\[{]"), "json")
    )


def sniff(extension: Column, media_type: Column, content: Column) -> Column:
    """The more exact of both: content decides where hints say nothing, or only that it is a container."""
    hint, seen = by_hints(extension, media_type), by_content(content)
    return F.when(hint.isNull() | hint.isin("zip", "webpub_manifest"), F.coalesce(seen, hint)).otherwise(hint)
