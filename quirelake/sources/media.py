"""Image, audio and PDF publications as rows, and fonts read through their key."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import pdf
from .archives import rows
from .sniff import FORMATS

_EXTENSIONS = {name: extensions for name, extensions, _ in FORMATS}
MEDIA = "position long, href string, title string, size long"


def _natural(name: str) -> list:
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", name)]


def _entries(raw: bytes, kind: str) -> list[zipfile.ZipInfo]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        found = [e for e in z.infolist() if not e.is_dir() and e.filename.rpartition(".")[2].lower() in _EXTENSIONS[kind] and not posixpath.basename(e.filename).startswith((".", "__MACOSX"))]
    return sorted(found, key=lambda e: _natural(e.filename))


def comic_pages(raw: bytes) -> Iterator[tuple]:
    """(position, name, folder's name, bytes) of the images of an archive, in natural order."""
    for i, e in enumerate(_entries(raw, "bitmap")):
        yield i, e.filename, posixpath.basename(posixpath.dirname(e.filename)) or None, e.file_size


def audio_tracks(raw: bytes) -> Iterator[tuple]:
    for i, e in enumerate(_entries(raw, "audio")):
        yield i, e.filename, posixpath.splitext(posixpath.basename(e.filename))[0], e.file_size


def pdf_pages(raw: bytes) -> Iterator[tuple]:
    """(position, fragment, title, bytes) of each page of a PDF file."""
    d = pdf.Document(raw)
    title = d.metadata()["title"]
    for i, _ in enumerate(d.pages()):
        yield i, f"#page={i + 1}", title, None


def plain_font(data: bytes, identifier: str, kind: str = "idpf") -> bytes:
    """A font without its obfuscation: its first bytes are xored with a key from the publication's identifier."""
    if kind == "idpf":
        key, n = hashlib.sha1(re.sub(r"[ \t\r\n]", "", identifier).encode("utf-8")).digest(), 1040
    else:
        key, n = bytes.fromhex(identifier.removeprefix("urn:uuid:").replace("-", "")), 1024
    return bytes(b ^ key[i % len(key)] for i, b in enumerate(data[:n])) + data[n:]


def read_comics(files: DataFrame, key: str = "path") -> DataFrame:
    return rows(files, comic_pages, MEDIA, key)


def read_audiobooks(files: DataFrame, key: str = "path") -> DataFrame:
    return rows(files, audio_tracks, MEDIA, key)


def read_pdfs(files: DataFrame, key: str = "path") -> DataFrame:
    return rows(files, pdf_pages, MEDIA, key)
