"""MOBI and AZW3: PDB records, PalmDOC text, EXTH metadata, chapters by breaks or by parts.

Record layout and codes follow the published Palm database and MOBI formats."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import block_text
from . import kf8
from .archives import rows

#: EXTH record types that are read.
EXTH = {100: "author", 101: "publisher", 103: "description", 104: "isbn", 105: "subject", 106: "published", 503: "title", 524: "language"}


def is_mobi(content: Column) -> Column:
    return F.substring(content, 61, 8) == F.lit(b"BOOKMOBI")


def unpack_palmdoc(data: bytes) -> bytes:
    """LZ77 as PalmDOC packs it: literals, runs of literals, a space with a letter, and back references."""
    out = bytearray()
    i = 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = c << 8 | data[i]
            i += 1
            back, size = pair >> 3 & 0x7FF, (pair & 7) + 3
            for _ in range(size):
                if 0 < back <= len(out):
                    out.append(out[-back])
    return bytes(out)


def pack_palmdoc(data: bytes) -> bytes:
    """Literals only: any reader unpacks it."""
    out = bytearray()
    for i in range(0, len(data), 8):
        run = data[i : i + 8]
        out += bytes([len(run)]) + run
    return bytes(out)


class Huffman:
    """HUFF and CDIC records: codes that stand for phrases, which may be packed themselves."""

    def __init__(self, huff: bytes, cdics: list[bytes]):
        if huff[:4] != b"HUFF":
            raise ValueError("not a HUFF record")
        first, limits = struct.unpack(">II", huff[8:16])
        # by the first byte of a code: its length, whether that is final, and the largest code of the length
        self.first = [(v & 31, bool(v & 128), v >> 8) for v in struct.unpack_from(">256I", huff, first)]
        both = struct.unpack_from(">64I", huff, limits)
        self.least, self.largest = both[::2], both[1::2]
        self.phrases: list[tuple[bytes, bool]] = []
        for c in cdics:
            if c[:4] != b"CDIC":
                raise ValueError("not a CDIC record")
            total, bits = struct.unpack(">II", c[8:16])
            for off in struct.unpack_from(f">{min(1 << bits, total - len(self.phrases))}H", c, 16):
                size = struct.unpack_from(">H", c, 16 + off)[0]
                self.phrases.append((c[18 + off : 18 + off + (size & 0x7FFF)], bool(size & 0x8000)))

    def unpack(self, data: bytes, depth: int = 0) -> bytes:
        if depth > 32:
            raise ValueError("phrases that hold each other")
        total, at, out = 8 * len(data), 0, []
        bits = int.from_bytes(data + b"\0" * 4, "big")
        while at < total:
            window = bits >> (total - at) & 0xFFFFFFFF
            size, final, largest = self.first[window >> 24]
            if not final:
                while size < 32 and window >> (32 - size) < self.least[size - 1]:
                    size += 1
                largest = self.largest[size - 1]
            at += size
            if at > total:
                break
            i = largest - (window >> (32 - size))
            phrase, plain = self.phrases[i]
            if not plain:
                phrase = self.unpack(phrase, depth + 1)
                self.phrases[i] = (phrase, True)
            out.append(phrase)
        return b"".join(out)


def records(raw: bytes) -> list[bytes]:
    if raw[60:68] != b"BOOKMOBI":
        raise ValueError("not a MOBI file")
    n = struct.unpack(">H", raw[76:78])[0]
    at = [struct.unpack(">I", raw[78 + 8 * i : 82 + 8 * i])[0] for i in range(n)] + [len(raw)]
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _trailing(data: bytes, flags: int) -> int:
    """Bytes behind a text record that are not text."""
    end = len(data)
    for bit in range(1, 16):
        if flags >> bit & 1 and end:
            size = shift = 0
            for j in range(1, 5):
                b = data[end - j] if end - j >= 0 else 0x80
                size |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            end -= min(size, end)
    if flags & 1 and end:
        end -= min((data[end - 1] & 3) + 1, end)
    return len(data) - end


def _decode(raw: bytes, encoding: int) -> str:
    if encoding != 65001:
        return raw.decode("cp1252", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:  # stray bytes are read one by one as the older set
        return _mixed(raw)


def _mixed(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(raw[i : i + 1].decode("cp1252", "replace"))
            i += 1
    return "".join(out)


def parse(raw: bytes) -> tuple[dict, str]:
    """(metadata, markup) of a file that isn't encrypted."""
    meta, text, _, encoding = _parsed(raw)
    return meta, _decode(text, encoding)


def _parsed(raw: bytes) -> tuple[dict, bytes, list[bytes], int]:
    """(metadata, text, records, character set) of a file that isn't encrypted."""
    recs = records(raw)
    head = recs[0]
    packing, _, length, count, _, crypto = struct.unpack(">HHIHHH", head[:14])
    if crypto:
        raise ValueError("the file is encrypted")
    if packing not in (1, 2, 17480):
        raise ValueError(f"compression {packing} isn't read")
    size, _, encoding = struct.unpack(">III", head[20:32])
    flags = struct.unpack(">H", head[242:244])[0] if len(head) >= 244 and size >= 228 else 0
    meta: dict[str, str] = {}
    full_at, full_size = struct.unpack(">II", head[84:92])
    meta["title"] = _decode(head[full_at : full_at + full_size], encoding)
    at = 16 + size
    if len(head) >= 132 and struct.unpack(">I", head[128:132])[0] & 0x40 and head[at : at + 4] == b"EXTH":
        for _ in range(struct.unpack(">I", head[at + 8 : at + 12])[0]):
            kind, n = struct.unpack(">II", head[at + 12 : at + 20])
            if kind in EXTH:
                meta.setdefault(EXTH[kind], _decode(head[at + 20 : at + 12 + n], encoding))
            at += n
    unpack = unpack_palmdoc if packing == 2 else bytes
    if packing == 17480:
        at, n = struct.unpack(">II", head[112:120])
        unpack = Huffman(recs[at], recs[at + 1 : at + n]).unpack
    text = b"".join(unpack(r[: len(r) - _trailing(r, flags)]) for r in recs[1 : count + 1])
    return meta, text[:length] if length else text, recs, encoding


_BREAK, _HEADING = re.compile(r"(?i)<mbp:pagebreak\s*/?>"), re.compile(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>")
_ENTRY = re.compile(r"(?is)<a\b[^>]*\bfilepos=[\"']?(\d+)[^>]*>(.*?)</a>")


def split_chapters(markup: str) -> list[tuple[str, str]]:
    """(title, text) by page breaks, else by headings of 100 characters at most, else whole.

    The part with most entries that point to places (two at least) is the table
    of contents; a part's title is the first entry that points into it, else
    its heading, else its number."""
    cuts = [m.end() for m in _BREAK.finditer(markup)] or [m.start() for m in _HEADING.finditer(markup) if 0 < len(block_text(m[2])) <= 100]
    edges = sorted({0, *cuts, len(markup)})
    parts = [markup[a:b] for a, b in zip(edges, edges[1:])]
    entries = [[(int(at), t) for at, inner in _ENTRY.findall(p) if len(t := block_text(inner)) >= 2] for p in parts]
    contents = max(entries, key=len, default=[])
    contents = contents if len(contents) >= 2 else []
    out, start = [], 0
    for p in parts:
        end = start + len(p.encode("utf-8"))
        text = block_text(_BREAK.sub("", p))
        if text:
            listed = next((t for at, t in contents if start <= at < end), None)
            head = _HEADING.search(p)
            title = listed or (block_text(head[2]) if head else "")
            out.append((title if 0 < len(title) <= 100 else f"第{len(out) + 1}部分", text))
        start = end
    return out


def mobi_items(raw: bytes) -> Iterator[tuple]:
    """(position, title, text, book's title, author)."""
    meta, text, recs, encoding = _parsed(raw)
    chapters = part_chapters(kf8.Book(recs, text)) if kf8.is_kf8(recs[0]) else split_chapters(_decode(text, encoding))
    for i, (title, chapter) in enumerate(chapters):
        yield i, title, chapter, meta.get("title"), meta.get("author")


def part_chapters(book: kf8.Book) -> list[tuple[str, str]]:
    """(title, text) of the parts with some text; a title is the first heading's, else the part's number."""
    out = []
    for i in range(len(book.parts)):
        markup = re.sub(r"(?is)<head\b.*?</head>", "", book.markup(i), count=1)
        text = block_text(markup)
        head = re.search(r"(?is)<h1\b[^>]*>(.*?)</h1>", markup)
        title = re.sub(r"\s+", " ", block_text(head[1])) if head else ""
        if len(re.sub(r"\s+", " ", text)) >= kf8.LEAST_TEXT:
            out.append((title if 0 < len(title) <= 100 else f"第{i + 1}部分", text))
    return out


def mobi_links(raw: bytes) -> Iterator[tuple]:
    """(part, part that it links to, anchor there) of a file in parts."""
    _, text, recs, _ = _parsed(raw)
    if kf8.is_kf8(recs[0]):
        yield from kf8.Book(recs, text).links()


def _exth(author: str) -> bytes:
    who = author.encode("utf-8")
    exth = struct.pack(">II", 100, 8 + len(who)) + who
    return b"EXTH" + struct.pack(">II", 12 + len(exth), 1) + exth


def _database(recs: list[bytes]) -> bytes:
    out = bytearray(b"\0" * 60 + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(recs)))
    at = 78 + 8 * len(recs)
    for i, r in enumerate(recs):
        out += struct.pack(">II", at, i)
        at += len(r)
    return bytes(out) + b"".join(recs)


def _text_records(text: bytes, packed: bool) -> list[bytes]:
    pieces = [text[i : i + 4096] for i in range(0, len(text), 4096)] or [b""]
    return [pack_palmdoc(p) if packed else p for p in pieces]


def _first_record(title: str, author: str, text: bytes, body: list[bytes], packed: bool, size: int, version: int) -> bytearray:
    """The record of 16 + size bytes that heads a file, with its metadata."""
    name, exth = title.encode("utf-8"), _exth(author)
    head = bytearray(16 + size)
    struct.pack_into(">HHIHHH", head, 0, 2 if packed else 1, 0, len(text), len(body), 4096, 0)
    head[16:20] = b"MOBI"
    struct.pack_into(">III", head, 20, size, 2, 65001)
    struct.pack_into(">I", head, kf8.VERSION, version)
    struct.pack_into(">II", head, 84, len(head) + len(exth), len(name))
    struct.pack_into(">I", head, 128, 0x40)
    return head + exth + name


def write_mobi(title: str, author: str, markup: str, packed: bool = True) -> bytes:
    """A small file in the old format, for round trips."""
    text = markup.encode("utf-8")
    body = _text_records(text, packed)
    return _database([bytes(_first_record(title, author, text, body, packed, 116, 6)), *body])


def write_kf8(title: str, author: str, chapters: list[tuple[str, list[str]]], style: str = "", packed: bool = True) -> bytes:
    """A file in parts: each chapter's title is in its skeleton, each piece of its markup a fragment."""
    text, tables = kf8.parts_records(chapters, style)
    body = _text_records(text, packed)
    head, at = _first_record(title, author, text, body, packed, 264 - 16, 8), 1 + len(body)
    for place, table in zip((kf8.SKELETONS, kf8.FRAGMENTS, kf8.FLOWS), tables):
        struct.pack_into(">I", head, place, at)
        at += len(table)
    return _database([bytes(head), *body, *[r for table in tables for r in table]])


def read_mobi_links(files: DataFrame, key: str = "path") -> DataFrame:
    """A row for each link inside of files in parts."""
    return rows(files, mobi_links, "part long, to_part long, anchor string", key)


def read_mobi(files: DataFrame, key: str = "path") -> DataFrame:
    return rows(files, mobi_items, "position long, title string, text string, book_title string, author string", key)
