"""KF8, the newer part format of MOBI files: indexes, flows, and parts put together again.

The text of such a file is one stream. Its first flow holds, for each part of
the book, a skeleton and behind it the fragments that belong into it; two
indexes say where. Layout and codes follow the published format."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

#: Places in the first record of the version and of the numbers of the records that hold flows, fragments and skeletons.
VERSION, FLOWS, FRAGMENTS, SKELETONS = 0x24, 0xC0, 0xF8, 0xFC
#: Tags of index entries. COUNT: fragments of a skeleton; FILE and NUMBER: part and number of a fragment; PLACE: where it starts and how long it is.
COUNT, FILE, NUMBER, PLACE = 1, 3, 4, 6
#: Visible characters that a part needs to be a chapter.
LEAST_TEXT = 20
_LINK = re.compile(r"kindle:pos:fid:([0-9A-V]+):off:([0-9A-V]+)")
_NAME = re.compile(rb"""(?i)\b(?:id|name)\s*=\s*["']([^"']*)["']""")
_FLOW_LINK = re.compile(r"(?i)<link\b[^>]*kindle:flow:[^>]*>")
_AID = re.compile(r"""(?i)\s+aid\s*=\s*["'][^"']*["']""")


class Reader:
    """Numbers of seven bits a byte; the last byte of each has its high bit set."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def number(self) -> int:
        out = 0
        while self.at < len(self.data):
            byte = self.data[self.at]
            self.at += 1
            out = out << 7 | byte & 0x7F
            if byte & 0x80:
                return out
        raise ValueError("an index ends inside of a number")

    def numbers(self, count: int | None, size: int | None) -> list[int]:
        """So many numbers, or those of so many bytes."""
        if size is None:
            return [self.number() for _ in range(count or 0)]
        out, end = [], self.at + size
        while self.at < end:
            out.append(self.number())
        return out


@dataclass(frozen=True)
class Tag:
    name: int
    values: int
    mask: int
    ends: bool


def _header(record: bytes) -> tuple[int, int, int]:
    """(bytes of the header, where entries are listed, how many) of an index record."""
    if record[:4] != b"INDX":
        raise ValueError("not an index record")
    size, listed, count = (struct.unpack_from(">I", record, at)[0] for at in (4, 20, 24))
    return size, listed, count


def _tags(record: bytes, at: int) -> tuple[int, list[Tag]]:
    """(control bytes of an entry, the tags) of an index."""
    if record[at : at + 4] != b"TAGX":
        raise ValueError("an index without tags")
    end, controls = struct.unpack_from(">II", record, at + 4)
    return controls, [Tag(*record[p : p + 3], record[p + 3] == 1) for p in range(at + 12, at + end, 4)]


def _values(tags: list[Tag], controls: int, data: bytes, at: int) -> dict[int, list[int]]:
    """An entry's numbers by tag.

    A tag's bits of its control byte say how often its values come; bits that
    are all set, if there are several, say that a length in bytes follows.
    Lengths stand before all values."""
    reader, flags, asked = Reader(data, at + controls), iter(data[at : at + controls]), []
    flag = next(flags, 0)
    for tag in tags:
        if tag.ends:
            flag = next(flags, 0)
            continue
        bits, lowest = flag & tag.mask, tag.mask & -tag.mask
        if bits == tag.mask != lowest:
            asked.append((tag.name, None, reader.number()))
        elif bits:
            asked.append((tag.name, bits // lowest * tag.values, None))
    return {name: reader.numbers(count, size) for name, count, size in asked}


def index(records: list[bytes], at: int) -> Iterator[tuple[bytes, dict[int, list[int]]]]:
    """(label, numbers by tag) of each entry of the index whose first record is at."""
    if not 0 < at < len(records):
        raise ValueError("the file has no such index")
    size, _, pages = _header(records[at])
    controls, tags = _tags(records[at], size)
    for page in records[at + 1 : at + 1 + pages]:
        _, listed, count = _header(page)
        for start in struct.unpack_from(f">{count}H", page, listed + 4):
            text = start + 1
            after = text + page[start]
            yield page[text:after], _values(tags, controls, page, after)


def flows(records: list[bytes], at: int, text: bytes) -> list[bytes]:
    """The streams of a text: the first is markup, the others styles."""
    table = records[at] if 0 < at < len(records) else b""
    if table[:4] != b"FDST":
        raise ValueError("the file has no table of flows")
    count = struct.unpack_from(">I", table, 8)[0]
    return [text[a:b] for a, b in struct.iter_unpack(">II", table[12 : 12 + 8 * count])]


@dataclass(frozen=True)
class Fragment:
    place: int
    part: int
    length: int


def assembled(markup: bytes, skeletons: list[tuple[int, int, int]], fragments: list[Fragment]) -> list[bytes]:
    """The parts: each skeleton (fragments, start, length) with its fragments put in at their places, which count in the whole text."""
    out, rest = [], iter(fragments)
    for count, start, length in skeletons:
        part, at = bytearray(markup[start : start + length]), start + length
        for _ in range(count):
            fragment = next(rest, None)
            if fragment is None:
                raise ValueError("a skeleton lacks fragments")
            place = min(max(fragment.place - start, 0), len(part))
            part[place:place] = markup[at : at + fragment.length]
            at += fragment.length
        out.append(bytes(part))
    return out


class Book:
    """The parts of a file, and where its links lead."""

    def __init__(self, records: list[bytes], text: bytes):
        at = {k: struct.unpack_from(">I", records[0], k)[0] for k in (FLOWS, FRAGMENTS, SKELETONS)}
        first = lambda tags, name, n=0: (tags.get(name, []) + [0] * 2)[n]
        markup, *self.styles = flows(records, at[FLOWS], text)
        self.fragments = [Fragment(int(label.strip() or b"0"), first(tags, FILE), first(tags, PLACE, 1)) for label, tags in index(records, at[FRAGMENTS])]
        skeletons = [(first(tags, COUNT), first(tags, PLACE), first(tags, PLACE, 1)) for _, tags in index(records, at[SKELETONS])]
        self.parts = assembled(markup, skeletons, self.fragments)
        self.starts = [sum(map(len, self.parts[:i])) for i in range(len(self.parts) + 1)]
        self.names = [[(m.start(), m[1].decode("utf-8", "replace")) for m in _NAME.finditer(p)] for p in self.parts]

    def target(self, fragment: int, offset: int) -> tuple[int, str | None] | None:
        """(part, name of the first anchor from there on) that a link leads to; without an anchor, the fragment's own part."""
        if fragment >= len(self.fragments):
            return None
        place = self.fragments[fragment].place + offset
        if place < self.starts[-1]:
            part = bisect_right(self.starts, place) - 1
            name = next((n for at, n in self.names[part] if at >= place - self.starts[part]), None)
            if name is not None:
                return part, name
        return self.fragments[fragment].part, None

    def links(self) -> Iterator[tuple[int, int, str | None]]:
        """(part, part that it links to, anchor there)."""
        for i, part in enumerate(self.parts):
            for m in _LINK.finditer(part.decode("utf-8", "replace")):
                if (to := self.target(int(m[1], 32), int(m[2], 32))) is not None:
                    yield i, *to

    def markup(self, i: int) -> str:
        """A part without marks of its own format, its links as part<number>.xhtml#anchor."""

        def written(m: re.Match) -> str:
            to = self.target(int(m[1], 32), int(m[2], 32))
            return m[0] if to is None else f"part{to[0]}.xhtml" + (f"#{to[1]}" if to[1] is not None else "")

        return _LINK.sub(written, _AID.sub("", _FLOW_LINK.sub("", self.parts[i].decode("utf-8", "replace"))))


def is_kf8(head: bytes) -> bool:
    return len(head) > SKELETONS + 4 and struct.unpack_from(">I", head, VERSION)[0] >= 8


def _base32(n: int, width: int) -> str:
    out = ""
    while n or len(out) < width:
        out, n = "0123456789ABCDEFGHIJKLMNOPQRSTUV"[n & 31] + out, n >> 5
    return out


def link(fragment: int, offset: int = 0) -> str:
    return f"kindle:pos:fid:{_base32(fragment, 4)}:off:{_base32(offset, 10)}"


def _number(n: int) -> bytes:
    out = [n & 0x7F | 0x80]
    while n := n >> 7:
        out.append(n & 0x7F)
    return bytes(reversed(out))


def _index_records(tags: list[tuple[int, int, int]], entries: list[tuple[bytes, list[list[int]]]], page: int = 30_000) -> list[bytes]:
    """An index whose entries have each tag once: (tag, values, mask)."""
    body, pages, lists = b"", [], []
    flag = bytes([sum(mask for _, _, mask in tags)])
    for label, values in entries:
        entry = bytes([len(label)]) + label + flag + b"".join(_number(n) for some in values for n in some)
        if len(body) + len(entry) > page:
            pages.append((body, lists))
            body, lists = b"", []
        lists = [*lists, 192 + len(body)]
        body += entry
    pages.append((body, lists))
    head = lambda listed, n: b"INDX" + struct.pack(">12I", 192, 0, 1, 0, listed, n, 65001, 0xFFFFFFFF, len(entries), 0, 0, 0) + bytes(192 - 52)
    table = b"".join(bytes((*t, 0)) for t in tags) + bytes((0, 0, 0, 1))
    first = head(0, len(pages)) + b"TAGX" + struct.pack(">II", 12 + len(table), 1) + table
    return [first, *[head(192 + len(b), len(at)) + b + b"IDXT" + struct.pack(f">{len(at)}H", *at) for b, at in pages]]


def parts_records(chapters: list[tuple[str, list[str]]], style: str = "") -> tuple[bytes, list[bytes]]:
    """(text, records: skeletons, fragments, flows) of chapters (title, pieces of markup)."""
    text, skeletons, fragments = b"", [], []
    for part, (title, pieces) in enumerate(chapters):
        before, after = f'<html><head><link href="kindle:flow:0001?mime=text/css"/></head><body><h1 aid="{part}">{title}</h1>'.encode(), b"</body></html>"
        start, raw = len(text), [p.encode("utf-8") for p in pieces]
        skeletons.append((b"SKEL%010d" % part, [[len(raw)], [start, len(before + after)]]))
        place = start + len(before)
        for piece in raw:
            fragments.append((b"%010d" % place, [[part], [len(fragments)], [0, len(piece)]]))
            place += len(piece)
        text += before + after + b"".join(raw)
    css = style.encode("utf-8")
    flow = b"FDST" + struct.pack(">II", 12, 2) + struct.pack(">4I", 0, len(text), len(text), len(text) + len(css))
    return text + css, [_index_records([(COUNT, 1, 1), (PLACE, 2, 2)], skeletons), _index_records([(FILE, 1, 1), (NUMBER, 1, 2), (PLACE, 2, 4)], fragments), [flow]]
