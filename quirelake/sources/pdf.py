"""The structure of PDF files: objects, cross-references, pages, outline, metadata.

Pages are counted and outlines read; what is drawn on a page isn't. Encrypted
files and streams packed in other ways than Flate are refused."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, islice

from pyspark.sql import DataFrame

from .archives import rows

_SPACE, _NUMERIC = b"\0\t\n\f\r ", b"0123456789+-."
_BLANK = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*+")
_WORD = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]*")
_HEX, _NOT_HEX = re.compile(rb"#([0-9A-Fa-f]{2})"), re.compile(rb"[^0-9A-Fa-f]")
_PLAIN, _OCTAL, _LINE = re.compile(rb"[^()\\]+"), re.compile(rb"[0-7]{1,3}"), re.compile(rb"\r\n|\r|\n")
#: White space and comments, then a reference, a number, a name, hexadecimal digits, or a mark of a dictionary or a list.
_TOKEN = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*+(?:(\d+)[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])|([+-]?(?:\d+\.?\d*|\.\d+))|/([^\0\t\n\f\r ()<>\[\]{}/%]*)|(<<)|<([^>]*)>|(\[)|(>>)|(\]))")
_ENDSTREAM = re.compile(rb"[\0\t\n\f\r ]*endstream")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_OBJECT = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Page boxes are points; objects within objects and outlines are followed so deep.
DEEPEST = 200
BOX = (0.0, 0.0, 612.0, 792.0)


class Name(str):
    """A name of the file's own, as /Type."""


@lru_cache(4096)
def _name(word: bytes) -> Name:
    return Name((_HEX.sub(lambda m: bytes([int(m[1], 16)]), word) if b"#" in word else word).decode("latin-1"))


def _number(word: bytes) -> int | float:
    return float(word) if b"." in word else int(word)


def _from_hex(inside: bytes) -> bytes:
    digits = _NOT_HEX.sub(b"", inside)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _dictionary(items: list) -> dict:
    return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes


class Lexer:
    """Objects from bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        if self.at < len(self.data):
            self.at = _BLANK.match(self.data, self.at).end()

    def word(self) -> bytes:
        m = _WORD.match(self.data, self.at)
        self.at = max(self.at, m.end())
        return m[0]

    def object(self, depth: int = 0):
        self.skip()
        return self._here(depth)

    def _here(self, depth: int):
        """The object at this byte, which is no white space."""
        if depth > DEEPEST:
            raise ValueError("objects are nested too deep")
        data = self.data
        first = data[self.at : self.at + 1]
        if first in _NUMERIC:
            if m := _REFERENCE.match(data, self.at):
                self.at = m.end()
                return Ref(int(m[1]))
            if m := _NUMBER.match(data, self.at):
                self.at = m.end()
                return _number(m[0])
        if first == b"/":
            self.at += 1
            return _name(self.word())
        if first == b"(":
            return self._literal()
        if data.startswith(b"<<", self.at):
            self.at += 2
            return _dictionary(self._until(b">>", depth))
        if first == b"<":
            end = data.find(b">", self.at)
            inside = data[self.at + 1 : end]
            self.at = end + 1 if end >= 0 else len(data)
            return _from_hex(inside)
        if first == b"[":
            self.at += 1
            return self._until(b"]", depth)
        word = self.word()
        if not word:
            raise ValueError(f"no object at byte {self.at}")
        return {b"true": True, b"false": False}.get(word)

    def _until(self, mark: bytes, depth: int) -> list:
        out = []
        while True:
            # most are told by one search; what is rare, broken or too deep takes the general way
            m = _TOKEN.match(self.data, self.at) if depth < DEEPEST else None
            kind = m.lastindex if m else 0
            if 0 < kind < 7:
                self.at = m.end()
                if kind == 1:
                    out.append(Ref(int(m[1])))
                elif kind == 2:
                    out.append(_number(m[2]))
                elif kind == 3:
                    out.append(_name(m[3]))
                elif kind == 4:
                    out.append(_dictionary(self._until(b">>", depth + 1)))
                elif kind == 5:
                    out.append(_from_hex(m[5]))
                else:
                    out.append(self._until(b"]", depth + 1))
                continue
            if kind and m[kind] == mark:
                self.at = m.end()
                return out
            self.skip()
            if self.data.startswith(mark, self.at):
                self.at += len(mark)
                return out
            if self.at >= len(self.data):
                raise ValueError("the file ends inside of an object")
            out.append(self._here(depth + 1))

    def _literal(self) -> bytes:
        out, depth = bytearray(), 0
        while self.at < len(self.data):
            if m := _PLAIN.match(self.data, self.at):
                out += m[0]
                self.at = m.end()
                continue
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                if m := _OCTAL.match(self.data, self.at):
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                elif m := _LINE.match(self.data, self.at):
                    self.at = m.end()
                else:
                    c = self.data[self.at : self.at + 1]
                    out += _ESCAPES.get(c, c)
                    self.at += 1
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                return bytes(out)
            if c != b"(" or depth > 1:
                out += c
        raise ValueError("the file ends inside of a string")


def _unpredicted(data: bytes, how: dict) -> bytes:
    """Rows as they were before each was written as differences to its neighbours."""
    kind = how.get("Predictor", 1)
    if kind < 2:
        return data
    bits = how.get("BitsPerComponent", 8)
    step, width = max(1, how.get("Colors", 1) * bits // 8), (how.get("Columns", 1) * how.get("Colors", 1) * bits + 7) // 8
    if kind == 2:
        if bits != 8:
            raise ValueError("this predictor isn't read")
        out = bytearray(data)
        for start in range(0, len(out), width):
            for i in range(start + step, min(start + width, len(out))):
                out[i] = out[i] + out[i - step] & 255
        return bytes(out)
    out, above = bytearray(), bytes(width)
    for start in range(0, len(data), width + 1):
        how_row, row = data[start], bytearray(data[start + 1 : start + 1 + width])
        if how_row == 2:
            row, how_row = bytearray((x + y) & 255 for x, y in zip(row, above)), 0
        for i in range(len(row)) if how_row in (1, 3, 4) else ():
            left, up, corner = (row[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
            match how_row:
                case 1:
                    add = left
                case 3:
                    add = (left + up) // 2
                case 4:
                    guess = left + up - corner
                    add = min((left, up, corner), key=lambda x: abs(guess - x))
                case _:
                    add = 0
            row[i] = row[i] + add & 255
        above = bytes(row) + bytes(width - len(row))
        out += row
    return bytes(out)


@dataclass
class Document:
    raw: bytes
    places: dict[int, tuple[int, int | None]] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    known: dict[int, object] = field(default_factory=dict)
    held: dict[int, dict[int, object]] = field(default_factory=dict)

    def __post_init__(self):
        if b"%PDF-" not in self.raw[:1024]:
            raise ValueError("not a PDF file")
        starts = re.findall(rb"startxref\s+(\d+)", self.raw[-2048:])
        try:
            if not starts:
                raise ValueError("no cross-references")
            self._references(int(starts[-1]))
        except (ValueError, TypeError, IndexError, zlib.error):
            self._searched()
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            self._searched()
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise ValueError("the file has no catalogue")

    def _references(self, start: int) -> None:
        """Tables and streams of cross-references, the newest first: what stands first counts."""
        todo, seen = [start], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            lexer = Lexer(self.raw, at)
            lexer.skip()
            if self.raw.startswith(b"xref", lexer.at):
                lexer.at += 4
                head = self._table(lexer)
            else:
                stream = self._at(at)
                if not isinstance(stream, Stream):
                    raise ValueError("no cross-references there")
                head = stream.head
                self._stream_table(stream)
            self.trailer = head | self.trailer
            todo += [head[k] for k in ("XRefStm", "Prev") if isinstance(head.get(k), int)]

    def _table(self, lexer: Lexer) -> dict:
        row = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
        part = re.compile(rb"\s*(\d+)\s+(\d+)(?=\s)")
        while not (m := re.compile(rb"\s*trailer").match(self.raw, lexer.at)):
            if (m := part.match(self.raw, lexer.at)) is None:
                raise ValueError("a broken table of cross-references")
            lexer.at = m.end()
            for number in range(int(m[1]), int(m[1]) + int(m[2])):
                if (r := row.match(self.raw, lexer.at)) is None:
                    raise ValueError("a broken table of cross-references")
                lexer.at = r.end()
                if r[3] == b"n":
                    self.places.setdefault(number, (int(r[1]), None))
        lexer.at = m.end()
        return lexer.object()

    def _stream_table(self, stream: Stream) -> None:
        data, widths = self.bytes_of(stream), stream.head["W"]
        size = sum(widths)
        parts = stream.head.get("Index") or [0, stream.head["Size"]]
        numbers = (n for a, k in zip(parts[::2], parts[1::2]) for n in range(a, a + k))
        for number, at in zip(numbers, range(0, len(data) - size + 1, size)):
            values = []
            for w in widths:
                values.append(int.from_bytes(data[at : at + w], "big") if w else None)
                at += w
            kind = 1 if values[0] is None else values[0]
            if kind == 1:
                self.places.setdefault(number, (values[1] or 0, None))
            elif kind == 2:
                self.places.setdefault(number, (values[1], values[2] or 0))

    def _searched(self) -> None:
        """Objects by their marks, the last of a number counting: for files whose cross-references are broken."""
        self.known.clear()
        self.places = {int(m[1]): (m.start(), None) for m in _OBJECT.finditer(self.raw)}
        for number, (at, _) in list(self.places.items()):
            try:
                found = self._at(at)
            except (ValueError, IndexError):
                continue
            head = found.head if isinstance(found, Stream) else found
            if isinstance(found, Stream) and head.get("Type") == "ObjStm":
                for inner, value in self._packed(number).items():
                    self.places.setdefault(inner, (number, 0))
                    if isinstance(value, dict) and value.get("Type") == "Catalog":
                        self.trailer["Root"] = Ref(inner)
            if isinstance(found, Stream) and head.get("Type") == "XRef":
                self.trailer |= {k: head[k] for k in ("Root", "Info", "ID", "Encrypt") if k in head}
            if isinstance(head, dict) and head.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(number)
        for m in re.finditer(rb"trailer", self.raw):
            try:
                self.trailer |= Lexer(self.raw, m.end()).object()
            except (ValueError, TypeError):
                continue

    def _at(self, at: int):
        m = _OBJECT.match(self.raw, at) or _OBJECT.match(self.raw, at + len(self.raw[at : at + 8]) - len(self.raw[at : at + 8].lstrip(_SPACE)))
        if m is None:
            raise ValueError(f"no object at byte {at}")
        lexer = Lexer(self.raw, m.end())
        found = lexer.object()
        lexer.skip()
        if not isinstance(found, dict) or not self.raw.startswith(b"stream", lexer.at):
            return found
        start = lexer.at + 6
        start += 2 if self.raw.startswith(b"\r\n", start) else 1
        size = self.get(found.get("Length"))
        end = start + size if isinstance(size, int) and size >= 0 and _ENDSTREAM.match(self.raw, start + size) else self.raw.find(b"endstream", start)
        return Stream(found, self.raw[start : end if end >= 0 else len(self.raw)])

    def bytes_of(self, stream: Stream) -> bytes:
        names, how = self.get(stream.head.get("Filter")) or [], self.get(stream.head.get("DecodeParms")) or {}
        names, how = names if isinstance(names, list) else [names], how if isinstance(how, list) else [how]
        data = stream.raw
        for i, name in enumerate(names):
            if name != "FlateDecode":
                raise ValueError(f"streams of {name} aren't read")
            data = _unpredicted(zlib.decompressobj().decompress(data), (self.get(how[i]) if i < len(how) else None) or {})
        return data

    def _packed(self, number: int) -> dict[int, object]:
        """The objects of a stream of objects."""
        if number not in self.held:
            stream = self.get(Ref(number))
            if not isinstance(stream, Stream):
                raise ValueError("no stream of objects there")
            data, first = self.bytes_of(stream), self.get(stream.head["First"])
            pairs = [int(x) for x in islice(data[:first].split(), 2 * self.get(stream.head["N"]))]
            self.held[number] = {n: Lexer(data, first + at).object() for n, at in zip(pairs[::2], pairs[1::2])}
        return self.held[number]

    def get(self, value, depth: int = 0):
        """value, or what it refers to; None for a reference to nothing."""
        while isinstance(value, Ref) and depth < DEEPEST:
            depth += 1
            number = value.number
            if number not in self.known:
                at, inside = self.places.get(number, (None, None))
                self.known[number] = None
                if at is not None:
                    self.known[number] = self._at(at) if inside is None else self._packed(at).get(number)
            value = self.known[number]
        return value

    @property
    def root(self) -> dict:
        return self.get(self.trailer["Root"])

    def pages(self) -> Iterator[tuple[int | None, dict]]:
        """(object's number, page with what it inherits) in order; a node that is its own ancestor is left out."""
        inherited = ("MediaBox", "CropBox", "Rotate", "Resources")
        todo, seen = [(self.root.get("Pages"), {})], set()
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            number = ref.number if isinstance(ref, Ref) else None
            if not isinstance(node, dict) or number in seen:
                continue
            if number is not None:
                seen.add(number)
            own = above | {k: node[k] for k in inherited if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                todo += [(k, own) for k in reversed(kids)]
            else:
                yield number, node | own

    def _named(self, name) -> object:
        """The place that a named destination stands for."""
        old = self.get(self.root.get("Dests"))
        if isinstance(name, Name) and isinstance(old, dict):
            return self.get(old.get(name))
        todo, seen = [(self.get(self.root.get("Names")) or {}).get("Dests")], 0
        while todo and seen < 100_000:
            node, seen = self.get(todo.pop()), seen + 1
            if not isinstance(node, dict):
                continue
            pairs = self.get(node.get("Names")) or []
            for k, v in zip(pairs[::2], pairs[1::2]):
                if self.get(k) == name:
                    return self.get(v)
            todo += self.get(node.get("Kids")) or []
        return None

    def outline(self) -> Iterator[tuple[int, str, int | None]]:
        """(depth, title, number of the page from 0) of the outline's entries in order."""
        numbers = {number: i for i, (number, _) in enumerate(self.pages()) if number is not None}
        first = (self.get(self.root.get("Outlines")) or {}).get("First")
        todo, seen = [(first, 0)], set()
        while todo:
            ref, depth = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen or depth > DEEPEST:
                continue
            seen.add(ref)
            action = self.get(node.get("A"))
            to = self.get(node["Dest"] if "Dest" in node else action.get("D") if isinstance(action, dict) and action.get("S") == "GoTo" else None)
            if isinstance(to, (bytes, Name)):
                to = self._named(to)
            if isinstance(to, dict):
                to = self.get(to.get("D"))
            page = to[0] if isinstance(to, list) and to else None
            yield depth, text(self.get(node.get("Title"))) or "", numbers.get(page.number) if isinstance(page, Ref) else page if isinstance(page, int) else None
            todo += [(node.get("Next"), depth), (node.get("First"), depth + 1)]

    def metadata(self) -> dict[str, str | None]:
        info = self.get(self.trailer.get("Info")) or {}
        ids = self.get(self.trailer.get("ID")) or []
        found = {k.lower(): text(self.get(info.get(k))) for k in ("Title", "Author")}
        prefers = self.get(self.root.get("ViewerPreferences")) or {}
        return found | {"identifier": self.get(ids[0]).hex() if ids and isinstance(self.get(ids[0]), bytes) else None, "direction": "rtl" if prefers.get("Direction") == "R2L" else "ltr"}


def text(value) -> str | None:
    """A text string; None if it is none or blank."""
    if not isinstance(value, bytes):
        return None
    for mark, encoding in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if value.startswith(mark):
            return value[len(mark) :].decode(encoding, "replace").strip() or None
    return value.decode("latin-1").strip() or None


def info_items(raw: bytes) -> Iterator[tuple]:
    """(pages, title, author, identifier, direction)."""
    d = Document(raw)
    m = d.metadata()
    yield sum(1 for _ in d.pages()), m["title"], m["author"], m["identifier"], m["direction"]


def page_items(raw: bytes) -> Iterator[tuple]:
    """(position, width, height) in points, turned as the page is shown."""
    d = Document(raw)
    for i, (_, page) in enumerate(d.pages()):
        box = [d.get(x) for x in d.get(page.get("CropBox")) or d.get(page.get("MediaBox")) or BOX]
        size = abs(box[2] - box[0]), abs(box[3] - box[1])
        yield i, *map(float, size[::-1] if (d.get(page.get("Rotate")) or 0) % 180 else size)


def outline_items(raw: bytes) -> Iterator[tuple]:
    """(position, depth, title, page) of each entry of the outline."""
    for i, (depth, title, page) in enumerate(Document(raw).outline()):
        yield i, depth, title, page


def read_info(files: DataFrame, key: str = "path") -> DataFrame:
    """A row for each file; one that can't be read has its error."""
    return rows(files, info_items, "pages long, title string, author string, identifier string, direction string", key)


def read_pages(files: DataFrame, key: str = "path") -> DataFrame:
    return rows(files, page_items, "position long, width double, height double", key)


def read_outline(files: DataFrame, key: str = "path") -> DataFrame:
    return rows(files, outline_items, "position long, depth int, title string, page long", key)


def _written(value) -> bytes:
    match value:
        case bool():
            return b"true" if value else b"false"
        case Name():
            return b"/" + value.encode("latin-1")
        case Ref():
            return b"%d 0 R" % value.number
        case bytes():
            return b"<" + value.hex().encode() + b">"
        case dict():
            return b"<<" + b" ".join(b"/" + k.encode() + b" " + _written(v) for k, v in value.items()) + b">>"
        case list():
            return b"[" + b" ".join(map(_written, value)) + b"]"
    return str(value).encode()


def write_pdf(title: str, author: str, pages: int, entries: list[tuple[int, str, int]], packed: bool = True) -> bytes:
    """A file of empty pages with an outline of (depth, title, page).

    packed: objects in a compressed stream with a predictor on the
    cross-references, as new files have; else plain objects and a table."""
    tell = lambda s: b"\xfe\xff" + s.encode("utf-16-be")
    first_page, first_entry = 5, 5 + pages
    number = lambda i: Ref(first_entry + i)
    objects: dict[int, object] = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2), "Outlines": Ref(3)},
        2: {"Type": Name("Pages"), "Count": pages, "Kids": [Ref(first_page + i) for i in range(pages)], "MediaBox": [0, 0, 300, 400]},
        3: {"Type": Name("Outlines")} | ({"First": number(0)} if entries else {}),
        4: {"Title": tell(title), "Author": tell(author)},
    }
    objects |= {first_page + i: {"Type": Name("Page"), "Parent": Ref(2)} for i in range(pages)}
    # from the last entry back: those that no later one at their depth or above hides, the nearest on top
    after, open_ = [None] * len(entries), []
    for i in range(len(entries) - 1, -1, -1):
        while open_ and entries[open_[-1]][0] > entries[i][0]:
            open_.pop()
        after[i] = open_[-1] if open_ else None
        open_.append(i)
    for i, (depth, name, page) in enumerate(entries):
        links = {"First": number(i + 1)} if i + 1 < len(entries) and entries[i + 1][0] > depth else {}
        if after[i] is not None and entries[after[i]][0] == depth:
            links["Next"] = number(after[i])
        objects[first_entry + i] = {"Title": tell(name), "Dest": [Ref(first_page + page), Name("Fit")]} | links
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def put(n: int, body: bytes) -> None:
        places[n] = len(out)
        out.extend(b"%d 0 obj\n" % n + body + b"\nendobj\n")

    def stream(head: dict, data: bytes) -> bytes:
        squeezed = zlib.compress(data)
        return _written(head | {"Filter": Name("FlateDecode"), "Length": len(squeezed)}) + b"\nstream\n" + squeezed + b"\nendstream"

    trailer = {"Root": Ref(1), "Info": Ref(4), "ID": [b"\x01\x02", b"\x03"]}
    if not packed:
        for n, value in objects.items():
            put(n, _written(value))
        at = len(out)
        out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(objects)))
        out.extend(b"trailer\n" + _written(trailer | {"Size": len(objects) + 1}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)
        return bytes(out)
    holder, table = len(objects) + 1, len(objects) + 2
    bodies = [_written(v) for v in objects.values()]
    starts = [0, *accumulate(len(b) + 1 for b in bodies)]
    index = b" ".join(b"%d %d" % pair for pair in zip(objects, starts)) + b"\n"
    put(holder, stream({"Type": Name("ObjStm"), "N": len(bodies), "First": len(index)}, index + b"\n".join(bodies)))
    at = len(out)
    entry = lambda kind, a, b: bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
    rows_ = [entry(0, 0, 0), *[entry(2, holder, i) for i in range(len(bodies))], entry(1, places[holder], 0), entry(1, at, 0)]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above)) for r, above in zip(rows_, [bytes(7), *rows_]))
    put(table, stream(trailer | {"Type": Name("XRef"), "Size": table + 1, "W": [1, 4, 2], "DecodeParms": {"Predictor": 12, "Columns": 7}}, up))
    out.extend(b"startxref\n%d\n%%%%EOF\n" % at)
    return bytes(out)
