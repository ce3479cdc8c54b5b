"""Boolean tag expressions, compiled to one Column over a book's tag ids.

    expression = term ("OR" term)*      term = factor ("AND" factor)*
    factor = ["NO"] (tag | "(" expression ")")

Operators are upper case, tag names match whatever their case, and a tag holds
no space. An expression means clauses (a book needs a tag of each) and
excluded tags. Three properties are part of the language: a negated part adds
its tags to the excluded ones and gives no clause, so in ``A OR NO B`` nothing
is left of ``A``; a negated group excludes every tag in it; and a tag that is
followed by an operator without a space is cut before it. A tag that isn't
known never matches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = -1


@dataclass(frozen=True)
class Compiled:
    clauses: list[list[int]] = field(default_factory=list)
    excluded: frozenset[int] = frozenset()


class _Reader:
    """The query's characters, with the rule of where an operator word counts."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self) -> None:
        while self.text[self.at : self.at + 1] == " ":
            self.at += 1

    def operator(self, word: str, followers: str) -> bool:
        end = self.at + len(word)
        return self.text.startswith(word, self.at) and (end >= len(self.text) or self.text[end] in followers)

    def take(self, word: str, followers: str) -> bool:
        if not self.operator(word, followers):
            return False
        self.at += len(word)
        self.blank()
        return True

    def name(self) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in " ()" and not any(self.operator(w, " (") for w in ("AND", "OR", "NO")):
            self.at += 1
        return self.text[start : self.at]


def parse(text: str) -> tuple | None:
    """The tree: ("or" | "and", parts), ("no", part) or ("tag", name)."""
    if not text.strip():
        return None
    reader = _Reader(text.strip())

    def chain(kind: str, word: str, part):
        parts = [part()]
        reader.blank()
        while reader.at < len(reader.text) and reader.take(word, " (N"):
            parts.append(part())
            reader.blank()
        return parts[0] if len(parts) == 1 else (kind, parts)

    def factor():
        reader.blank()
        negated = reader.take("NO", " (")
        if reader.text[reader.at : reader.at + 1] == "(":
            reader.at += 1
            inner = expression()
            reader.blank()
            if reader.text[reader.at : reader.at + 1] == ")":
                reader.at += 1
        else:
            inner = ("tag", reader.name())
        return ("no", inner) if negated else inner

    def expression():
        return chain("or", "OR", lambda: chain("and", "AND", factor))

    return expression()


def compile_expression(text: str, tags: dict[str, int]) -> Compiled:
    ids = {name.lower(): i for name, i in tags.items()}
    excluded: set[int] = set()

    def clauses(node) -> list[set[int]]:
        kind, body = node
        if kind == "tag":
            return [{ids.get(body.lower(), UNKNOWN)}]
        if kind == "no":
            inner = clauses(body)
            found = set().union(*inner) if inner else set()
            # a group excludes whatever it names; a tag of its own must be known
            excluded.update(found if body[0] != "tag" else {i for i in found if i > 0})
            return []
        if kind == "and":
            return [c for part in body for c in clauses(part)]
        out = clauses(body[0])
        for part in body[1:]:
            right = clauses(part)
            out = [a | b for a in out for b in right]
        return out

    tree = parse(text)
    return Compiled([sorted(c) for c in clauses(tree)], frozenset(excluded)) if tree else Compiled()


def matches(compiled: Compiled, tags: Column) -> Column:
    """Whether an array of tag ids satisfies the expression; a null array is a book without tags."""
    have = F.coalesce(tags, F.array().cast("array<bigint>"))
    out = F.lit(True)
    for clause in compiled.clauses:
        out = out & F.arrays_overlap(have, F.array(*[F.lit(i).cast("bigint") for i in clause]))
    if compiled.excluded:
        out = out & ~F.arrays_overlap(have, F.array(*[F.lit(i).cast("bigint") for i in sorted(compiled.excluded)]))
    return out


def flat_terms(terms: list[tuple[int, str]]) -> list[list[int]]:
    """Groups of tags joined by AND; OR opens a new group."""
    groups: list[list[int]] = []
    for tag, operator in terms:
        if operator == "OR" or not groups:
            groups.append([])
        groups[-1].append(tag)
    return groups


def matches_any_group(groups: list[list[int]], tags: Column) -> Column:
    have = F.coalesce(tags, F.array().cast("array<bigint>"))
    out = F.lit(False)
    for g in groups:
        out = out | (F.size(F.array_except(F.array(*[F.lit(i).cast("bigint") for i in g]), have)) == 0)
    return out
