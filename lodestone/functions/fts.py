"""Full-text match expressions: a query's grammar, compiled to columns over token arrays.

Precedence, tightest first: juxtaposition (and), NOT, AND, OR; all left to right.
A query that breaks the grammar matches nothing (strict), or is taken as a bag of
words joined by OR (not strict).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import fold_text

COLUMN = "content"


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Node:
    kind: str  # phrase, near, and, or, not
    parts: tuple = field(default=())
    gap: int = 10


_TOKEN = re.compile(r'\s+|(?P<quoted>"(?:[^"]|"")*")|(?P<bare>[A-Za-z0-9_\x1a\x80-\U0010ffff]+)|(?P<mark>[()+*^:{},-])')


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise QueryError(f"unexpected {query[at]!r}")
        at = m.end()
        if m.lastgroup == "quoted":
            out.append(("string", m["quoted"][1:-1].replace('""', '"')))
        elif m.lastgroup == "bare":
            word = m["bare"]
            out.append((word if word in ("AND", "OR", "NOT") else "bare", word))
        elif m.lastgroup:
            out.append((m["mark"], m["mark"]))
    return out


def words_of(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[\W_]+", fold_text(text)) if w)


class _Parser:
    def __init__(self, query: str):
        self.t, self.at = _lex(query), 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.at + k][0] if self.at + k < len(self.t) else ""

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.t) or (kind and self.peek() != kind):
            raise QueryError(f"expected {kind or 'more'}")
        self.at += 1
        return self.t[self.at - 1][1]

    def parse(self) -> Node | None:
        node = self.binary("OR", lambda: self.binary("AND", lambda: self.binary("NOT", self.run)))
        if self.at < len(self.t):
            raise QueryError(f"unexpected {self.peek()}")
        return node

    def binary(self, word: str, inner) -> Node | None:
        left = inner()
        while self.peek() == word:
            self.take()
            right = inner()
            # a side without any token drops out of AND and OR; nothing is left of "nothing NOT x"
            if left is None or right is None:
                left = left if word == "NOT" else (left or right) if word == "OR" else None
            else:
                left = Node(word.lower(), (left, right))
        return left

    def run(self) -> Node | None:
        if not self.starts():
            raise QueryError("a term is missing")
        left, group = self.primary()
        # groups in parentheses need an operator between them and what stands beside them
        while not group and self.starts():
            right, inner = self.primary()
            if inner:
                raise QueryError("an operator is missing")
            left = right if left is None else left if right is None else Node("and", (left, right))
        return left

    def starts(self) -> bool:
        return self.peek() in ("string", "bare", "(", "^", "{", "-")

    def primary(self) -> tuple[Node | None, bool]:
        if self.peek() == "-":
            raise QueryError("no such column")
        if self.peek() == "{":
            self.take()
            names = [self.take("bare")]
            while self.peek() == "bare":
                names.append(self.take())
            self.take("}")
            self.take(":")
            self.columns(names)
            return self.primary_after_column()
        if self.peek() in ("bare", "string") and self.peek(1) == ":":
            self.columns([self.take()])
            self.take(":")
            return self.primary_after_column()
        return self.primary_after_column()

    def columns(self, names: list[str]) -> None:
        if any(n.lower() != COLUMN for n in names):
            raise QueryError("no such column")

    def primary_after_column(self) -> tuple[Node | None, bool]:
        """(node, whether it was a group in parentheses)."""
        if self.peek() == "(":
            self.take()
            node = self.parse_inner()
            self.take(")")
            return node, True
        if self.peek() == "bare" and self.t[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.take()
            self.take("(")
            parts, gap = [self.phrase()], 10
            while self.peek() in ("string", "bare", "^"):
                parts.append(self.phrase())
            if self.peek() == ",":
                self.take()
                n = self.take("bare")
                if not n.isdigit():
                    raise QueryError("expected a number")
                gap = int(n)
            self.take(")")
            parts = [p for p in parts if p.words]
            return (Node("near", tuple(parts), gap) if len(parts) > 1 else Node("phrase", tuple(parts)) if parts else None), False
        p = self.phrase()
        return (Node("phrase", (p,)) if p.words else None), False

    def parse_inner(self) -> Node | None:
        return self.binary("OR", lambda: self.binary("AND", lambda: self.binary("NOT", self.run)))

    def phrase(self) -> Phrase:
        first = self.peek() == "^"
        if first:
            self.take()
        if self.peek() not in ("string", "bare"):
            raise QueryError("a term is missing")
        words = words_of(self.take())
        while self.peek() == "+":
            self.take()
            if self.peek() not in ("string", "bare"):
                raise QueryError("a term is missing")
            words += words_of(self.take())
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        return Phrase(words, prefix, first)


def parse(query: str, strict: bool = True) -> Node | None:
    """The query's tree; None where it matches nothing."""
    try:
        if not query.strip():
            raise QueryError("empty")
        return _Parser(query).parse()
    except QueryError:
        if strict:
            return None
        node = None
        for w in words_of(query):
            leaf = Node("phrase", (Phrase((w,)),))
            node = leaf if node is None else Node("or", (node, leaf))
        return node


def leaves(node: Node) -> list[tuple[Phrase, Node | None]]:
    """All phrases from left to right, each with its NEAR group, if any."""
    if node.kind == "phrase":
        return [(node.parts[0], None)]
    if node.kind == "near":
        return [(p, node) for p in node.parts]
    return [x for part in node.parts for x in leaves(part)]


def positions(tokens: Column, p: Phrase) -> Column:
    """Indices (from 0) at which a phrase begins."""
    n = len(p.words)
    *inner, final = p.words

    def at(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(inner):
            ok = ok & (F.get(tokens, i + k) == w)
        last = F.get(tokens, i + (n - 1))
        return ok & (last.startswith(final) if p.prefix else last == final)

    if p.first:
        return F.when((F.size(tokens) >= n) & at(F.lit(0)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(tokens) >= n, F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - n)), at)).otherwise(F.array().cast("array<int>"))


def occurrences(tokens: Column, p: Phrase) -> Column:
    """How often a phrase stands in the tokens."""
    if len(p.words) == 1 and not p.first:
        w = p.words[0]
        return F.size(F.filter(tokens, lambda x: x.startswith(w) if p.prefix else x == w))
    return F.size(positions(tokens, p))


def near(node: Node, p: Phrase, where: Callable[[Phrase], Column]) -> Column:
    """Positions of one member that have every other member within the gap; where gives a phrase's positions."""
    found = where(p)
    for q in node.parts:
        if q is p:
            continue
        other, here, there = where(q), len(p.words), len(q.words)
        close = lambda i, j: F.when(j >= i, j - (i + here) <= node.gap).otherwise(i - (j + there) <= node.gap)  # noqa: B023, E731
        found = F.filter(found, lambda i: F.exists(other, lambda j: close(i, j)))  # noqa: B023
    return found


def near_positions(tokens: Column, node: Node, p: Phrase) -> Column:
    return near(node, p, lambda q: positions(tokens, q))


def frequency(tokens: Column, p: Phrase, group: Node | None) -> Column:
    return occurrences(tokens, p) if group is None else F.size(near_positions(tokens, group, p))


def match(node: Node, present: dict[int, Column]) -> tuple[Column, list[Column]]:
    """(whether a row matches, for each leaf whether it counts in the row's score).

    present: for each leaf, by its number, whether it is in the row.  A leaf counts
    where it is present and every node above it matches the row.
    """
    numbers = iter(range(len(leaves(node))))

    def walk(n: Node) -> tuple[Column, list[Column]]:
        if n.kind in ("phrase", "near"):
            own = [present[next(numbers)] for _ in n.parts]
            return reduce(lambda a, b: a & b, own), own
        (left, counts_l), (right, counts_r) = walk(n.parts[0]), walk(n.parts[1])
        both = {"and": lambda: left & right, "or": lambda: left | right, "not": lambda: left & ~right}[n.kind]()
        if n.kind == "or":
            return both, counts_l + counts_r
        return both, [both & c for c in counts_l + counts_r]

    return walk(node)
