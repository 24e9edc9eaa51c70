"""The note query language: text to a tree of terms, date filters and exclusions.

``plan ::= or``, where NOT binds tighter than AND (also written by standing side by side), and AND tighter than OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime

from noteql.functions.dates import DateRange, QueryError, range_of

#: Fields whose values are dates, and short names for two of them.
DATE_FIELDS = ("modified", "created", "date", "review_due")
ALIASES = {"m": "modified", "c": "created"}


@dataclass(frozen=True)
class Term:
    """Text to find in one column (content or metadata), or in either."""

    text: str
    column: str | None = None


@dataclass(frozen=True)
class DateTerm:
    name: str
    range: DateRange


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass
class ParsedQuery:
    """What must match (None: everything), what must not, and ranges by date field."""

    expr: object | None
    excludes: list = field(default_factory=list)
    filters: dict[str, DateRange] = field(default_factory=dict)


_TOKEN = re.compile(
    r"""\s*(?: "(?P<text>(?:[^"\\]|\\.)*)" | (?P<open>\() | (?P<close>\)) | (?P<range>\.\.) | (?P<cmp>>=|<=|>|<) | (?P<colon>:)
    | (?P<word>(?:(?!\.\.)[^\s()":<>])+) )""",
    re.X | re.S,
)


def lex(text: str) -> list[tuple[str, str, bool]]:
    """(kind, value, glued to the token before) triples."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError("unterminated quote" if text[at:].lstrip().startswith('"') else f"unexpected text at {text[at : at + 20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        glued = bool(out) and m.start(kind) - (kind == "text") == at
        if kind == "text":
            value = re.sub(r"\\(.)", r"\1", value, flags=re.S)
        elif kind == "word" and value.upper() in ("AND", "OR", "NOT") and not (glued and out[-1][0] in ("colon", "cmp", "range")):
            kind, value = value.lower(), value.upper()
        out.append((kind, value, glued))
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens, now: datetime):
        self.tokens, self.at, self.now = tokens, 0, now

    def kind(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def expression(self):
        return self.chain("or", Or, lambda: self.chain("and", And, self.unary, implied=True))

    def chain(self, word: str, node, part, implied: bool = False):
        parts = [part()]
        while self.kind() == word or implied and self.kind() in ("word", "text", "open", "not"):
            if self.kind() == word:
                self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else node(tuple(parts))

    def unary(self):
        if self.kind() == "not":
            self.take()
            return Not(self.unary())
        if self.kind() == "open":
            self.take()
            inside = self.expression()
            if self.kind() != "close":
                raise QueryError("unmatched parenthesis")
            self.take()
            return inside
        if self.kind() == "text":
            return Term(self.take())
        if self.kind() != "word":
            raise QueryError(f"expected a term, found {self.kind() or 'the end'}")
        word = self.take()
        if self.kind() in ("colon", "cmp") and self.tokens[self.at][2]:
            return self.fielded(word)
        return Term(word)

    def fielded(self, name: str):
        if self.kind() == "colon":
            self.take()
        name = ALIASES.get(name.lower(), name)
        operator = self.take() if self.kind() == "cmp" else None
        if name.lower() in DATE_FIELDS:
            return DateTerm(name.lower(), self.dates(operator))
        if self.kind() not in ("word", "text"):
            raise QueryError(f"field {name!r} needs a value")
        value = self.value()
        if self.kind() == "range":
            self.take()
            value += ".." + (self.value() if self.kind() in ("word", "text") else "")
        if name == "content":
            return Term((operator or "") + value, "content")
        return Term(f"{name}:{operator or ''}{value}", "metadata")

    def value(self) -> str:
        """A value; an unquoted one may go on with colons, as clock times and addresses do."""
        out = self.take()
        while self.kind() == "colon" and self.tokens[self.at][2] and self.kind(1) == "word" and self.tokens[self.at + 1][2]:
            self.take()
            out += ":" + self.take()
        return out

    def dates(self, operator: str | None) -> DateRange:
        first = self.value() if self.kind() in ("word", "text") else None
        if operator:
            if first is None:
                raise QueryError("a comparison needs a date")
            return range_of(operator, first, None, self.now)
        if self.kind() == "range":
            self.take()
            second = self.value() if self.kind() in ("word", "text") and self.tokens[self.at][2] else None
            return range_of("..", first, second, self.now)
        if first is None:
            raise QueryError("a date filter needs a value")
        return range_of(None, first, None, self.now)


def parse(text: str, now: datetime | None = None) -> ParsedQuery:
    tokens = lex(text)
    if not tokens:
        raise QueryError("the query is empty")
    parser = _Parser(tokens, now or datetime.now(UTC))
    tree = parser.expression()
    if parser.kind() is not None:
        raise QueryError(f"unexpected {parser.kind()}")
    filters: dict[str, DateRange] = {}
    positive, excludes = _split(_lift(tree, filters, None))
    return ParsedQuery(positive, excludes, filters)


def _lift(node, filters: dict, under: str | None):
    """The tree without its date filters, which are gathered by field; None where nothing is left."""
    if isinstance(node, DateTerm):
        if under:
            raise QueryError(f"a date filter cannot stand under {under}")
        old = filters.get(node.name)
        both = node.range if old is None else old.intersect(node.range)
        if both is None:
            raise QueryError(f"the date filters on {node.name} exclude each other")
        filters[node.name] = both
        return None
    if isinstance(node, Not):
        return Not(_lift(node.part, filters, "NOT"))
    if isinstance(node, (And, Or)):
        parts = [_lift(p, filters, under or ("OR" if isinstance(node, Or) else None)) for p in node.parts]
        parts = tuple(p for p in parts if p is not None)
        return None if not parts else parts[0] if len(parts) == 1 else type(node)(parts)
    return node


def _split(node):
    """(what must match, what must not)."""
    if node is None:
        return None, []
    if isinstance(node, Not):
        _no_not(node.part)
        return None, [node.part]
    if isinstance(node, Or):
        _no_not(node)
        return node, []
    if isinstance(node, And):
        positive, excludes = [], []
        for p in node.parts:
            kept, out = _split(p)
            positive += [kept] * (kept is not None)
            excludes += out
        return (None if not positive else positive[0] if len(positive) == 1 else And(tuple(positive))), excludes
    return node, []


def _no_not(node) -> None:
    if isinstance(node, Not):
        raise QueryError("NOT cannot stand under OR or NOT")
    for p in getattr(node, "parts", ()):
        _no_not(p)


def clean_for_embedding(text: str) -> str:
    """Query text for the embedder: column prefixes and the letters AND, OR, NOT go, wherever they stand."""
    for part in ("content:", "metadata:", "AND", "OR", "NOT"):
        text = text.replace(part, " ")
    return " ".join(text.replace("(", " ").replace(")", " ").replace('"', " ").split())
