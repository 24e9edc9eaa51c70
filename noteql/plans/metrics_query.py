"""The metrics query language: words, and key:, source:, file:, note: and date: filters, all of which must hold."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from noteql.functions.dates import DateRange, QueryError, range_of
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class MetricsQuery:
    keys: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    dates: DateRange | None = None

    def predicate(self) -> Column:
        """All filters as one Column on metric records. Percent signs and underscores in terms stay wildcards."""
        test = F.lit(True)
        for name, values in (("key", self.keys), ("source", self.sources)):
            for v in values:
                test = test & (F.lower(name) == v.lower())
        for name, values in (("source_file", self.files), ("note", self.notes)):
            for v in values:
                test = test & _like(F.col(name), v)
        for v in self.terms:
            test = test & F.coalesce(*[F.when(_like(F.col(c), v), F.lit(True)) for c in ("note", "raw_line", "source_file", "tags_json", "context_json", "extra_fields_json")], F.lit(False))
        if self.dates is not None:
            test = test & self.dates.contains(F.coalesce(F.col("date").cast("timestamp"), F.col("ts_utc")))
        return test

    def pruning(self) -> Column:
        """What must hold of kept rows, which come by ``key_lower`` and ``day``: whole files and row groups are passed
        over by it. A day may be one off the instant it is of, by the time zone of a record."""
        test = F.lit(True)
        for v in self.keys:
            test = test & (F.col("key_lower") == v.lower())
        if self.dates is not None:
            for bound, sign in ((self.dates.start, -1), (self.dates.end, 1)):
                if bound is not None:
                    day = F.lit((bound.at + timedelta(days=sign)).date())
                    test = test & (F.col("day") >= day if sign < 0 else F.col("day") <= day)
        return test


def _like(column: Column, term: str) -> Column:
    return F.lower(column).like("%" + term.lower().replace("\\", "\\\\") + "%")


def split_words(text: str) -> list[str]:
    """Words between white space; single or double quotes hold white space together and go."""
    out, word, quote, begun = [], "", None, False
    for c in text:
        if quote:
            quote, word = (None, word) if c == quote else (quote, word + c)
        elif c in "\"'":
            quote, begun = c, True
        elif c.isspace():
            if begun or word:
                out.append(word)
            word, begun = "", False
        else:
            word += c
    if quote:
        raise QueryError("unterminated quote")
    return out + [word] * bool(begun or word)


def date_range(text: str, now: datetime) -> DateRange:
    for operator in (">=", "<=", ">", "<"):
        if text.startswith(operator):
            return range_of(operator, text[len(operator) :], None, now)
    if ".." in text:
        first, _, second = text.partition("..")
        return range_of("..", first or None, second or None, now)
    return range_of(None, text, None, now)


def parse(text: str, now: datetime | None = None) -> MetricsQuery:
    now = now or datetime.now(UTC)
    out = MetricsQuery()
    lists = {"key": out.keys, "source": out.sources, "file": out.files, "note": out.notes}
    for word in split_words(text):
        name, colon, value = word.partition(":")
        if colon and name.lower() == "date":
            found = date_range(value, now)
            out.dates = found if out.dates is None else out.dates.intersect(found)
            if out.dates is None:
                raise QueryError("the date filters exclude each other")
        elif colon and name.lower() in lists:
            if not value:
                raise QueryError(f"{name}: needs a value")
            lists[name.lower()].append(value)
        else:
            out.terms.append(word)
    return out
