"""Date literals and ranges of the query languages, and their translation to microsecond intervals and Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = timedelta(microseconds=1)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class QueryError(ValueError):
    """A query text that has no meaning."""


@dataclass(frozen=True)
class Bound:
    at: datetime
    inclusive: bool = True


@dataclass(frozen=True)
class DateRange:
    """An interval of instants; a missing end is open."""

    start: Bound | None = None
    end: Bound | None = None

    def micros(self) -> tuple[int | None, int | None]:
        """The closed interval of microseconds since 1970: exclusive ends move one microsecond inwards."""
        low = None if self.start is None else to_micros(self.start.at) + (not self.start.inclusive)
        high = None if self.end is None else to_micros(self.end.at) - (not self.end.inclusive)
        return low, high

    def intersect(self, other: DateRange) -> DateRange | None:
        """The common part; None if it is empty."""
        low = _tighter(self.start, other.start, max)
        high = _tighter(self.end, other.end, min)
        both = DateRange(low, high)
        a, b = both.micros()
        return None if a is not None and b is not None and a > b else both

    def contains(self, instant: Column) -> Column:
        """Predicate on a timestamp column; null instants never match."""
        low, high = self.micros()
        tests = [instant >= F.timestamp_micros(F.lit(low))] * (low is not None) + [instant <= F.timestamp_micros(F.lit(high))] * (high is not None)
        out = instant.isNotNull()
        for t in tests:
            out = out & t
        return out

    def overlaps_day(self, day: Column) -> Column:
        """Whether the range meets [day, day + 1 day - 1 microsecond], for a date column."""
        low, high = self.micros()
        first = F.unix_micros(day.cast("timestamp"))
        last = first + F.lit(86_400_000_000 - 1)
        out = day.isNotNull()
        if low is not None:
            out = out & (last >= F.lit(low))
        if high is not None:
            out = out & (first <= F.lit(high))
        return out


def _tighter(a: Bound | None, b: Bound | None, pick) -> Bound | None:
    if a is None or b is None:
        return a or b
    if a.at == b.at:
        return Bound(a.at, a.inclusive and b.inclusive)
    return a if pick(a.at, b.at) == a.at else b


def to_micros(at: datetime) -> int:
    return (at - EPOCH) // MICRO


def midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=UTC)


def add_months(at: datetime, months: int) -> datetime:
    """Months later, the day clamped to the month's last."""
    year, month = divmod(at.year * 12 + at.month - 1 + months, 12)
    last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return at.replace(year=year, month=month + 1, day=min(at.day, last))


_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
_CLOCK = re.compile(r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?)")
_OFFSET = re.compile(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})")


def absolute(text: str) -> tuple[datetime, bool]:
    """(instant, is a whole day) of an absolute literal: RFC 3339, a day and clock time, or a day, else in UTC."""
    try:
        if _OFFSET.fullmatch(text):
            return datetime.fromisoformat(text.upper().replace(" ", "T")).astimezone(UTC), False
        if m := _CLOCK.fullmatch(text):
            return datetime.fromisoformat(f"{m[1]}T{m[2]}").replace(tzinfo=UTC), False
        if _DAY.fullmatch(text):
            return midnight(date.fromisoformat(text)), True
    except ValueError:
        pass
    raise QueryError(f"invalid date literal {text!r}")


def day_range(at: datetime) -> DateRange:
    return DateRange(Bound(at), Bound(at + timedelta(days=1), False))


def month_range(text: str) -> DateRange | None:
    """The whole month of ``YYYY-MM``; None if the text has another form."""
    if not (m := re.fullmatch(r"(\d{4})-(\d{2})", text)):
        return None
    if not 1 <= int(m[2]) <= 12 or int(m[1]) == 0:
        raise QueryError(f"invalid month {text!r}")
    first = datetime(int(m[1]), int(m[2]), 1, tzinfo=UTC)
    return DateRange(Bound(first), Bound(add_months(first, 1), False))


def relative_range(text: str, now: datetime) -> DateRange | None:
    """The range of ``past7d``, ``next2w``, ``today``, ``lastmonth`` and their like; None if the text has another form."""
    word = text.lower()
    if m := re.fullmatch(r"(past|next)(.*)", word):
        if not (n := re.fullmatch(r"(\d+)([dwm])", m[2])):
            raise QueryError(f"invalid relative date {text!r}")
        size = int(n[1])
        if size < 1:
            raise QueryError("a relative date needs a length of at least 1")
        sign = -1 if m[1] == "past" else 1
        other = add_months(now, sign * size) if n[2] == "m" else now + sign * size * timedelta(days=7 if n[2] == "w" else 1)
        return DateRange(Bound(min(now, other)), Bound(max(now, other)))
    today = midnight(now.date())
    monday = today - timedelta(days=today.weekday())
    first = today.replace(day=1)
    spans = {
        "today": (today, today + timedelta(days=1)),
        "yesterday": (today - timedelta(days=1), today),
        "thisweek": (monday, monday + timedelta(days=7)),
        "lastweek": (monday - timedelta(days=7), monday),
        "thismonth": (first, add_months(first, 1)),
        "lastmonth": (add_months(first, -1), first),
    }
    if word in spans:
        return DateRange(Bound(spans[word][0]), Bound(spans[word][1], False))
    return None


def literal_range(text: str, now: datetime) -> DateRange:
    """The range a bare literal stands for: relative, a month, a whole day or an instant."""
    found = relative_range(text, now) or month_range(text)
    if found:
        return found
    at, whole = absolute(text)
    return day_range(at) if whole else DateRange(Bound(at), Bound(at))


def literal_bound(text: str, now: datetime, lower: bool, inclusive: bool) -> Bound:
    """One end of a range. Of a literal that is a range itself the near or far end counts, so that ``>`` starts after
    and ``<=`` ends with it; an absolute day counts as its midnight."""
    found = relative_range(text, now)
    ends_first = lower == inclusive
    if found:
        pick = (found.start or found.end) if ends_first else (found.end or found.start)
        return Bound(pick.at, inclusive)
    if found := month_range(text):
        return Bound((found.start if ends_first else _last(found.end)).at, inclusive)
    return Bound(absolute(text)[0], inclusive)


def _last(end: Bound) -> Bound:
    return end if end.inclusive else Bound(end.at - MICRO)


def range_of(operator: str | None, first: str | None, second: str | None, now: datetime) -> DateRange:
    """``operator`` is one of >= > <= < .. or None for a bare literal; for .. either operand may be missing."""
    if operator in (">", ">="):
        return DateRange(literal_bound(first, now, True, operator == ">="), None)
    if operator in ("<", "<="):
        return DateRange(None, literal_bound(first, now, False, operator == "<="))
    if operator == "..":
        if first is None and second is None:
            raise QueryError("an open range needs at least one end")
        start = None if first is None else literal_bound(first, now, True, True)
        return DateRange(start, None if second is None else literal_bound(second, now, False, True))
    return literal_range(first, now)
