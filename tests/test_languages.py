from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from noteql.functions.dates import Bound, DateRange, QueryError, literal_range, to_micros
from noteql.plans import metrics_query
from noteql.plans.query import And, Not, Or, Term, parse

NOW = datetime(2024, 5, 10, 12, tzinfo=UTC)


def micros(text):
    return parse(text, NOW).filters["modified"].micros()


def at(*a):
    return to_micros(datetime(*a, tzinfo=UTC))


def test_precedence_and_adjacency():
    assert parse("a b OR c", NOW).expr == Or((And((Term("a"), Term("b"))), Term("c")))
    assert parse("a (b OR c)", NOW).expr == And((Term("a"), Or((Term("b"), Term("c")))))
    assert parse("a and b", NOW).expr == And((Term("a"), Term("b")))


def test_not_becomes_an_exclusion():
    q = parse("a NOT b NOT c", NOW)
    assert q.expr == Term("a") and q.excludes == [Term("b"), Term("c")]
    q = parse("NOT x", NOW)
    assert q.expr is None and q.excludes == [Term("x")]


@pytest.mark.parametrize("text", ["a OR NOT b", "NOT NOT a", "modified:today OR x", "NOT modified:today", "(a", "a)", "", '"a', "modified:past0d", "modified:pastxd", "modified:", "modified:2024-13"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text, NOW)


def test_fields():
    assert parse('content:"a b"', NOW).expr == Term("a b", "content")
    assert parse("status:in", NOW).expr == Term("status:in", "metadata")
    assert parse("rating:>4", NOW).expr == Term("rating:>4", "metadata")
    assert parse("due:next2w", NOW).expr == Term("due:next2w", "metadata")
    assert parse(r'"say \"hi\""', NOW).expr == Term('say "hi"')


def test_a_range_ends_at_midnight_and_a_day_is_whole():
    assert micros("modified:2024-05-01..2024-05-31") == (at(2024, 5, 1), at(2024, 5, 31))
    assert micros("modified:2024-05-31") == (at(2024, 5, 31), at(2024, 6, 1) - 1)
    assert micros("modified:>2024-05-31") == (at(2024, 5, 31) + 1, None)
    assert micros("m:2024-02") == (at(2024, 2, 1), at(2024, 3, 1) - 1)
    assert micros("modified:2024-03-01..") == (at(2024, 3, 1), None)
    assert micros("modified:..2024-03-01") == (None, at(2024, 3, 1))


def test_relative_and_named_dates():
    assert micros("modified:past7d") == (at(2024, 5, 3, 12), at(2024, 5, 10, 12))
    assert micros("modified:thisweek") == (at(2024, 5, 6), at(2024, 5, 13) - 1)
    assert micros("modified:lastmonth") == (at(2024, 4, 1), at(2024, 5, 1) - 1)
    assert literal_range("past3m", datetime(2024, 5, 31, tzinfo=UTC)).start.at == datetime(2024, 2, 29, tzinfo=UTC)


def test_ranges_of_one_field_intersect():
    assert micros("modified:>=2024-01-01 modified:<2024-02-01") == (at(2024, 1, 1), at(2024, 2, 1) - 1)
    with pytest.raises(QueryError):
        parse("modified:>2024-02-01 modified:<2024-01-01", NOW)


@given(*[st.tuples(st.integers(0, 50), st.integers(0, 50), st.booleans(), st.booleans())] * 2)
def test_intersection_holds_what_both_hold(a, b):
    t = lambda n: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(microseconds=n)
    made = [DateRange(Bound(t(x[0]), x[2]), Bound(t(x[1]), x[3])) for x in (a, b)]
    holds = lambda r, n: r is not None and r.micros()[0] <= to_micros(t(n)) <= r.micros()[1]
    both = made[0].intersect(made[1])
    assert all(holds(both, n) == (holds(made[0], n) and holds(made[1], n)) for n in range(52))


def test_metrics_language():
    q = metrics_query.parse("key:body.weight source:'my scale' \"two words\" foo:bar", NOW)
    assert (q.keys, q.sources, q.terms) == (["body.weight"], ["my scale"], ["two words", "foo:bar"])
    assert metrics_query.parse("date:2024-04", NOW).dates.micros() == (at(2024, 4, 1), at(2024, 5, 1) - 1)
    with pytest.raises(QueryError):
        metrics_query.parse("'open", NOW)


def test_not_node_is_not_left_in_positive_part():
    assert not isinstance(parse("a NOT b", NOW).expr, Not)
