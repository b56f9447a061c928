from __future__ import annotations

import pytest

from tessella.plans.intervals import Interval, IntervalSet, prefix_successor
from tessella.plans.predicate import parse, row_predicate

ROUND_TRIPS = [
    ("", ""),
    ("   ", ""),
    ("  row < 'foo'  ", 'row < "foo"'),
    ("row ~= 'foo'", 'row ~= "foo"'),
    ("row ~= 'foo\\xff'", 'row ~= "foo\\xff"'),
    ("row ~= ''", 'row >= ""'),
    ("row = 'com.foo.www/index.html' and history = 1", 'row = "com.foo.www/index.html" and history = 1'),
    ("row ~= 'com.foo' and time >= 1999-01-02T03:04:05.678901Z", 'row ~= "com.foo" and time >= 1999-01-02T03:04:05.678901Z'),
    ('"word:cat" < column <= "word:dog" or column >= "word:fish"', '"word:cat" < column <= "word:dog" or column >= "word:fish"'),
    ("time = @0", "time = @0"),
    ("row = 'foo\\\\'", 'row = "foo\\\\"'),
    ("row ~= '\\x00'", 'row ~= "\\x00"'),
    ("'com.v\\xe0' <= row < 'com.xp'", '"com.v\\xe0" <= row < "com.xp"'),
]


@pytest.mark.parametrize(("given", "shown"), ROUND_TRIPS)
def test_round_trip(given: str, shown: str) -> None:
    p = parse(given)
    assert str(p) == shown
    assert parse(str(p)) == p


@pytest.mark.parametrize("bad", ["row = 'foo\\'", "'a' < row", "row='a' or column='b'", "row='a' and row='b'", "history=0", "history=1 and history=2", "time ~= 'a'", "row = 'a' x", "row = @1", "time = 'a'", "'a' < row > 'b'", "value = 'a'", "row ="])
def test_errors(bad: str) -> None:
    with pytest.raises(ValueError):
        parse(bad)


CLIPS = [
    ("", "bar", "foo", '"bar" <= row < "foo"'),
    ("row > 'cat'", "bar", "foo", '"cat" < row < "foo"'),
    ("row < 'cat' and history = 3", "bar", "foo", '"bar" <= row < "cat" and history = 3'),
    ("row < 'cat'", None, None, 'row < "cat"'),
    ("row > 'cat'", None, None, 'row > "cat"'),
    ("row > 'cat'", None, "dog", '"cat" < row < "dog"'),
    ("row < 'rat'", "dog", None, '"dog" <= row < "rat"'),
    ("row < 'cat'", "dog", None, '"" < row < ""'),
]


@pytest.mark.parametrize(("given", "low", "high", "shown"), CLIPS)
def test_clip(given: str, low: str | None, high: str | None, shown: str) -> None:
    assert str(parse(given).clip_rows(Interval.of(low, high))) == shown


FAMILIES = [
    ("", None), ("'b' < column < 'a'", 0), ("column = 'source:whitelist'", 1),
    ("column = 'source:whitelist' or column = 'source:deepcrawl'", 1), ("column = 'source:whitelist' or column = 'depth:1'", 2),
    ("column ~= 'source:deepcrawl'", 1), ("column ~= 'source:'", 1), ("column ~= 'source'", None), ("column < 'source;'", None),
    ("'source:' < column < 'source;'", 1), ("'source:a' < column < 'source:d'", 1), ("'source:a' <= column < 'source:d'", 1),
    ("'source:a' < column <= 'source:d'", 1), ("'source:a' <= column <= 'source:d'", 1), ("'source1:a' <= column <= 'source2:d'", None),
    ("column = 'source:whitelist' or column > 'source:whitelist'", None), ("column = 'source:whitelist' or column > 'zeta'", None),
]


@pytest.mark.parametrize(("given", "n"), FAMILIES)
def test_families(given: str, n: int | None) -> None:
    got = parse(given).families()
    assert got is None if n is None else len(got) == n


def test_interval_sets() -> None:
    a = IntervalSet([Interval.of(1, 3), Interval.of(3, 5), Interval.point(7)])
    assert len(a) == 2
    assert len(IntervalSet([Interval.of(1, 3), Interval.of(3, 5, low_closed=False)])) == 2  # 3 is in neither
    assert len(IntervalSet([Interval.of(1, 3, high_closed=True), Interval.of(3, 5, low_closed=False)])) == 1
    assert IntervalSet([Interval.of(3, 3)]).empty
    assert a.contains(7)
    assert not a.contains(5)
    assert a.contains(Interval.of(2, 5))
    assert not a.overlaps(Interval.of(5, 7))
    assert a.hull == Interval.of(1, 7, high_closed=True)
    low, high = Interval.of(1, 3).complements()
    assert low.contains(0)
    assert not low.contains(1)
    assert high.contains(3)
    assert IntervalSet([Interval()]).infinite
    got = a.intersect(IntervalSet([Interval.of(2, 4), Interval.of(4, None)]))
    assert got == IntervalSet([Interval.of(2, 5), Interval.point(7)])


def test_against_points() -> None:
    """Sets behave as sets of points do, half-integers included."""
    import random

    r = random.Random(1)
    points = [x / 2 for x in range(-2, 24)]
    draw = lambda: Interval.of(r.choice([None, *range(10)]), r.choice([None, *range(10)]), r.random() < 0.5, r.random() < 0.5)
    for _ in range(300):
        xs, ys, span = [draw() for _ in range(3)], [draw() for _ in range(3)], draw()
        a, b = IntervalSet(xs), IntervalSet(ys)
        for p in points:
            in_a, in_b = any(x.contains(p) for x in xs), any(y.contains(p) for y in ys)
            assert a.contains(p) == in_a
            assert a.union(b).contains(p) == (in_a or in_b)
            assert a.intersect(b).contains(p) == (in_a and in_b)
            assert a.clip(span).contains(p) == (in_a and span.contains(p))


def test_prefixes() -> None:
    assert prefix_successor(b"a\xff\xff") == b"b"
    assert prefix_successor(b"\xff") is None
    assert prefix_successor("ab") == "ac"
    assert prefix_successor("") is None
    assert row_predicate(Interval()) == 'row >= ""'
    assert row_predicate(Interval.of("a", "b", high_closed=True)) == '"a" <= row <= "b"'
