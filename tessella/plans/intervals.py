"""Intervals over any ordered values, sets of them, and their translation into Spark conditions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cut stands just below (side 0) or just above (side 1) its value; None is the infinite end on its side.
Cut = tuple[Any, int] | None


def _low_key(cut: Cut) -> tuple:
    return (0,) if cut is None else (1, *cut)


def _high_key(cut: Cut) -> tuple:
    return (2,) if cut is None else (1, *cut)


@dataclass(frozen=True)
class Interval:
    """The values between two cuts: below a value for a closed start or an open end, above it otherwise."""

    low: Cut = None
    high: Cut = None

    @staticmethod
    def of(low: Any = None, high: Any = None, low_closed: bool = True, high_closed: bool = False) -> Interval:
        """From `low` to `high`, None for no bound; closed at the start and open at the end by default."""
        return Interval(None if low is None else (low, int(not low_closed)), None if high is None else (high, int(high_closed)))

    @staticmethod
    def point(value: Any) -> Interval:
        return Interval((value, 0), (value, 1))

    @staticmethod
    def prefix(prefix: str | bytes) -> Interval:
        end = prefix_successor(prefix)
        return Interval((prefix, 0), None if end is None else (end, 0))

    @property
    def empty(self) -> bool:
        return self.low is not None and self.high is not None and self.low >= self.high

    @property
    def infinite(self) -> bool:
        return self.low is None and self.high is None

    @property
    def is_point(self) -> bool:
        return self.low is not None and self.high is not None and self.low[0] == self.high[0] and self.low[1] < self.high[1]

    def contains(self, x: Any) -> bool:
        """A value, or an interval; any interval that isn't empty contains the empty ones."""
        if isinstance(x, Interval):
            if self.empty:
                return False
            return x.empty or (_low_key(self.low) <= _low_key(x.low) and _high_key(x.high) <= _high_key(self.high))
        return (self.low is None or (x, 1) > self.low) and (self.high is None or (x, 0) < self.high)

    def clip(self, other: Interval) -> Interval:
        return Interval(max(self.low, other.low, key=_low_key), min(self.high, other.high, key=_high_key))

    def overlaps(self, other: Interval) -> bool:
        return not self.empty and not other.empty and not self.clip(other).empty

    def complements(self) -> tuple[Interval | None, Interval | None]:
        """What lies below and above, adjacent to it; None past an infinite end."""
        return (None if self.low is None else Interval(None, self.low), None if self.high is None else Interval(self.high, None))

    def to_column(self, c: Column, lit=F.lit) -> Column:  # noqa: ANN001
        """The condition that c lies within; comparisons that Parquet scans take."""
        if self.empty:
            return F.lit(False)
        if self.is_point:
            return c == lit(self.low[0])
        parts = []
        if self.low is not None:
            parts.append(c > lit(self.low[0]) if self.low[1] else c >= lit(self.low[0]))
        if self.high is not None:
            parts.append(c <= lit(self.high[0]) if self.high[1] else c < lit(self.high[0]))
        return reduce(lambda a, b: a & b, parts) if parts else c.isNotNull()


def prefix_successor(prefix: str | bytes) -> str | bytes | None:
    """The least string above all that start with the prefix, in byte order; None if there is none."""
    if isinstance(prefix, bytes):
        p = prefix.rstrip(b"\xff")
        return p[:-1] + bytes([p[-1] + 1]) if p else None
    p = prefix.rstrip(chr(0x10FFFF))
    if not p:
        return None
    n = ord(p[-1]) + 1
    return p[:-1] + chr(0xE000 if n == 0xD800 else n)


class IntervalSet:
    """Disjoint intervals in order; what touches is one interval."""

    def __init__(self, items: Iterable[Interval] = ()) -> None:
        out: list[Interval] = []
        for x in sorted((x for x in items if not x.empty), key=lambda x: _low_key(x.low)):
            if out and (out[-1].high is None or x.low is None or out[-1].high >= x.low):
                out[-1] = Interval(out[-1].low, max(out[-1].high, x.high, key=_high_key))
            else:
                out.append(x)
        self.items = tuple(out)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, IntervalSet) and self.items == other.items

    def __hash__(self) -> int:
        return hash(self.items)

    def __iter__(self):  # noqa: ANN204
        return iter(self.items)

    def __len__(self) -> int:
        return len(self.items)

    def __repr__(self) -> str:
        return f"IntervalSet({list(self.items)})"

    @property
    def empty(self) -> bool:
        return not self.items

    @property
    def infinite(self) -> bool:
        return len(self.items) == 1 and self.items[0].infinite

    def add(self, x: Interval) -> IntervalSet:
        return IntervalSet([*self.items, x])

    def union(self, other: IntervalSet) -> IntervalSet:
        return IntervalSet([*self.items, *other.items])

    def clip(self, span: Interval) -> IntervalSet:
        return IntervalSet(x.clip(span) for x in self.items)

    def intersect(self, other: IntervalSet) -> IntervalSet:
        """By one sweep over both: whichever interval ends first moves on."""
        out, i, j = [], 0, 0
        while i < len(self.items) and j < len(other.items):
            a, b = self.items[i], other.items[j]
            out.append(a.clip(b))
            if _high_key(a.high) <= _high_key(b.high):
                i += 1
            else:
                j += 1
        return IntervalSet(out)

    def contains(self, x: Any) -> bool:
        return any(s.contains(x) for s in self.items)

    def overlaps(self, x: Interval) -> bool:
        return any(s.overlaps(x) for s in self.items)

    @property
    def hull(self) -> Interval:
        if self.empty:
            raise ValueError("an empty set has no hull")
        return Interval(self.items[0].low, self.items[-1].high)

    def to_column(self, c: Column, lit=F.lit) -> Column:  # noqa: ANN001
        """Points together as IN, ranges as comparisons; an empty set selects nothing."""
        points = [x.low[0] for x in self.items if x.is_point]
        parts = [x.to_column(c, lit) for x in self.items if not x.is_point]
        if len(points) > 1:
            parts.append(c.isin([lit(p) for p in points]))
        elif points:
            parts.append(c == lit(points[0]))
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
