"""Closed intervals on the line and on the circle as Column expressions.

A line interval is a pair (lo, hi), empty if lo > hi. A circle interval runs counterclockwise from lo
to hi in radians within [-pi, pi]; lo > hi means it crosses the far side, (pi, -pi) is empty and
(-pi, pi) is full.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


class Line(NamedTuple):
    lo: Column
    hi: Column

    @classmethod
    def from_pair(cls, a: Column, b: Column) -> Line:
        return cls(F.least(a, b), F.greatest(a, b))

    def is_empty(self) -> Column:
        return self.lo > self.hi

    def center(self) -> Column:
        return 0.5 * (self.lo + self.hi)

    def length(self) -> Column:
        return self.hi - self.lo

    def contains_point(self, p: Column) -> Column:
        return (p >= self.lo) & (p <= self.hi)

    def interior_contains_point(self, p: Column) -> Column:
        return (p > self.lo) & (p < self.hi)

    def contains(self, o: Line) -> Column:
        return o.is_empty() | ((o.lo >= self.lo) & (o.hi <= self.hi))

    def interior_contains(self, o: Line) -> Column:
        return o.is_empty() | ((o.lo > self.lo) & (o.hi < self.hi))

    def intersects(self, o: Line) -> Column:
        return F.when(self.lo <= o.lo, (o.lo <= self.hi) & (o.lo <= o.hi)).otherwise((self.lo <= o.hi) & (self.lo <= self.hi))

    def interior_intersects(self, o: Line) -> Column:
        return (o.lo < self.hi) & (self.lo < o.hi) & (self.lo < self.hi) & (o.lo <= o.hi)

    def directed_hausdorff(self, o: Line) -> Column:
        d = F.greatest(F.lit(0.0), self.hi - o.hi, o.lo - self.lo)
        return F.when(self.is_empty(), 0.0).when(o.is_empty(), float("inf")).otherwise(d)

    def add_point(self, p: Column) -> Line:
        e = self.is_empty()
        return Line(F.when(e, p).otherwise(F.least(self.lo, p)), F.when(e, p).otherwise(F.greatest(self.hi, p)))

    def project(self, p: Column) -> Column:
        return F.greatest(self.lo, F.least(self.hi, p))

    def expanded(self, margin: Column | float) -> Line:
        e = self.is_empty()
        return Line(F.when(e, self.lo).otherwise(self.lo - margin), F.when(e, self.hi).otherwise(self.hi + margin))

    def union(self, o: Line) -> Line:
        a, b = self.is_empty(), o.is_empty()
        return Line(F.when(a, o.lo).when(b, self.lo).otherwise(F.least(self.lo, o.lo)), F.when(a, o.hi).when(b, self.hi).otherwise(F.greatest(self.hi, o.hi)))

    def intersection(self, o: Line) -> Line:
        return Line(F.greatest(self.lo, o.lo), F.least(self.hi, o.hi))


def _turn(x: Column) -> Column:
    """x less whole turns, in [0, 2 pi)."""
    return x - 2 * PI * F.floor(x / (2 * PI))


def _wrapped(x: Column) -> Column:
    """x less whole turns, in (-pi, pi]."""
    return x - 2 * PI * F.ceil((x - PI) / (2 * PI))


class Arc(NamedTuple):
    """All operations go by offsets: how far counterclockwise from lo a point lies, against how far hi lies."""

    lo: Column
    hi: Column

    @classmethod
    def from_point(cls, p: Column) -> Arc:
        return cls(_wrapped(p), _wrapped(p))

    @classmethod
    def from_pair(cls, a: Column, b: Column) -> Arc:
        """The shorter way round."""
        ends = F.struct(_wrapped(a).alias("lo"), _wrapped(b).alias("hi"))
        ends = F.when(_turn(b - a) <= PI, ends).otherwise(F.struct(ends["hi"].alias("lo"), ends["lo"].alias("hi")))
        return cls(ends["lo"], ends["hi"])

    @classmethod
    def empty(cls) -> Arc:
        return cls(F.lit(PI), F.lit(-PI))

    @classmethod
    def full(cls) -> Arc:
        return cls(F.lit(-PI), F.lit(PI))

    @classmethod
    def first_of(cls, *cases: tuple[Column, Arc], otherwise: Arc) -> Arc:
        """The arc of the first condition that holds."""
        lo = hi = None
        for condition, arc in cases:
            lo = F.when(condition, arc.lo) if lo is None else lo.when(condition, arc.lo)
            hi = F.when(condition, arc.hi) if hi is None else hi.when(condition, arc.hi)
        return cls(lo.otherwise(otherwise.lo), hi.otherwise(otherwise.hi))

    def is_full(self) -> Column:
        return self.hi - self.lo >= 2 * PI

    def is_empty(self) -> Column:
        return self.lo - self.hi >= 2 * PI

    def is_inverted(self) -> Column:
        return self.lo > self.hi

    def length(self) -> Column:
        """-1 if empty."""
        return F.when(self.is_empty(), -1.0).when(self.is_full(), 2 * PI).otherwise(_turn(self.hi - self.lo))

    def center(self) -> Column:
        """Half way from lo to hi."""
        return _wrapped(self.lo + 0.5 * self.length())

    def complement(self) -> Arc:
        return Arc.first_of((self.lo == self.hi, Arc.full()), otherwise=Arc(self.hi, self.lo))

    def _offset(self, p: Column) -> Column:
        return _turn(p - self.lo)

    def contains_point(self, p: Column) -> Column:
        return self._offset(p) <= self.length()

    def interior_contains_point(self, p: Column) -> Column:
        return self.is_full() | ((self._offset(p) > 0) & (self._offset(p) < self.length()))

    def contains(self, o: Arc) -> Column:
        """o's ends come one after the other from lo on, before hi."""
        inside = (self._offset(o.lo) <= self._offset(o.hi)) & (self._offset(o.hi) <= self.length()) & ~o.is_full()
        return o.is_empty() | self.is_full() | inside

    def interior_contains(self, o: Arc) -> Column:
        inside = (self._offset(o.lo) > 0) & (self._offset(o.lo) <= self._offset(o.hi)) & (self._offset(o.hi) < self.length()) & ~o.is_full()
        return o.is_empty() | self.is_full() | inside

    def intersects(self, o: Arc) -> Column:
        return ~self.is_empty() & ~o.is_empty() & (self.contains_point(o.lo) | o.contains_point(self.lo))

    def interior_intersects(self, o: Arc) -> Column:
        """Whether this one's interior meets o."""
        point = self.lo == self.hi
        return ~self.is_empty() & ~o.is_empty() & ~point & (self.interior_contains_point(o.lo) | self.interior_contains_point(o.hi) | o.contains(self) | (o.contains_point(self.lo) & o.contains_point(self.hi) & (o.length() > 0)))

    def _outside(self, p: Column) -> Column:
        """How far a point is from the interval, 0 inside."""
        return F.when(self.contains_point(p), 0.0).otherwise(F.least(_turn(p - self.hi), _turn(self.lo - p)))

    def add_point(self, p: Column) -> Arc:
        p = _wrapped(p)
        after = _turn(p - self.hi) <= _turn(self.lo - p)
        return Arc.first_of((self.is_empty(), Arc(p, p)), (self.contains_point(p), self), (after, Arc(self.lo, p)), otherwise=Arc(p, self.hi))

    def project(self, p: Column) -> Column:
        """The nearest point; the interval must not be empty."""
        return F.when(self.contains_point(p), _wrapped(p)).when(_turn(p - self.hi) <= _turn(self.lo - p), self.hi).otherwise(self.lo)

    def expanded(self, margin: Column | float) -> Arc:
        """Each end moved outwards (a negative margin: inwards, until nothing is left)."""
        size = self.length() + 2 * margin
        return Arc.first_of(
            (self.is_empty() | (self.is_full() & (F.lit(0.0) + margin < 0)), self),
            (size >= 2 * PI - 1e-15, Arc.full()),
            (size < 1e-15 * F.when(F.lit(0.0) + margin < 0, 1.0).otherwise(-1.0), Arc.empty()),
            otherwise=Arc(_wrapped(self.lo - margin), _wrapped(self.hi + margin)),
        )

    def union(self, o: Arc) -> Arc:
        """The shortest interval that contains both."""
        lo_in, hi_in = self.contains_point(o.lo), self.contains_point(o.hi)
        gap_after, gap_before = _turn(o.lo - self.hi), _turn(self.lo - o.hi)
        return Arc.first_of(
            (self.contains(o), self), (o.contains(self), o), (lo_in & hi_in, Arc.full()), (lo_in, Arc(self.lo, o.hi)), (hi_in, Arc(o.lo, self.hi)), (gap_before < gap_after, Arc(o.lo, self.hi)), otherwise=Arc(self.lo, o.hi)
        )

    def intersection(self, o: Arc) -> Arc:
        """The shortest interval that contains what they share; of two that meet at both ends, the shorter one."""
        lo_in, hi_in = self.contains_point(o.lo), self.contains_point(o.hi)
        return Arc.first_of(
            (self.is_empty() | o.is_empty(), Arc.empty()),
            (self.contains(o) | (lo_in & hi_in & ~o.contains(self) & (o.length() < self.length())), o),
            (o.contains(self) | (lo_in & hi_in), self),
            (lo_in, Arc(o.lo, self.hi)),
            (hi_in, Arc(self.lo, o.hi)),
            otherwise=Arc.empty(),
        )

    def directed_hausdorff(self, o: Arc) -> Column:
        """How far a point of this one can be from o: at the middle of what o leaves out, or at an end."""
        middle = _wrapped(o.hi + 0.5 * (2 * PI - o.length()))
        far = F.when(self.contains_point(middle), o._outside(middle)).otherwise(F.greatest(o._outside(self.lo), o._outside(self.hi)))
        return F.when(o.contains(self), 0.0).when(o.is_empty(), PI).otherwise(far)

    def approx_equals(self, o: Arc, error: float = 1e-15) -> Column:
        """Ends within the error; short intervals count as empty, long ones as full."""
        gap = lambda a, b: F.abs(_wrapped(a - b))
        near = (gap(self.lo, o.lo) <= error) & (gap(self.hi, o.hi) <= error) & (F.abs(self.length() - o.length()) <= 2 * error)
        return F.when(self.is_empty(), o.length() <= 2 * error).when(o.is_empty(), self.length() <= 2 * error).when(self.is_full(), o.length() >= 2 * PI - 2 * error).when(o.is_full(), self.length() >= 2 * PI - 2 * error).otherwise(near)
