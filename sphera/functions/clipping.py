"""Edges in a face's plane: cutting to the face, to rectangles, and the segments of an edge on all faces.

A point of an edge is a mix (1 - t) a + t b. In the face's axes each border is a linear bound on it, so what is left of the edge is an
interval of t: from the largest bound that it rises through to the least that it falls through.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphera.functions import cells
from sphera.functions.cellshape import xyz_to_uvw
from sphera.functions.intervals import Line
from sphera.functions.points import Vec, angle, let
from sphera.functions.regions import PlaneRect


class Clipped(NamedTuple):
    """The part of an edge: from t0 to t1 of its chord; nothing is left if t0 > t1."""

    t0: Column
    t1: Column

    def exists(self) -> Column:
        return self.t0 <= self.t1


def _interval(bounds: list[tuple[Column, Column]]) -> Clipped:
    """Where all of the linear functions given by their values at t = 0 and 1 are at least 0."""
    lows, highs = [F.lit(0.0)], [F.lit(1.0)]
    for f, g in bounds:
        lows.append(F.when(f < 0, F.when(g < 0, 2.0).otherwise(f / (f - g))))
        highs.append(F.when((g < 0) & (f >= 0), f / (f - g)))
    return Clipped(F.greatest(*lows), F.least(*highs))


def mixed(a: Column, b: Column, t: Column) -> Column:
    """(1 - t) a + t b, exactly a or b at the ends."""
    return F.when(t == 1, b).otherwise(a + t * (b - a))


def interpolate_double(x: Column, a: Column, b: Column, a1: Column, b1: Column) -> Column:
    """The value at x of the line through (a, a1) and (b, b1), from the nearer end; a and b must differ."""
    near = F.abs(a - x) <= F.abs(b - x)
    return F.when(a == b, a1).when(near, a1 + (b1 - a1) * ((x - a) / (b - a))).otherwise(b1 + (a1 - b1) * ((x - b) / (a - b)))


def _in_face(face: Column | int, a: Vec, b: Vec) -> Column:
    """Struct p, q: the ends in the face's axes."""
    return F.struct(xyz_to_uvw(face, a).struct().alias("p"), xyz_to_uvw(face, b).struct().alias("q"))


def clip_to_face(face: Column | int, a: Vec, b: Vec, padding: float = 0.0) -> Clipped:
    """The part of the great-circle edge in a face, whose borders are moved out by the padding."""
    edge = 1 + padding
    sides = [lambda v: edge * v["z"] - v["x"], lambda v: edge * v["z"] + v["x"], lambda v: edge * v["z"] - v["y"], lambda v: edge * v["z"] + v["y"]]

    def part(e: Column) -> Column:
        # the values at both ends once, then the interval
        values = F.struct(*[f(e[end]).alias(f"{end}{k}") for k, f in enumerate(sides) for end in "pq"])
        return let(values, lambda v: F.struct(*[t.alias(n) for t, n in zip(_interval([(v[f"p{k}"], v[f"q{k}"]) for k in range(4)]), ("t0", "t1"), strict=True)]))

    found = let(_in_face(face, a, b), part)
    return Clipped(found["t0"], found["t1"])


def clipped_ends(face: Column | int, a: Vec, b: Vec, part: Clipped) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """(u, v) of the two ends of a clipped edge."""
    out = []
    for t in part:
        at = let(F.struct(_in_face(face, a, b).alias("e"), t.alias("t")), lambda s: F.struct(*[mixed(s["e"]["p"][x], s["e"]["q"][x], s["t"]).alias(x) for x in "xyz"]))
        uv = let(at, lambda v: F.struct((v["x"] / v["z"]).alias("u"), (v["y"] / v["z"]).alias("v")))
        out.append((uv["u"], uv["v"]))
    return out[0], out[1]


def face_segments(df: DataFrame, a: Vec, b: Vec, out: str = "segment") -> DataFrame:
    """A row for each face that the edge runs through, in order: the struct of number, face, and the ends' u0, v0, u1, v1."""
    rows = []
    for f in range(6):
        part = clip_to_face(f, a, b)
        (u0, v0), (u1, v1) = clipped_ends(f, a, b, part)
        rows.append(F.when(part.t0 < part.t1, F.struct(part.t0.alias("t"), F.lit(f).alias("face"), u0.alias("u0"), v0.alias("v0"), u1.alias("u1"), v1.alias("v1"))))
    found = F.array_sort(F.filter(F.array(*rows), lambda r: r.isNotNull()))
    df = df.withColumn("__found", found).select("*", F.posexplode("__found").alias("__n", "__s")).drop("__found")
    s = F.col("__s")
    return df.withColumn(out, F.struct(F.col("__n").alias("number"), *[s[c].alias(c) for c in ("face", "u0", "v0", "u1", "v1")])).drop("__n", "__s")


def clip_edge(x0: Column, y0: Column, x1: Column, y1: Column, rect: PlaneRect) -> Clipped:
    """The part of a plane segment in a rectangle."""
    return _interval([(x0 - rect.x.lo, x1 - rect.x.lo), (rect.x.hi - x0, rect.x.hi - x1), (y0 - rect.y.lo, y1 - rect.y.lo), (rect.y.hi - y0, rect.y.hi - y1)])


def intersects_rect(x0: Column, y0: Column, x1: Column, y1: Column, rect: PlaneRect) -> Column:
    return ~rect.is_empty() & clip_edge(x0, y0, x1, y1, rect).exists()


def clipped_edge_bound(x0: Column, y0: Column, x1: Column, y1: Column, rect: PlaneRect) -> PlaneRect:
    """Bounds of the part of a segment in a rectangle; empty if there is none."""
    part = clip_edge(x0, y0, x1, y1, rect)
    ends = [(mixed(x0, x1, t), mixed(y0, y1, t)) for t in part]
    clip = lambda lo, hi, line: Line(F.when(part.exists(), F.greatest(line.lo, F.least(lo, hi))).otherwise(1.0), F.when(part.exists(), F.least(line.hi, F.greatest(lo, hi))).otherwise(0.0))
    return PlaneRect(clip(ends[0][0], ends[1][0], rect.x), clip(ends[0][1], ends[1][1], rect.y))


# --- wedges ---------------------------------------------------------------------------------------


def turn_from(v: Vec, first: Vec, x: Vec) -> Column:
    """Angle about v counterclockwise from the direction of `first` to that of x, in [0, 2 pi); exactly 0 if they are equal."""
    two_pi = 6.283185307179586
    p, q = v.cross(first), v.cross(x)
    same = (first.x == x.x) & (first.y == x.y) & (first.z == x.z)
    return F.when(same, 0.0).otherwise(F.pmod(F.atan2(v.dot(p.cross(q)), p.dot(q)), F.lit(two_pi)))


def wedge_relation(a0: Vec, v: Vec, a2: Vec, b0: Vec, b2: Vec) -> Column:
    """How the wedges left of a0-v-a2 and b0-v-b2 lie: each is an arc about v, from its last ray counterclockwise to its first.

    EQUALS, PROPERLY_CONTAINS, IS_PROPERLY_CONTAINED, PROPERLY_OVERLAPS or IS_DISJOINT. Angles count from a2.
    """
    end, lo, hi = turn_from(v, a2, a0), turn_from(v, a2, b2), turn_from(v, a2, b0)
    same = (lo == 0) & (_equal(b0, a0))
    end_b = F.when(_equal(b0, a0), end).otherwise(hi)
    whole = F.when(_equal(b0, a2) & ~_equal(b2, a2), 6.283185307179586).otherwise(end_b)  # b ends where a begins
    in_order = lo < whole
    holds = in_order & (whole <= end)
    around = (lo == 0) & (whole >= end) | (~in_order & (lo >= end) & (whole >= end)) | (~in_order & (whole >= end))
    apart = in_order & (lo >= end)
    return (
        F.when(same, "EQUALS").when(holds, "PROPERLY_CONTAINS").when(around & ~apart, "IS_PROPERLY_CONTAINED").when(apart, "IS_DISJOINT").otherwise("PROPERLY_OVERLAPS")
    )


def _equal(a: Vec, b: Vec) -> Column:
    return reduce(lambda x, y: x & y, [p == q for p, q in zip(a, b, strict=True)])


def wedge_contains(a0: Vec, v: Vec, a2: Vec, b0: Vec, b2: Vec) -> Column:
    return wedge_relation(a0, v, a2, b0, b2).isin("EQUALS", "PROPERLY_CONTAINS")


def wedge_intersects(a0: Vec, v: Vec, a2: Vec, b0: Vec, b2: Vec) -> Column:
    return wedge_relation(a0, v, a2, b0, b2) != "IS_DISJOINT"


# --- limits on distances --------------------------------------------------------------------------


def is_distance_less(p: Vec, a: Vec, b: Vec, limit: Column | float, or_equal: bool = False) -> Column:
    """Whether a point is nearer to an edge than an angle."""
    from sphera.functions.edges import distance

    d = distance(p, a, b)
    return (d <= limit) if or_equal else (d < limit)


def interior_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Angle to the edge where the nearest point is inside it, else null."""
    n = a.cross(b)
    inside = (n.cross(a).dot(p) > 0) & (n.cross(b).dot(p) < 0)
    return F.when(inside, F.asin(F.least(F.lit(1.0), F.abs(n.dot(p)) / n.norm())))


def is_interior_distance_less(p: Vec, a: Vec, b: Vec, limit: Column | float) -> Column:
    return F.coalesce(interior_distance(p, a, b) < limit, F.lit(False))


def min_distance_update(p: Vec, a: Vec, b: Vec, least: Column) -> Column:
    """The lesser of a distance so far and that of the edge."""
    from sphera.functions.edges import distance

    return F.least(least, distance(p, a, b))


def min_interior_distance_update(p: Vec, a: Vec, b: Vec, least: Column) -> Column:
    return F.least(least, interior_distance(p, a, b))


def min_distance_max_error(length2: Column) -> Column:
    """What a squared chord from a point to an edge can be off: of a distance to the edge's circle, or to an end, whichever is more."""
    eps = 2.220446049250313e-16
    x = length2
    ends = 4.5 * eps * x + 16 * eps * eps
    b = F.least(F.lit(1.0), 0.5 * x)
    inside = F.when(x > 2, 0.0).otherwise((2.5 + 2 * (3.0**0.5) + 8.5 * F.sqrt(b * (2 - b))) * F.sqrt(b * (2 - b)) * eps + (2 + 2 * (3.0**0.5) / 3 + 6.5 * (1 - b)) * b * eps + (23 + 16 / (3.0**0.5)) * eps * eps)
    return F.greatest(ends, inside)


def face_of_segment(df: DataFrame, a: Vec) -> DataFrame:
    return df.withColumn("face", cells.face_of(a))


def edge_length(a: Vec, b: Vec) -> Column:
    return angle(a, b)
