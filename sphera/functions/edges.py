"""Edges and triangles on the sphere as Column expressions (doubles; `operators.exact` decides doubtful signs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sphera.functions.points import Vec, angle, chord2


def side(a: Vec, b: Vec, p: Vec) -> Column:
    """Positive if p is left of the edge from a to b: the determinant of the three."""
    return a.cross(b).dot(p)


def sign(a: Vec, b: Vec, c: Vec) -> Column:
    return F.signum(side(a, b, c))


def ordered_ccw(a: Vec, b: Vec, c: Vec, o: Vec) -> Column:
    """Whether a, b, c are met in this order going counterclockwise about o."""
    total = F.when(side(b, o, a) >= 0, 1).otherwise(0) + F.when(side(c, o, b) >= 0, 1).otherwise(0) + F.when(side(a, o, c) > 0, 1).otherwise(0)
    return total >= 2


def crosses(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Whether edges ab and cd cross at a point inside both."""
    one, two = side(a, b, c), side(a, b, d)
    three, four = side(c, d, a), side(c, d, b)
    return (F.signum(one) * F.signum(two) < 0) & (F.signum(three) * F.signum(four) < 0) & (F.signum(one) == F.signum(four))


def intersection(a: Vec, b: Vec, c: Vec, d: Vec) -> Vec:
    """Where two crossing edges meet, on the side of the edges."""
    p = a.cross(b).cross(c.cross(d)).normalized()
    back = p.dot(a.plus(b).plus(c.plus(d))) < 0
    return p.times(F.when(back, -1.0).otherwise(1.0))


def _above_inside(p: Vec, a: Vec, b: Vec) -> tuple[Vec, Column]:
    n = a.cross(b)
    return n, (n.cross(a).dot(p) > 0) & (n.cross(b).dot(p) < 0)


def distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Angle from p to the edge ab."""
    n, inside = _above_inside(p, a, b)
    ends = 2 * F.asin(0.5 * F.sqrt(F.least(chord2(p, a), chord2(p, b))))
    return F.when(inside, F.asin(F.least(F.lit(1.0), F.abs(n.dot(p)) / n.norm()))).otherwise(ends)


def max_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Angle from p to the furthest point of the edge."""
    far = F.greatest(chord2(p, a), chord2(p, b))
    anti = distance(p.times(-1.0), a, b)
    return F.when(far <= 2, 2 * F.asin(0.5 * F.sqrt(far))).otherwise(3.141592653589793 - anti)


def project(p: Vec, a: Vec, b: Vec) -> Vec:
    """The point of the edge nearest p."""
    n, inside = _above_inside(p, a, b)
    unit = n.normalized()
    foot = p.minus(unit.times(unit.dot(p))).normalized()
    first = chord2(p, a) <= chord2(p, b)
    return Vec(*[F.when(inside, f).when(first, x).otherwise(y) for f, x, y in zip(foot, a, b, strict=True)])


def distance_fraction(p: Vec, a: Vec, b: Vec) -> Column:
    """How far along the edge a point of it is, 0 to 1."""
    d0, d1 = angle(p, a), angle(p, b)
    return d0 / (d0 + d1)


def pair_distance(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Angle between two edges; 0 if they cross."""
    ends = F.least(distance(a, c, d), distance(b, c, d), distance(c, a, b), distance(d, a, b))
    return F.when(crosses(a, b, c, d), 0.0).otherwise(ends)


def signed_area(a: Vec, b: Vec, c: Vec) -> Column:
    """Solid angle of a triangle, positive if counterclockwise."""
    return 2 * F.atan2(side(a, b, c), 1 + a.dot(b) + b.dot(c) + a.dot(c))


def area(a: Vec, b: Vec, c: Vec) -> Column:
    return F.abs(signed_area(a, b, c))


def vertex_angle(a: Vec, b: Vec, c: Vec) -> Column:
    return angle(a.cross(b), c.cross(b))


def turn_angle(a: Vec, b: Vec, c: Vec) -> Column:
    """Turn at b going from a to c, left positive."""
    t = angle(a.cross(b), b.cross(c))
    return F.when(side(a, b, c) > 0, t).otherwise(-t)


def true_centroid(a: Vec, b: Vec) -> Vec:
    """The edge's centroid times its length."""
    diff, total = a.minus(b).norm2(), a.plus(b)
    return total.times(F.sqrt(diff / total.norm2()))


def planar_centroid(a: Vec, b: Vec, c: Vec) -> Vec:
    return a.plus(b).plus(c).times(1.0 / 3)
