"""Decisions on points and edges that are always right, for columns of points.

Each predicate is a function of arrays (n x 3): doubles decide where the result is beyond its rounding error, exact
fractions decide the rest, row by row. `column` makes a Spark column of one, in Arrow batches. Vectors count by their direction.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sphera.operators import exact

EPS = 2.220446049250313e-16
Array = np.ndarray


def _dot(a: Array, b: Array) -> Array:
    return np.einsum("ij,ij->i", a, b)


def _exact(v) -> tuple[Fraction, Fraction, Fraction]:
    return tuple(Fraction(float(x)) for x in v)


def _xdot(a, b) -> Fraction:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _xcross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _sgn(x) -> int:
    return (x > 0) - (x < 0)


def _before(a: Array, b: Array) -> int:
    """1 if a comes before b by its coordinates, else 0."""
    return int(a.tolist() < b.tolist())


def _signed_square(x: Fraction) -> Fraction:
    return x * abs(x)


def _decide(value: Array, error: Array | float, settle: Callable[[int], int]) -> Array:
    """Signs of values beyond their error; `settle(row)` for the others."""
    out = np.sign(value).astype(np.int32)
    for i in np.flatnonzero(~(np.abs(value) > error)):
        out[i] = settle(int(i))
    return out


def sign(a: Array, b: Array, c: Array) -> Array:
    """Orientation with ties broken as in `exact.sign`: 0 only if two points are equal."""
    return _decide(_dot(np.cross(a, b), c), 3.7 * EPS, lambda i: exact.sign(tuple(a[i]), tuple(b[i]), tuple(c[i])))


def unperturbed_sign(a: Array, b: Array, c: Array) -> Array:
    """Orientation, 0 for points on one great circle."""
    return _decide(_dot(np.cross(a, b), c), 3.7 * EPS, lambda i: _sgn(_xdot(_xcross(_exact(a[i]), _exact(b[i])), _exact(c[i]))))


def robust_cross_prod(a: Array, b: Array) -> Array:
    """Unit vectors at right angles to a and b, with a relative error of a few roundings; never 0: for equal or opposite points the
    one that moving b a little in the first coordinate that shows gives."""
    n = np.cross(a, b)
    size = np.linalg.norm(n, axis=1)
    for i in np.flatnonzero(size < 1e-8):
        x = _xcross(_exact(a[i]), _exact(b[i]))
        if any(x):
            scale = max(abs(c) for c in x)
            n[i] = [float(c / scale) for c in x]
            continue
        for axis in (0, 1, 2):
            moved = np.cross(a[i], np.eye(3)[axis])
            if moved.any():
                # which of the two comes first must not matter but for the sign
                n[i] = moved if tuple(a[i]) <= tuple(b[i]) else -moved
                break
    return n / np.linalg.norm(n, axis=1)[:, None]


def sign_dot_prod(a: Array, b: Array) -> Array:
    return _decide(_dot(a, b), 3.2 * EPS, lambda i: _sgn(_xdot(_exact(a[i]), _exact(b[i]))))


def compare_distances(x: Array, a: Array, b: Array) -> Array:
    """-1 if a is nearer to x, 1 if b is; ties go to the lexicographically greater point, 0 if they are equal."""

    def settle(i: int) -> int:
        p, q, r = _exact(x[i]), _exact(a[i]), _exact(b[i])
        s = _sgn(_signed_square(_xdot(p, r)) * _xdot(q, q) - _signed_square(_xdot(p, q)) * _xdot(r, r))
        return s or _sgn(_before(a[i], b[i]) - _before(b[i], a[i]))

    return _decide(_dot(x, b) - _dot(x, a), 20 * EPS, settle)


def _cosine(p, q, r2: Fraction) -> int:
    """Sign of the cosine of a chord less that of the angle between p and q: 1 if they are further apart than the chord."""
    cos = 1 - r2 / 2
    return _sgn(_signed_square(cos) * _xdot(p, p) * _xdot(q, q) - _signed_square(_xdot(p, q)))


def compare_distance(x: Array, y: Array, r2: Array) -> Array:
    """Sign of the distance of x and y less the chord whose square is r2."""
    return _decide((1 - r2 / 2) - _dot(x, y), 16 * EPS, lambda i: _cosine(_exact(x[i]), _exact(y[i]), Fraction(float(r2[i]))))


def _edge_exact(p, q, r, r2: Fraction) -> int:
    """compare_edge_distance in fractions; q, r: the edge's ends."""
    n = _xcross(q, r)
    if _xdot(_xcross(n, q), p) > 0 > _xdot(_xcross(n, r), p):
        if r2 >= 2:
            return -1  # an inside point is within a right angle
        sin2 = r2 * (1 - r2 / 4)
        off = _xdot(n, p)
        return _sgn(off * off - sin2 * _xdot(n, n) * _xdot(p, p)) if r2 >= 0 else 1
    return min(_cosine(p, q, r2), _cosine(p, r, r2)) if r2 >= 0 else 1


def compare_edge_distance(x: Array, a0: Array, a1: Array, r2: Array) -> Array:
    """Sign of the distance of x from the edge less the chord."""
    n = np.cross(a0, a1)
    inside = (_dot(np.cross(n, a0), x) > 1e-14) & (_dot(np.cross(n, a1), x) < -1e-14)
    outside = (_dot(np.cross(n, a0), x) < -1e-14) | (_dot(np.cross(n, a1), x) > 1e-14)
    size = np.maximum(np.linalg.norm(n, axis=1), 1e-300)
    to_circle = np.abs(_dot(n, x)) / size - np.sqrt(np.maximum(0, r2 * (1 - r2 / 4)))
    to_ends = np.minimum(1 - _dot(x, a0), 1 - _dot(x, a1)) - r2 / 2
    value = np.where(inside & (r2 < 2), to_circle, np.where(inside, -1.0, to_ends))
    value = np.where((inside | outside) & (size > 1e-6) & (r2 >= 0), value, 0.0)
    return _decide(value, 1e-13, lambda i: _edge_exact(_exact(x[i]), _exact(a0[i]), _exact(a1[i]), Fraction(float(r2[i]))))


def compare_edge_pair_distance(a0: Array, a1: Array, b0: Array, b1: Array, r2: Array) -> Array:
    """Sign of the distance of two edges less the chord; edges that cross are at distance 0."""
    out = np.minimum.reduce([compare_edge_distance(a0, b0, b1, r2), compare_edge_distance(a1, b0, b1, r2), compare_edge_distance(b0, a0, a1, r2), compare_edge_distance(b1, a0, a1, r2)])
    cross = np.array([exact.crossing_sign(tuple(p), tuple(q), tuple(r), tuple(s)) >= 0 for p, q, r, s in zip(a0, a1, b0, b1, strict=True)], bool)
    return np.where(cross, -np.sign(r2), out).astype(np.int32)


def compare_edge_directions(a0: Array, a1: Array, b0: Array, b1: Array) -> Array:
    """1 if the directions of two edges' circles are within a right angle, -1 if beyond."""
    value = _dot(np.cross(a0, a1), np.cross(b0, b1))
    return _decide(value, 20 * EPS, lambda i: _sgn(_xdot(_xcross(_exact(a0[i]), _exact(a1[i])), _xcross(_exact(b0[i]), _exact(b1[i])))))


def circle_edge_intersection_sign(a: Array, b: Array, n: Array, x: Array) -> Array:
    """On which side of the circle about x the edge ab meets the circle about n (the meeting point that is on the edge)."""
    value = _dot(np.cross(np.cross(a, b), n), x)
    return _decide(value, 30 * EPS, lambda i: _sgn(_xdot(_xcross(_xcross(_exact(a[i]), _exact(b[i])), _exact(n[i])), _exact(x[i]))))


def circle_edge_intersection_ordering(a: Array, b: Array, c: Array, d: Array, m: Array, n: Array) -> Array:
    """Where edges ab and cd meet the circle about n: -1 if ab's point is nearer the circle about m, 1 if cd's is, 0 if neither."""

    def settle(i: int) -> int:
        p = _xcross(_xcross(_exact(a[i]), _exact(b[i])), _exact(n[i]))
        q = _xcross(_xcross(_exact(c[i]), _exact(d[i])), _exact(n[i]))
        k = _exact(m[i])
        return _sgn(_signed_square(_xdot(p, k)) * _xdot(q, q) - _signed_square(_xdot(q, k)) * _xdot(p, p))

    p, q = np.cross(np.cross(a, b), n), np.cross(np.cross(c, d), n)
    size_p, size_q = np.maximum(np.linalg.norm(p, axis=1), 1e-300), np.maximum(np.linalg.norm(q, axis=1), 1e-300)
    value = np.where((size_p > 1e-3) & (size_q > 1e-3), _dot(p, m) / size_p - _dot(q, m) / size_q, 0.0)
    return _decide(value, 1e-11, settle)


def edge_circumcenter_sign(x0: Array, x1: Array, a: Array, b: Array, c: Array) -> Array:
    """On which side of the edge x0 x1 the centre of the circle through a, b, c lies (seen counterclockwise); 0 only if two of them are equal."""
    orient = sign(a, b, c)
    z = np.cross(a, b) + np.cross(b, c) + np.cross(c, a)  # of unit vectors

    def settle(i: int) -> int:
        p, q, r = _exact(a[i]), _exact(b[i]), _exact(c[i])
        z = tuple(map(sum, zip(_xcross(p, q), _xcross(q, r), _xcross(r, p), strict=True)))
        return _sgn(_xdot(_xcross(_exact(x0[i]), _exact(x1[i])), z)) or _sgn(_before(a[i], b[i]) - 0.5)

    return np.where(orient == 0, 0, orient * _decide(_dot(np.cross(x0, x1), z), 40 * EPS, settle)).astype(np.int32)


#: Which of two sites the other leaves nothing of an edge.
FIRST, SECOND, NEITHER, UNCERTAIN = "FIRST", "SECOND", "NEITHER", "UNCERTAIN"


def voronoi_site_exclusion(a: Array, b: Array, x0: Array, x1: Array, r: Array) -> list[str]:
    """Of two sites within an angle r of the edge, a nearer x0: whether all that is within r of one is nearer the other.

    The part of the edge within r of a site is an interval about the site's foot; a site is excluded if the other is nearer at both of
    its ends. Ends within rounding of a tie give UNCERTAIN.
    """
    n = np.cross(x0, x1)
    n /= np.linalg.norm(n, axis=1)[:, None]

    def ends(p: Array) -> tuple[Array, Array]:
        off = _dot(n, p)
        foot = p - n * off[:, None]
        foot /= np.linalg.norm(foot, axis=1)[:, None]
        half = np.arccos(np.clip(np.cos(r) / np.maximum(np.sqrt(1 - off * off), 1e-300), -1, 1))
        along = np.cross(n, foot)
        low, high = (foot * np.cos(half)[:, None] + along * (way * np.sin(half))[:, None] for way in (-1, 1))
        low = np.where((_dot(np.cross(x0, low), n) < 0)[:, None], x0, low)
        high = np.where((_dot(np.cross(high, x1), n) < 0)[:, None], x1, high)
        return low, high

    out = []
    a_low, a_high = ends(a)
    b_low, b_high = ends(b)
    first = np.maximum(_dot(a_low, a) - _dot(a_low, b), _dot(a_high, a) - _dot(a_high, b))  # below 0: b is nearer at both
    second = np.maximum(_dot(b_low, b) - _dot(b_low, a), _dot(b_high, b) - _dot(b_high, a))
    for f, s in zip(first, second, strict=True):
        out.append(FIRST if f < -1e-14 else SECOND if s < -1e-14 else UNCERTAIN if min(abs(f), abs(s)) <= 1e-14 else NEITHER)
    return out


# --- crossings at vertices ------------------------------------------------------------------------


def ref_dir(v) -> tuple[float, float, float]:
    """A unit vector at right angles to v that is a function of v alone."""
    x, y, z = (abs(c) for c in v)
    axis = 2 if x > y and x > z else 0 if y > z else 1
    small = (0.012, 0.0053, 0.00457)  # fixed values, as in `points.ortho`
    t = [1.0 if i == axis else small[i] for i in range(3)]
    n = np.cross(v, t)
    return tuple(float(c) for c in n / np.linalg.norm(n))


def angle_contains_vertex(a, b, c) -> bool:
    """Whether the angle a-b-c, its inside on the left, holds b: whether `ref_dir` points into it. c's side is closed, a's open."""
    return not exact.ordered_ccw(ref_dir(b), c, a, b)


def vertex_crossing(a, b, c, d) -> bool:
    """For edges ab and cd that share a vertex: whether they count as crossing there, so that a chain that passes a vertex of a loop
    counts as often as it enters and leaves. It does if, about the common vertex, the second edge is met before the first, going
    counterclockwise from `ref_dir`."""
    return signed_vertex_crossing(a, b, c, d) != 0


def signed_vertex_crossing(a, b, c, d) -> int:
    """As vertex_crossing; 1 if cd crosses ab from right to left, -1 from left to right."""
    if a == b or c == d:
        return 0
    shared = next(((v, mine, other, way) for v, mine, w, other, way in ((a, b, c, d, 1), (b, a, d, c, 1), (a, b, d, c, -1), (b, a, c, d, -1)) if v == w), None)
    if shared is None:
        raise ValueError("edges share no vertex")
    v, mine, other, way = shared
    if mine == other:
        # the whole edge, once: counted at its first end
        return way
    return way if exact.ordered_ccw(ref_dir(v), other, mine, v) else 0


def edge_or_vertex_crossing(a, b, c, d) -> bool:
    s = exact.crossing_sign(a, b, c, d)
    return s > 0 or (s == 0 and vertex_crossing(a, b, c, d))


def signed_edge_or_vertex_crossing(a, b, c, d) -> int:
    """1 if cd crosses ab from right to left, -1 from left to right, 0 if not."""
    s = exact.crossing_sign(a, b, c, d)
    if s > 0:
        return exact.sign(a, b, d)
    return signed_vertex_crossing(a, b, c, d) if s == 0 else 0


def edges_cross(a: Array, b: Array, c: Array, d: Array) -> Array:
    """crossing_sign of rows: 1 inside both, 0 at a common vertex, -1 not."""
    return np.array([exact.crossing_sign(tuple(p), tuple(q), tuple(r), tuple(s)) for p, q, r, s in zip(a, b, c, d, strict=True)], np.int32)


def by_row(f: Callable) -> Callable[..., Array]:
    """A predicate of single points as one of arrays of points."""
    return lambda *columns: np.array([f(*[tuple(map(float, p)) for p in row]) for row in zip(*columns, strict=True)])


def column(f: Callable, returns: str, *arguments) -> Column:
    """f as a column. arguments: Vec (three columns, an array of points to f) or a number column. Rows with a null get null."""
    flat, shape = [], []
    for a in arguments:
        flat += list(a) if isinstance(a, tuple) else [a]
        shape.append(3 if isinstance(a, tuple) else 1)

    @F.pandas_udf(returns)
    def run(*series: pd.Series) -> pd.Series:
        values = np.stack([s.to_numpy(float) for s in series], 1)
        good = ~np.isnan(values).any(1)
        parts, at = [], 0
        for n in shape:
            part = values[good, at : at + n]
            parts.append(part if n == 3 else part[:, 0])
            at += n
        out: list = [None] * len(values)
        if good.any():
            found = f(*parts)
            for i, value in zip(np.flatnonzero(good), found.tolist() if isinstance(found, np.ndarray) else found, strict=True):
                out[i] = value
        return pd.Series(out, dtype=object)

    return run(*flat)
