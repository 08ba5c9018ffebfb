"""Signs that are always right: doubles with an error bound, then exact fractions, then a consistent tie break.

Used where geometry is built point by point in Python; the double-only forms in `functions.edges` serve bulk filters.
"""

from __future__ import annotations

from fractions import Fraction

Point = tuple[float, float, float]
#: Largest rounding error of the determinant of three unit vectors in doubles.
_BOUND = 1.8274 * 2.220446049250313e-16 * 2


def _det(a, b, c):
    return a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def sign(a: Point, b: Point, c: Point) -> int:
    """1 if a, b, c are counterclockwise, -1 if clockwise, 0 only if two are equal.

    Three different points on one great circle are told apart as if each had been moved by an
    infinitesimal amount that depends on its rank in lexicographic order.
    """
    d = _det(a, b, c)
    if d > _BOUND:
        return 1
    if d < -_BOUND:
        return -1
    if a == b or b == c or a == c:
        return 0
    fa, fb, fc = ([Fraction(x) for x in p] for p in (a, b, c))
    d = _det(fa, fb, fc)
    if d:
        return 1 if d > 0 else -1
    return _perturbed(a, b, c)


def _perturbed(a: Point, b: Point, c: Point) -> int:
    """Sort the points; coordinates get powers of an infinitesimal, larger for later points; the first minor that isn't zero decides."""
    order = sorted(range(3), key=lambda i: (a, b, c)[i])
    even = order in ([0, 1, 2], [1, 2, 0], [2, 0, 1])
    p = [[Fraction(x) for x in (a, b, c)[i]] for i in order]
    parity = 1 if even else -1
    # minors of the matrix without the rows that were moved, from the least moved on
    for row in (2, 1, 0):
        others = [p[r] for r in range(3) if r != row]
        for col in (2, 1, 0):
            k = [x for x in range(3) if x != col]
            m = others[0][k[0]] * others[1][k[1]] - others[0][k[1]] * others[1][k[0]]
            if m:
                return parity * (1 if (m > 0) == ((row + col) % 2 == 0) else -1)
    return parity


def crossing_sign(a: Point, b: Point, c: Point, d: Point) -> int:
    """1 if edges ab and cd cross inside both, 0 if they share a vertex, else -1."""
    if a in (c, d) or b in (c, d):
        return 0
    if a == b or c == d:
        return -1
    s = sign(a, b, c)
    if sign(a, b, d) == s:
        return -1
    return 1 if sign(c, d, b) == s and sign(c, d, a) == -s else -1


def ordered_ccw(a: Point, b: Point, c: Point, o: Point) -> bool:
    return (sign(b, o, a) >= 0) + (sign(c, o, b) >= 0) + (sign(a, o, c) > 0) >= 2
