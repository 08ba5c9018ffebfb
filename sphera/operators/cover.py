"""Coverings of regions by cells: best first by size, within max_cells, min_level, max_level and level_mod.

Runs in Python on one region at a time (`cover_udf` over columns of regions); a region's covering is at most
a few cells more than max_cells, so its size is bounded.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sphera.functions.cells import _TO_IJ, _TO_POS, MAX_LEVEL, SIZE
from sphera.operators.shapes import Point, angle, contains, distance_to_edge, edges, unit

MASK = (1 << 64) - 1


def signed(cell: int) -> int:
    return cell - (1 << 64) if cell >= 1 << 63 else cell


def lsb(cell: int) -> int:
    return cell & -cell


def level(cell: int) -> int:
    return MAX_LEVEL - (lsb(cell).bit_length() - 1) // 2


def parent(cell: int, at: int) -> int:
    bit = 1 << 2 * (MAX_LEVEL - at)
    return cell & -bit & MASK | bit


def children(cell: int) -> list[int]:
    bit = lsb(cell) >> 2
    return [cell + (2 * k - 3) * bit for k in range(4)]


def _face_ij(cell: int) -> tuple[int, int, int, int]:
    """Face, and the low corner i, j and the side of the cell's square."""
    face, bits, i, j = cell >> 61, cell >> 61 & 1, 0, 0
    for k in range(7, -1, -1):
        t = _TO_IJ[(cell >> 8 * k + 1 & ((1 << 2 * (2 if k == 7 else 4)) - 1)) << 2 | bits]
        i, j, bits = i | t >> 6 << 4 * k, j | (t >> 2 & 15) << 4 * k, t & 3
    size = 1 << MAX_LEVEL - level(cell)
    return face, i & -size, j & -size, size


def _uv(s: float) -> float:
    return (4 * s * s - 1) / 3 if s >= 0.5 else (1 - 4 * (1 - s) * (1 - s)) / 3


def _xyz(face: int, u: float, v: float) -> Point:
    return unit(((1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1))[face])


def cell_at(p: Point, at: int = MAX_LEVEL) -> int:
    """The cell of a level that holds a point."""
    x, y, z = p
    big = max(range(3), key=lambda i: (abs(p[i]), i))
    face = big if p[big] > 0 else big + 3
    u, v = ((y / x, z / x), (-x / y, z / y), (-x / z, -y / z), (z / x, y / x), (z / y, -x / y), (-y / z, -x / z))[face] if any(p) else (0.0, 0.0)
    st = lambda c: 0.5 * math.sqrt(1 + 3 * c) if c >= 0 else 1 - 0.5 * math.sqrt(1 - 3 * c)
    i, j = (max(0, min(SIZE - 1, math.floor(SIZE * st(c)))) for c in (u, v))
    pos, bits = face << 60, face & 1
    for k in range(7, -1, -1):
        t = _TO_POS[(i >> 4 * k & 15) << 6 | (j >> 4 * k & 15) << 2 | bits]
        pos, bits = pos | t >> 2 << 8 * k, t & 3
    return parent(pos << 1 | 1, at)


@functools.lru_cache(1 << 14)
def _vertices(cell: int) -> tuple[Point, ...]:
    face, i, j, size = _face_ij(cell)
    a, b, c, d = (_uv(x / SIZE) for x in (i, i + size, j, j + size))
    return _xyz(face, a, c), _xyz(face, b, c), _xyz(face, b, d), _xyz(face, a, d)


def vertices(cell: int) -> list[Point]:
    """Counterclockwise. A covering asks for the same cells again and again."""
    return list(_vertices(cell))


def center(cell: int) -> Point:
    face, i, j, size = _face_ij(cell)
    return _xyz(face, _uv((i + size / 2) / SIZE), _uv((j + size / 2) / SIZE))


@dataclass(frozen=True)
class CapRegion:
    center: Point
    radius: float

    def may_intersect(self, cell: int) -> bool:
        corners = vertices(cell)
        return contains(corners, self.center) or min(distance_to_edge(self.center, a, b) for a, b in edges(corners)) <= self.radius

    def contains_cell(self, cell: int) -> bool:
        if self.radius >= math.pi:
            return True
        corners = vertices(cell)
        if any(angle(self.center, v) > self.radius for v in corners):
            return False
        anti = CapRegion(tuple(-x for x in self.center), math.pi - self.radius)
        return not anti.may_intersect(cell)


@dataclass(frozen=True)
class LoopRegion:
    loop: tuple[Point, ...]

    def may_intersect(self, cell: int) -> bool:
        from sphera.operators.shapes import intersects

        return intersects([list(self.loop)], [vertices(cell)])

    def contains_cell(self, cell: int) -> bool:
        from sphera.operators.shapes import contains_loop

        return contains_loop(list(self.loop), vertices(cell))


@dataclass(frozen=True)
class PointRegion:
    point: Point

    def may_intersect(self, cell: int) -> bool:
        c = cell_at(self.point)
        return abs(c - cell) < lsb(cell)

    def contains_cell(self, cell: int) -> bool:
        return False

    def cap_bound(self) -> tuple[Point, float]:
        return self.point, 0.0


@dataclass(frozen=True)
class CellRegion:
    cell: int

    def may_intersect(self, cell: int) -> bool:
        a, b = (cell, self.cell) if lsb(cell) > lsb(self.cell) else (self.cell, cell)
        return abs(a - b) < lsb(a)

    def contains_cell(self, cell: int) -> bool:
        return lsb(cell) <= lsb(self.cell) and abs(cell - self.cell) < lsb(self.cell)

    def cap_bound(self) -> tuple[Point, float]:
        mid = center(self.cell)
        return mid, max(angle(mid, v) for v in vertices(self.cell))


@dataclass(frozen=True)
class RectRegion:
    """Between two latitudes and, going east, two longitudes, in radians."""

    lat_lo: float
    lat_hi: float
    lng_lo: float
    lng_hi: float

    def _holds(self, p: Point) -> bool:
        lat, lng = math.atan2(p[2], math.hypot(p[0], p[1])), math.atan2(p[1], p[0])
        width = (self.lng_hi - self.lng_lo) % (2 * math.pi) if self.lng_hi - self.lng_lo < 2 * math.pi else 2 * math.pi
        return self.lat_lo <= lat <= self.lat_hi and (lng - self.lng_lo) % (2 * math.pi) <= width

    def _corners(self) -> list[Point]:
        return [unit((math.cos(b) * math.cos(a), math.sin(b) * math.cos(a), math.sin(a))) for a in (self.lat_lo, self.lat_hi) for b in (self.lng_lo, self.lng_hi)]

    def may_intersect(self, cell: int) -> bool:
        """Conservative: a corner in the cell, a vertex or the centre in the rectangle, or the cap of one near that of the other."""
        corners = vertices(cell)
        if any(self._holds(v) for v in [*corners, center(cell)]) or any(contains(corners, p) for p in self._corners()):
            return True
        mid, radius = self.cap_bound()
        own, reach = CellRegion(cell).cap_bound()
        return angle(mid, own) <= radius + reach

    def contains_cell(self, cell: int) -> bool:
        corners = vertices(cell)
        # an edge may bulge towards a pole beyond its ends by no more than this
        bulge = max(angle(a, b) for a, b in edges(corners)) ** 2
        inner = RectRegion(self.lat_lo + bulge, self.lat_hi - bulge, self.lng_lo, self.lng_hi)
        return all(inner._holds(v) for v in corners)

    def cap_bound(self) -> tuple[Point, float]:
        lat, lng = (self.lat_lo + self.lat_hi) / 2, self.lng_lo + ((self.lng_hi - self.lng_lo) % (2 * math.pi)) / 2
        mid = unit((math.cos(lng) * math.cos(lat), math.sin(lng) * math.cos(lat), math.sin(lat)))
        return mid, max(angle(mid, p) for p in self._corners()) if (self.lng_hi - self.lng_lo) % (2 * math.pi) <= math.pi else math.pi


@dataclass(frozen=True)
class UnionRegion:
    """Whatever is in one of the parts."""

    parts: tuple

    def added(self, part) -> UnionRegion:
        return UnionRegion((*self.parts, part))

    def may_intersect(self, cell: int) -> bool:
        return any(p.may_intersect(cell) for p in self.parts)

    def contains_cell(self, cell: int) -> bool:
        return any(p.contains_cell(cell) for p in self.parts)


@dataclass(frozen=True)
class IntersectionRegion:
    """Whatever is in all of the parts."""

    parts: tuple

    def may_intersect(self, cell: int) -> bool:
        return all(p.may_intersect(cell) for p in self.parts)

    def contains_cell(self, cell: int) -> bool:
        return all(p.contains_cell(cell) for p in self.parts)


@dataclass(frozen=True)
class BufferedRegion:
    """All within an angle of loops."""

    loops: tuple[tuple[Point, ...], ...]
    radius: float

    def _distance(self, corners: list[Point]) -> float:
        own = edges(corners)
        return min(min(distance_to_edge(v, c, d), distance_to_edge(c, a, b)) for loop in self.loops for c, d in edges(list(loop)) for a, b in own for v in (a,))

    def may_intersect(self, cell: int) -> bool:
        corners = vertices(cell)
        return any(LoopRegion(loop).may_intersect(cell) for loop in self.loops) or self._distance(corners) <= self.radius

    def contains_cell(self, cell: int) -> bool:
        corners = vertices(cell)
        mid, reach = CellRegion(cell).cap_bound()
        near = min(distance_to_edge(mid, a, b) for loop in self.loops for a, b in edges(list(loop)))
        return any(LoopRegion(loop).contains_cell(cell) for loop in self.loops) or (near + reach <= self.radius and bool(corners))

    def covering(self, max_cells: int = 8) -> list[int]:
        return cover(self, max_cells)


def fast_cover(cap: CapRegion) -> list[int]:
    """At most four cells that hold a cap: those about the vertex nearest its centre on the finest level wide enough; all faces if it is too wide."""
    from sphera.operators.nearest import level_for_radius

    at = level_for_radius(cap.radius)
    if at < 1:
        return [(face << 61) + (1 << 60) for face in range(6)]
    found = [c for c in _block(cap.center, at) if cap.may_intersect(c)]
    return sorted(set(found))


def _block(p: Point, at: int) -> list[int]:
    """The cells of a level about a point: its own and those that points about a cell's width away are in."""
    own = cell_at(p, at)
    out = {own}
    for v in vertices(own):
        away = unit(tuple(2 * a - b for a, b in zip(v, center(own), strict=True)))
        out.add(cell_at(away, at))
    for a, b in edges(vertices(own)):
        m = unit(tuple(s + t for s, t in zip(a, b, strict=True)))
        out.add(cell_at(unit(tuple(2 * s - t for s, t in zip(m, center(own), strict=True))), at))
    return sorted(out)


def cover(region, max_cells: int = 8, min_level: int = 0, max_level: int = MAX_LEVEL, level_mod: int = 1, interior: bool = False) -> list[int]:
    """Sorted unsigned ids. Larger cells are refined first; among equals those with fewer intersecting, then fewer contained children.

    min_level wins over max_cells. interior: only cells inside the region.
    """
    out: list[int] = []
    queue: list[tuple] = []

    def add(cell: int) -> None:
        if not region.may_intersect(cell):
            return
        at = level(cell)
        whole = at >= min_level and region.contains_cell(cell)
        last = at + level_mod > max_level
        if whole or (not interior and last):
            out.append(cell)
            return
        if last:
            return
        grown = [cell]
        for _ in range(level_mod):
            grown = [k for c in grown for k in children(c)]
        grown = [k for k in grown if region.may_intersect(k)]
        inside = sum(level(k) >= min_level and region.contains_cell(k) for k in grown)
        heapq.heappush(queue, ((at, len(grown), inside), cell, grown))

    for face in range(6):
        add((face << 61) + (1 << 60))
    while queue and (not interior or len(out) < max_cells):
        (at, _, _), cell, grown = heapq.heappop(queue)
        if interior or at < min_level or len(grown) == 1 or len(out) + len(queue) + len(grown) <= max_cells:
            for k in grown:
                if not interior or len(out) < max_cells:
                    add(k)
        else:
            out.append(cell)
    return canonical(out, min_level, level_mod)


def canonical(cells: list[int], min_level: int = 0, level_mod: int = 1) -> list[int]:
    """Sorted, disjoint, four siblings as their parent where that is not above min_level and at a multiple of level_mod."""
    out: list[int] = []
    for c in sorted(cells):
        while out and (out[-1] - (lsb(out[-1]) - 1)) >= c - (lsb(c) - 1):
            out.pop()
        if out and c + (lsb(c) - 1) <= out[-1] + (lsb(out[-1]) - 1):
            continue
        out.append(c)
        while level_mod == 1 and len(out) >= 4 and level(out[-1]) > min_level:
            up = parent(out[-1], level(out[-1]) - 1)
            if out[-4:] != children(up):
                break
            out[-4:] = [up]
    return out


def is_canonical(cells: list[int], min_level: int = 0, max_level: int = MAX_LEVEL, level_mod: int = 1) -> bool:
    return cells == canonical(cells, min_level, level_mod) and all(min_level <= level(c) <= max_level and (level(c) - min_level) % level_mod == 0 for c in cells)


def simple_cover(region, start: Point, at: int, encode: Callable[[Point, int], int], neighbors: Callable[[int], list[int]]) -> list[int]:
    """All connected cells of one level from the start's cell on that meet the region (flood fill)."""
    first = encode(start, at)
    seen, stack, out = {first}, [first], []
    while stack:
        c = stack.pop()
        if not region.may_intersect(c):
            continue
        out.append(c)
        for n in neighbors(c):
            if n not in seen:
                seen.add(n)
                stack.append(n)
    return sorted(out)


def cover_caps(x: Column, y: Column, z: Column, radius: Column, **options) -> Column:
    """array<bigint> coverings of caps given as columns."""

    @F.pandas_udf("array<bigint>")
    def run(x: pd.Series, y: pd.Series, z: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([[signed(c) for c in cover(CapRegion((a, b, d), e), **options)] for a, b, d, e in zip(x, y, z, r, strict=True)])

    return run(x, y, z, radius)
