"""Vector algebra in DuckDB SQL, a step at a time: each step is a CTE that adds columns to the one before."""

from __future__ import annotations


class Steps:
    """CTEs in a row; the last one is `name`."""

    def __init__(self, first: str, name: str):
        self.parts, self.name, self.count = [first], name, 0

    def add(self, **columns: str) -> Steps:
        new = f"s{self.count}_"
        self.count += 1
        self.parts.append(f"{new} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {self.name})")
        self.name = new
        return self

    def where(self, condition: str) -> Steps:
        new = f"s{self.count}_"
        self.count += 1
        self.parts.append(f"{new} AS (SELECT * FROM {self.name} WHERE {condition})")
        self.name = new
        return self

    def vector(self, name: str, of: tuple[str, str, str]) -> Steps:
        return self.add(**{f"{name}_{a}": e for a, e in zip("xyz", of, strict=True)})

    def cross(self, name: str, a: str, b: str) -> Steps:
        return self.vector(name, cross(a, b))

    def edge_distance(self, out: str, p: str, a: str, b: str) -> Steps:
        """`out`: angle from p to the edge ab, by the plane of the edge where p is beside it, else by its ends."""
        n = f"{out}n"
        self.cross(n, a, b)
        beside = f"{dot3(cross(n, a), p)} > 0 AND {dot3(cross(n, b), p)} < 0"
        inside = f"asin(least(1e0, abs({dot(n, p)}) / sqrt({dot(n, n)})))"
        return self.add(**{out: f"CASE WHEN {beside} THEN {inside} ELSE least({angle(p, a)}, {angle(p, b)}) END"})

    def sql(self, select: str) -> str:
        return f"WITH {', '.join(self.parts)} {select.replace('FROM _', 'FROM ' + self.name)}"


def dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}_{c}*{b}_{c}" for c in "xyz") + ")"


def dot3(v: tuple[str, str, str], b: str) -> str:
    return "(" + " + ".join(f"({e})*{b}_{c}" for e, c in zip(v, "xyz", strict=True)) + ")"


def cross(a: str, b: str) -> tuple[str, str, str]:
    return f"{a}_y*{b}_z - {a}_z*{b}_y", f"{a}_z*{b}_x - {a}_x*{b}_z", f"{a}_x*{b}_y - {a}_y*{b}_x"


def norm(v: tuple[str, str, str]) -> str:
    return "sqrt(" + " + ".join(f"({e})*({e})" for e in v) + ")"


def chord2(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}_{c}-{b}_{c})*({a}_{c}-{b}_{c})" for c in "xyz") + ")"


def angle(a: str, b: str) -> str:
    return f"atan2({norm(cross(a, b))}, {dot(a, b)})"


def triple(a: str, b: str, c: str) -> str:
    return dot3(cross(a, b), c)


def area(a: str, b: str, c: str) -> str:
    """Signed solid angle of a triangle."""
    return f"(2 * atan2({triple(a, b, c)}, 1 + {dot(a, b)} + {dot(b, c)} + {dot(a, c)}))"


def at(lat: str, lng: str) -> tuple[str, str, str]:
    """The unit vector of degrees."""
    return f"cos(radians({lng})) * cos(radians({lat}))", f"sin(radians({lng})) * cos(radians({lat}))", f"sin(radians({lat}))"


def st_to_uv(s: str) -> str:
    return f"(CASE WHEN {s} >= 0.5e0 THEN (4 * ({s}) * ({s}) - 1) / 3 ELSE (1 - 4 * (1 - ({s})) * (1 - ({s}))) / 3 END)"


def face_xyz(face: str, u: str, v: str) -> tuple[str, str, str]:
    """On the cube, not of unit length."""
    rows = (("1e0", u, v), (f"-({u})", "1e0", v), (f"-({u})", f"-({v})", "1e0"), ("-1e0", f"-({v})", f"-({u})"), (v, "-1e0", f"-({u})"), (v, u, "-1e0"))
    return tuple(f"(CASE {face} " + " ".join(f"WHEN {f} THEN {rows[f][a]}" for f in range(6)) + " END)" for a in range(3))
