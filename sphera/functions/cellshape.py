"""Cells as spherical quadrilaterals: vertices, edges, areas, bounds, distances, containment, and cells with padding.

`with_shape` decodes a cell once into a struct column; a `CellShape` over it gives Column expressions. Vertices go
counterclockwise from the lower left of the face's (u, v) plane; edge k runs from vertex k to the next.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphera.functions import cells, edges
from sphera.functions.intervals import Arc, Line
from sphera.functions.points import Vec, chord2
from sphera.functions.regions import Cap, PlaneRect, Rect

PI = math.pi
#: The axes u, v, w of each face, as the axis (0 to 2) and its sign.
AXES = (((1, 1), (2, 1), (0, 1)), ((0, -1), (2, 1), (1, 1)), ((0, -1), (1, -1), (2, 1)), ((2, -1), (1, -1), (0, -1)), ((2, -1), (0, 1), (1, -1)), ((1, 1), (0, 1), (2, -1)))


def _by_face(face: Column, value) -> Column:
    out = F.when(face == 0, F.lit(value(0)))
    for f in range(1, 6):
        out = out.when(face == f, F.lit(value(f)))
    return out


def uvw_axis(face: Column, axis: int) -> Vec:
    """Unit vector of a face's u (0), v (1) or w (2) axis; w is its normal."""
    return Vec(*[_by_face(face, lambda f, i=i: float(AXES[f][axis][1]) if AXES[f][axis][0] == i else 0.0) for i in range(3)])


def uvw_face(face: Column, axis: int, direction: int) -> Column:
    """The face that lies along a face's axis: direction 1, or against it: 0."""

    def find(f: int) -> int:
        of, sign = AXES[f][axis]
        want = (of, sign if direction else -sign)
        return next(g for g in range(6) if AXES[g][2] == want)

    return _by_face(face, find)


def xyz_to_uvw(face: Column | int, p: Vec) -> Vec:
    """p in the coordinates of a face's axes."""
    if isinstance(face, int):
        return Vec(*[p[axis] * float(sign) for axis, sign in AXES[face]])
    return Vec(*[uvw_axis(face, a).dot(p) for a in range(3)])


def u_normal(face: Column, u: Column) -> Vec:
    """Normal (not of unit length) of the plane through the centre and the line of constant u, that line going up v."""
    return uvw_axis(face, 2).times(u).minus(uvw_axis(face, 0))


def v_normal(face: Column, v: Column) -> Vec:
    """As u_normal of the line of constant v, going up u."""
    return uvw_axis(face, 1).minus(uvw_axis(face, 2).times(v))


def with_shape(df: DataFrame, cell: str = "cell", out: str = "shape") -> DataFrame:
    """df with the struct `out`: cell, face, level, orientation, i, j (of the lower left leaf), size, the bounds u0, u1, v0, v1, the unit
    vectors mid (of the square in (u, v)) and vertices, and sides, the pairs of vertices a, b."""
    df = cells.decode(df, cell, "__s")
    size = cells.size_ij(cells.level(F.col(cell)))
    df = df.withColumns({"__size": size, "__i0": F.col("__si").bitwiseAND(-size), "__j0": F.col("__sj").bitwiseAND(-size)})
    uv = lambda ij: cells.st_to_uv(ij / float(cells.SIZE))
    df = cells.fenced(df, {"__u0": uv(F.col("__i0")), "__u1": uv(F.col("__i0") + F.col("__size")), "__v0": uv(F.col("__j0")), "__v1": uv(F.col("__j0") + F.col("__size"))})
    u0, u1, v0, v1 = (F.col(x) for x in ("__u0", "__u1", "__v0", "__v1"))
    corners = [(u0, v0), (u1, v0), (u1, v1), (u0, v1), (0.5 * (u0 + u1), 0.5 * (v0 + v1))]
    df = cells.fenced(df, {f"__p{k}": cells.face_uv_to_xyz(F.col("__sface"), *uv).struct() for k, uv in enumerate(corners)})
    df = cells.fenced(df, {f"__p{k}": Vec.of(f"__p{k}").normalized().struct() for k in range(5)})
    vertex = [F.col(f"__p{k}") for k in range(4)]
    shape = F.struct(
        F.col(cell).alias("cell"), F.col("__sface").alias("face"), cells.level(F.col(cell)).alias("level"), F.col("__sorientation").alias("orientation"), F.col("__i0").alias("i"), F.col("__j0").alias("j"),
        F.col("__size").alias("size"), u0.alias("u0"), u1.alias("u1"), v0.alias("v0"), v1.alias("v1"), F.col("__p4").alias("mid"), F.array(*vertex).alias("vertices"),
        F.array(*[F.struct(vertex[k].alias("a"), vertex[(k + 1) % 4].alias("b")) for k in range(4)]).alias("sides"),
    )
    return cells.fenced(df, {out: shape}, "__sface", "__si", "__sj", "__sorientation", "__size", "__i0", "__j0", "__u0", "__u1", "__v0", "__v1", *[f"__p{k}" for k in range(5)])


class CellShape(NamedTuple):
    """Expressions over such a struct; what goes over sides or vertices is one lambda, so that trees stay small."""

    face: Column
    u: Line
    v: Line
    level: Column
    cell: Column
    mid: Vec
    corners: Column
    sides: Column

    @classmethod
    def of(cls, column: str = "shape") -> CellShape:
        c = F.col(column)
        return cls(c["face"], Line(c["u0"], c["u1"]), Line(c["v0"], c["v1"]), c["level"], c["cell"], Vec.of(c["mid"]), c["vertices"], c["sides"])

    def bound_uv(self) -> PlaneRect:
        return PlaneRect(self.u, self.v)

    def vertex(self, k: int) -> Vec:
        return Vec.of(self.corners[k % 4])

    def vertices(self) -> list[Vec]:
        return [self.vertex(k) for k in range(4)]

    def over_sides(self, f) -> Column:
        """f(a, b) of the four sides, as an array."""
        return F.transform(self.sides, lambda e: f(Vec.of(e["a"]), Vec.of(e["b"])))

    def over_vertices(self, f) -> Column:
        return F.transform(self.corners, lambda v: f(Vec.of(v)))

    def edge(self, k: int) -> Vec:
        """Normal of edge k, pointing into the cell, not of unit length."""
        return (v_normal(self.face, self.v.lo), u_normal(self.face, self.u.hi), v_normal(self.face, self.v.hi).times(-1.0), u_normal(self.face, self.u.lo).times(-1.0))[k % 4]

    def uv_of_edge(self, k: int) -> Column:
        """The coordinate that is constant along edge k: v of the first and third, u of the others."""
        return (self.v.lo, self.u.hi, self.v.hi, self.u.lo)[k % 4]

    def center(self) -> Vec:
        """Of the cell's square in (u, v); `cells.with_center` has the centre that an id stands for."""
        return self.mid

    # --- areas

    def average_area(self) -> Column:
        """Of a cell of this level."""
        return cells.AVG_AREA.value(self.level)

    def approx_area(self) -> Column:
        """From the flat quadrilateral, as if it were a cap's disc; within 3 % of the exact area (exact for faces by definition)."""
        v = self.vertices()
        flat = 0.5 * v[2].minus(v[0]).cross(v[3].minus(v[1])).norm()
        curved = flat * 2 / (1 + F.sqrt(1 - F.least(flat / PI, F.lit(1.0))))
        return F.when(self.level < 2, self.average_area()).otherwise(curved)

    def exact_area(self) -> Column:
        v = self.vertices()
        return edges.area(v[0], v[1], v[2]) + edges.area(v[0], v[2], v[3])

    # --- containment and distances

    def contains_point(self, p: Vec) -> Column:
        """Closed: points on a side are inside."""
        return F.forall(self.over_sides(lambda a, b: edges.side(a, b, p)), lambda s: s >= -2.3e-16)

    def contains(self, o: CellShape) -> Column:
        return cells.contains(self.cell, o.cell)

    def may_intersect(self, o: CellShape) -> Column:
        return cells.intersects(self.cell, o.cell)

    def boundary_distance(self, p: Vec) -> Column:
        return F.array_min(self.over_sides(lambda a, b: edges.distance(p, a, b)))

    def distance(self, p: Vec) -> Column:
        return F.when(self.contains_point(p), 0.0).otherwise(self.boundary_distance(p))

    def max_distance(self, p: Vec) -> Column:
        """At a vertex up to a right angle, else as far short of half a turn as the antipode is from the cell."""
        far = F.array_max(self.over_vertices(lambda v: chord2(p, v)))
        return F.when(far <= 2, 2 * F.asin(0.5 * F.sqrt(far))).otherwise(PI - self.distance(p.times(-1.0)))

    def distance_to_edge(self, a: Vec, b: Vec) -> Column:
        apart = F.array_min(self.over_sides(lambda c, d: edges.pair_distance(a, b, c, d)))
        return F.when(self.contains_point(a) | self.contains_point(b), 0.0).otherwise(apart)

    def max_distance_to_edge(self, a: Vec, b: Vec) -> Column:
        ends = F.greatest(self.max_distance(a), self.max_distance(b))
        return F.when(ends <= PI / 2, ends).otherwise(PI - self.distance_to_edge(a.times(-1.0), b.times(-1.0)))

    def distance_to_cell(self, o: CellShape) -> Column:
        """0 if one contains the other, else from a vertex of either to a side of the other."""
        reach = lambda one, two: F.array_min(one.over_vertices(lambda v: two.boundary_distance(v)))
        return F.when(self.may_intersect(o), 0.0).otherwise(F.least(reach(self, o), reach(o, self)))

    def max_distance_to_cell(self, o: CellShape) -> Column:
        """At vertices up to a right angle; beyond, half a turn less how far the antipodes of o's sides are from this cell."""
        far = F.array_max(o.over_vertices(lambda v: self.max_distance(v)))
        near = F.array_min(o.over_sides(lambda a, b: self.distance_to_edge(a.times(-1.0), b.times(-1.0))))
        return F.when(far <= PI / 2, far).when(o.contains_point(self.mid.times(-1.0)), PI).otherwise(PI - near)

    def is_distance_less(self, p: Vec, radians: Column | float) -> Column:
        return self.distance(p) < radians

    def is_max_distance_less(self, p: Vec, radians: Column | float) -> Column:
        return self.max_distance(p) < radians

    # --- bounds

    def cap_bound(self) -> Cap:
        """About the middle, out to the furthest vertex."""
        return Cap(self.mid, F.array_max(self.over_vertices(lambda v: chord2(self.mid, v))))

    def rect_bound(self) -> Rect:
        """Latitudes of the sides' highest and lowest points; a pole inside takes all longitudes, else they are the vertices'."""
        north, south = (self.contains_point(Vec.lit(0.0, 0.0, z)) for z in (1.0, -1.0))
        first = self.vertex(0)
        lng = F.atan2(first.y, first.x)
        turns = self.over_vertices(lambda p: F.atan2(first.x * p.y - first.y * p.x, first.x * p.x + first.y * p.y))
        turned = lambda x: F.atan2(F.sin(x), F.cos(x))
        lats = Line(F.when(south, -PI / 2).otherwise(F.array_min(self.over_sides(lambda a, b: edge_latitudes(a, b)[1]))), F.when(north, PI / 2).otherwise(F.array_max(self.over_sides(lambda a, b: edge_latitudes(a, b)[0]))))
        return Rect(lats, Arc.first_of((north | south, Arc.full()), otherwise=Arc(turned(lng + F.array_min(turns)), turned(lng + F.array_max(turns)))))


def edge_latitudes(a: Vec, b: Vec) -> tuple[Column, Column]:
    """Highest and lowest latitude of an edge: at an end, or where its circle is highest or lowest, if that is between the ends."""
    n = a.cross(b)
    flat2 = n.x * n.x + n.y * n.y
    tilt = F.atan2(F.sqrt(flat2), F.abs(n.z))  # the circle's highest latitude
    top = Vec(-n.x * n.z, -n.y * n.z, flat2)
    toward = lambda p: (n.cross(a).dot(p) > 0) & (n.cross(b).dot(p) < 0)
    lat = lambda p: F.atan2(p.z, F.hypot(p.x, p.y))
    ends = lat(a), lat(b)
    return F.when(toward(top), tilt).otherwise(F.greatest(*ends)), F.when(toward(top.times(-1.0)), -tilt).otherwise(F.least(*ends))


# --- cells with padding -------------------------------------------------------------------------


def padded_bound(shape: CellShape, padding: Column | float) -> PlaneRect:
    return shape.bound_uv().expanded(padding, padding)


def padded_middle(shape: CellShape, padding: Column | float) -> PlaneRect:
    """What the padded bounds of all four children share: a strip about the middle lines, as their crossing."""
    c = F.col("shape")
    mid = lambda lo: cells.st_to_uv((lo + c["size"] / 2) / float(cells.SIZE))
    u, v = mid(c["i"]), mid(c["j"])
    return PlaneRect(Line(u - padding, u + padding), Line(v - padding, v + padding))


def entry_vertex(column: str = "shape") -> Vec:
    """Where the curve enters a cell: its lower left corner, or the opposite one if it is inverted."""
    c = F.col(column)
    far = F.when(c["orientation"].bitwiseAND(F.lit(2)) != 0, c["size"]).otherwise(0)
    return _corner(c, c["i"] + far, c["j"] + far)


def exit_vertex(column: str = "shape") -> Vec:
    """Where the curve leaves it: on the same side along i, or along j if the axes are swapped."""
    c = F.col(column)
    along = c["orientation"].isin(0, 3)  # neither swapped nor inverted, or both
    return _corner(c, c["i"] + F.when(along, c["size"]).otherwise(0), c["j"] + F.when(along, F.lit(0)).otherwise(c["size"]))


def _corner(c: Column, i: Column, j: Column) -> Vec:
    uv = lambda x: cells.st_to_uv(x / float(cells.SIZE))
    return cells.face_uv_to_xyz(c["face"], uv(i), uv(j)).normalized()


def shrink_to_fit(df: DataFrame, rect: PlaneRect, padding: float, column: str = "shape", out: str = "fit") -> DataFrame:
    """df with `out`: the smallest cell in the cell of `column` whose padded descendants hold all of a rectangle in (u, v) that meets it."""
    c = F.col(column)
    reach = rect.expanded(padding + 1.5 * 2.220446049250313e-16, padding + 1.5 * 2.220446049250313e-16)
    ij = lambda u: cells.st_to_ij(cells.uv_to_st(u))
    clip = lambda u, lo: F.greatest(lo, F.least(lo + c["size"] - 1, ij(u)))
    df = df.withColumns({"__ia": clip(reach.x.lo, c["i"]), "__ib": clip(reach.x.hi, c["i"]), "__ja": clip(reach.y.lo, c["j"]), "__jb": clip(reach.y.hi, c["j"])})
    differ = F.col("__ia").bitwiseXOR(F.col("__ib")).bitwiseOR(F.col("__ja").bitwiseXOR(F.col("__jb")))
    # the highest differing bit is that of the level below the common cell
    up = F.when(differ == 0, 0).otherwise(F.floor(F.log2(differ.cast("double"))) + 1)
    df = df.withColumns({"__face": c["face"], "__to": F.greatest(c["level"], F.lit(cells.MAX_LEVEL) - up).cast("bigint")})
    df = cells.encode_ij(df, "__face", "__ia", "__ja", "__leaf")
    return df.withColumn(out, cells.parent(F.col("__leaf"), F.col("__to"))).drop("__ia", "__ib", "__ja", "__jb", "__face", "__to", "__leaf")


def expanded_uv(shape: CellShape, radians: float) -> PlaneRect:
    """The (u, v) bounds moved out so that they hold, on this face, all points within an angle of the cell (a negative angle: in)."""

    def moved(at: Column, across: Line, outward: int) -> Column:
        # a line of constant u is the plane turned by atan(u); where it is seen most obliquely, at the largest |v|, an angle turns it most
        far = F.greatest(F.abs(across.lo), F.abs(across.hi))
        turn = F.asin(F.least(F.lit(1.0), math.sin(abs(radians)) * F.sqrt(1 + far * far / (1 + at * at))))
        return F.tan(F.atan(at) + outward * math.copysign(1, radians) * turn)

    return PlaneRect(Line(moved(shape.u.lo, shape.v, -1), moved(shape.u.hi, shape.v, 1)), Line(moved(shape.v.lo, shape.u, -1), moved(shape.v.hi, shape.u, 1)))
