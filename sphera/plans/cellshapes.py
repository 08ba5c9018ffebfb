"""Queries on cells as quadrilaterals, padded cells, plane rectangles, arcs, and distances of rectangles."""

import math

from pyspark.sql import functions as F

from sphera.functions import cells as c
from sphera.functions import cellshape as cs
from sphera.functions.intervals import Arc, Line
from sphera.functions.points import Vec
from sphera.functions.regions import Cap, PlaneRect, Rect
from sphera.operators.joins import spread
from sphera.plans import duck as d_
from sphera.plans.base import cell_points, d_encode, d_points, d_r6, points, query, r6

_LEVEL = 5


def shaped(spark, d, level=_LEVEL):
    """in_cells with the shape of `k`."""
    return cs.with_shape(in_cells(spark, d, level), "k")


def in_cells(spark, d, level=_LEVEL):
    """Customers with their leaf's ancestor `k`, and the next customer's point q."""
    df = cell_points(spark, d, "customer", "c_custkey")
    other = df.select((F.col("id") - 1).alias("id"), *[F.col(a).alias(f"q{a}") for a in "xyz"], F.col("cell").alias("qcell"))
    return spread(df.join(other, "id"), "id").withColumn("k", c.parent(F.col("cell"), level))


def _sql(level=_LEVEL) -> d_.Steps:
    """The same with vertices a, b, c, e, from the cell's i and j."""
    first = f"{d_points('p', 'customer', 'c_custkey')}, {d_encode('t', 'p')}, w AS (SELECT t.id, t.face, (t.i >> {30 - level}) << {30 - level} AS i0, (t.j >> {30 - level}) << {30 - level} AS j0, o.x AS q_x, o.y AS q_y, o.z AS q_z, o.face AS qface, o.i AS qi, o.j AS qj FROM t JOIN t o ON o.id = t.id + 1)"
    s = d_.Steps(first, "w")
    size = 1 << (30 - level)
    s.add(u0=d_.st_to_uv("(i0 / 1073741824e0)"), u1=d_.st_to_uv(f"((i0 + {size}) / 1073741824e0)"), v0=d_.st_to_uv("(j0 / 1073741824e0)"), v1=d_.st_to_uv(f"((j0 + {size}) / 1073741824e0)"))
    for name, u, v in (("a", "u0", "v0"), ("b", "u1", "v0"), ("c", "u1", "v1"), ("e", "u0", "v1"), ("m", "(u0+u1)/2", "(v0+v1)/2")):
        s.add(**{f"{name}_{x}": f"{e} / sqrt(1 + ({u})*({u}) + ({v})*({v}))" for x, e in zip("xyz", d_.face_xyz("face", u, v), strict=True)})
    return s


_AREAS = _sql().add(flat=f"0.5e0 * {d_.norm((' (c_y-a_y)*(e_z-b_z) - (c_z-a_z)*(e_y-b_y)', '(c_z-a_z)*(e_x-b_x) - (c_x-a_x)*(e_z-b_z)', '(c_x-a_x)*(e_y-b_y) - (c_y-a_y)*(e_x-b_x)'))}")


@query(
    "cell_areas",
    _AREAS.sql(
        f"SELECT id, {d_r6(d_.area('a', 'b', 'c') + ' * 1e6 + 1e6 * ' + d_.area('a', 'c', 'e'))} AS exact, {d_r6('1e6 * flat * 2 / (1 + sqrt(1 - flat / pi()))')} AS approx, {d_r6(f'1e6 * 4 * pi() / 6 / power(4, {_LEVEL})')} AS average, "
        f"{d_r6('a_x + b_x + c_x + e_x')} AS sx, {d_r6('a_y + b_y + c_y + e_y')} AS sy, {d_r6('a_z + b_z + c_z + e_z')} AS sz FROM _"
    ),
)
def cell_areas(spark, d):
    """Areas in millionths, and the sum of the vertices."""
    s = cs.CellShape.of()
    total = [sum((getattr(v, a) for v in s.vertices()[1:]), getattr(s.vertices()[0], a)) for a in "xyz"]
    return shaped(spark, d).select("id", r6(s.exact_area() * 1e6).alias("exact"), r6(s.approx_area() * 1e6).alias("approx"), r6(s.average_area() * 1e6).alias("average"), *[r6(t).alias(f"s{a}") for t, a in zip(total, "xyz", strict=True)])


def _edge_normals_sql():
    s = _sql()
    for k, (p, q) in enumerate(("ab", "bc", "ce", "ea")):
        s.add(**{f"n{k}_{x}": e for x, e in zip("xyz", d_.cross(p, q), strict=True)})
    return s


@query(
    "cell_edges",
    _edge_normals_sql().sql(
        "SELECT id, k::BIGINT AS k, " + ", ".join(d_r6(f"CASE k WHEN 0 THEN n0_{x} / {d_.norm(('n0_x', 'n0_y', 'n0_z'))} WHEN 1 THEN n1_{x} / {d_.norm(('n1_x', 'n1_y', 'n1_z'))} WHEN 2 THEN n2_{x} / {d_.norm(('n2_x', 'n2_y', 'n2_z'))} ELSE n3_{x} / {d_.norm(('n3_x', 'n3_y', 'n3_z'))} END") + f" AS {x}" for x in "xyz")
        + f", {d_r6('CASE k WHEN 0 THEN v0 WHEN 1 THEN u1 WHEN 2 THEN v1 ELSE u0 END')} AS uv, (CASE k WHEN 0 THEN j0 WHEN 1 THEN i0 + {1 << (30 - _LEVEL)} WHEN 2 THEN j0 + {1 << (30 - _LEVEL)} ELSE i0 END)::BIGINT AS ij FROM _, range(4) r(k)"
    ),
)
def cell_edges(spark, d):
    """Unit normals of the four edges, and the (u, v) and (i, j) coordinate that is constant along each."""
    s, col = cs.CellShape.of(), F.col("shape")
    ij = (col["j"], col["i"] + col["size"], col["j"] + col["size"], col["i"])
    rows = []
    for k in range(4):
        n = s.edge(k).normalized()
        rows.append(F.struct(F.lit(k).cast("bigint").alias("k"), *[r6(getattr(n, a)).alias(a) for a in "xyz"], r6(s.uv_of_edge(k)).alias("uv"), ij[k].alias("ij")))
    return shaped(spark, d).select("id", F.inline(F.array(*rows)))


def _distances_sql():
    s = _sql(2)
    for k, (p, q) in enumerate(("ab", "bc", "ce", "ea")):
        s.edge_distance(f"d{k}", "q", p, q)
    s.vector("z", ("-q_x", "-q_y", "-q_z"))
    for k, (p, q) in enumerate(("ab", "bc", "ce", "ea")):
        s.edge_distance(f"f{k}", "z", p, q)
    inside = lambda p: " AND ".join(f"{d_.triple(a, b, p)} >= 0" for a, b in ("ab", "bc", "ce", "ea"))
    s.add(near="least(d0, d1, d2, d3)", far=f"greatest({', '.join(d_.angle('q', v) for v in 'abce')})", held=inside("q"), back=f"CASE WHEN {inside('z')} THEN 0e0 ELSE least(f0, f1, f2, f3) END")
    return s


@query("cell_point_distance", _distances_sql().sql(f"SELECT id, held, {d_r6('CASE WHEN held THEN 0e0 ELSE near END')} AS distance, {d_r6('near')} AS boundary, {d_r6('CASE WHEN far <= pi() / 2 THEN far ELSE pi() - back END')} AS furthest, (CASE WHEN held THEN 0e0 ELSE near END) < 0.5e0 AS less, (CASE WHEN far <= pi() / 2 THEN far ELSE pi() - back END) < 2e0 AS max_less FROM _"))
def cell_point_distance(spark, d):
    """From the level-2 cell of each customer to the next customer."""
    s, q = cs.CellShape.of(), Vec.named("q")
    df = shaped(spark, d, 2)
    return df.select("id", s.contains_point(q).alias("held"), r6(s.distance(q)).alias("distance"), r6(s.boundary_distance(q)).alias("boundary"), r6(s.max_distance(q)).alias("furthest"), s.is_distance_less(q, 0.5).alias("less"), s.is_max_distance_less(q, 2.0).alias("max_less"))


def _cells_sql():
    """Level-3 cells of neighbours in number; the second with vertices f, g, h, l."""
    s = _sql(3)
    size = 1 << 27
    s.add(i2="(qi >> 27) << 27", j2="(qj >> 27) << 27").add(x0=d_.st_to_uv("(i2 / 1073741824e0)"), x1=d_.st_to_uv(f"((i2 + {size}) / 1073741824e0)"), y0=d_.st_to_uv("(j2 / 1073741824e0)"), y1=d_.st_to_uv(f"((j2 + {size}) / 1073741824e0)"))
    for name, u, v in (("f", "x0", "y0"), ("g", "x1", "y0"), ("h", "x1", "y1"), ("l", "x0", "y1")):
        s.add(**{f"{name}_{x}": f"{e} / sqrt(1 + ({u})*({u}) + ({v})*({v}))" for x, e in zip("xyz", d_.face_xyz("qface", u, v), strict=True)})
    names = []
    for v, sides in [(p, ("fg", "gh", "hl", "lf")) for p in "abce"] + [(p, ("ab", "bc", "ce", "ea")) for p in "fghl"]:
        for k, (p, q) in enumerate(sides):
            s.edge_distance(f"d{v}{k}", v, p, q)
            names.append(f"d{v}{k}")
    s.add(same="face = qface AND i0 = i2 AND j0 = j2", near=f"least({', '.join(names)})")
    return s


@query("cell_cell_distance", _cells_sql().sql(f"SELECT id, same AS meets, {d_r6('CASE WHEN same THEN 0e0 ELSE near END')} AS distance FROM _ WHERE id % 3 = 0"))
def cell_cell_distance(spark, d):
    """Between the level-3 cells of each third customer and of the next: vertices against edges."""
    df = cs.with_shape(shaped(spark, d, 3).where("id % 3 = 0").withColumn("k2", c.parent(F.col("qcell"), 3)), "k2", "other")
    one, two = cs.CellShape.of(), cs.CellShape.of("other")
    return df.select("id", one.may_intersect(two).alias("meets"), r6(one.distance_to_cell(two)).alias("distance"))


def _bounds_sql():
    s = _sql(3)
    lat = lambda v: f"atan2({v}_z, sqrt({v}_x*{v}_x + {v}_y*{v}_y))"
    highs, lows = [lat(v) for v in "abce"], [lat(v) for v in "abce"]
    for k, (p, q) in enumerate(("ab", "bc", "ce", "ea")):
        n = f"n{k}"
        s.cross(n, p, q)
        s.vector(f"t{k}", (f"-{n}_x*{n}_z", f"-{n}_y*{n}_z", f"{n}_x*{n}_x + {n}_y*{n}_y"))
        top = f"atan2(sqrt({n}_x*{n}_x + {n}_y*{n}_y), abs({n}_z))"
        a, b = d_.dot3(d_.cross(n, p), f"t{k}"), d_.dot3(d_.cross(n, q), f"t{k}")
        s.add(**{f"h{k}": f"CASE WHEN {a} > 0 AND {b} < 0 THEN {top} END", f"l{k}": f"CASE WHEN {a} < 0 AND {b} > 0 THEN -{top} END"})
        highs.append(f"h{k}")
        lows.append(f"l{k}")
    poles = [" AND ".join(f"{sign}*(n{k}_z) >= 0" for k in range(4)) for sign in ("1", "-1")]
    cap = f"greatest({', '.join(d_.chord2('m', v) for v in 'abce')})"
    s.add(hi=f"CASE WHEN {poles[0]} THEN pi()/2 ELSE list_max(list_filter([{', '.join(highs)}], lambda x: x IS NOT NULL)) END", lo=f"CASE WHEN {poles[1]} THEN -pi()/2 ELSE list_min(list_filter([{', '.join(lows)}], lambda x: x IS NOT NULL)) END", cap=cap)
    return s


@query("cell_bounds", _bounds_sql().sql(f"SELECT id, {d_r6('cap')} AS cap, {d_r6('lo')} AS lat_lo, {d_r6('hi')} AS lat_hi, true AS holds FROM _"))
def cell_bounds(spark, d):
    """Cap and latitudes that bound each level-3 cell; `holds`: its vertices and the customer are in both bounds."""
    s = cs.CellShape.of()
    df = shaped(spark, d, 3)
    rect, cap = s.rect_bound(), s.cap_bound()
    df = c.fenced(df, {"b": F.struct(rect.lat.lo.alias("a"), rect.lat.hi.alias("b"), rect.lng.lo.alias("c"), rect.lng.hi.alias("e"), cap.length2.alias("l"), cap.center.struct().alias("m"))})
    b = F.col("b")
    rect, cap = Rect(Line(b["a"] - 1e-12, b["b"] + 1e-12), Arc(b["c"], b["e"]).expanded(1e-12)), Cap(Vec.of("b.m"), b["l"] + 1e-12)
    holds = cap.contains_point(Vec.named()) & rect.contains_point(F.radians("lat"), F.radians("lng"))
    for v in s.vertices():
        holds = holds & cap.contains_point(v) & rect.contains_point(F.atan2(v.z, F.hypot(v.x, v.y)), F.atan2(v.y, v.x))
    return df.select("id", r6(b["l"]).alias("cap"), r6(b["a"]).alias("lat_lo"), r6(b["b"]).alias("lat_hi"), holds.alias("holds"))


@query(
    "padded_cells",
    _sql(6).add(size=str(1 << 24)).sql(
        f"SELECT id, {d_r6('u0 - 0.01e0')} AS u_lo, {d_r6('v1 + 0.01e0')} AS v_hi, {d_r6(d_.st_to_uv('((i0 + size / 2) / 1073741824e0)') + ' - 0.01e0')} AS mid_lo FROM _"
    ),
)
def padded_cells(spark, d):
    s = cs.CellShape.of()
    df = shaped(spark, d, 6)
    return df.select("id", r6(cs.padded_bound(s, 0.01).x.lo).alias("u_lo"), r6(cs.padded_bound(s, 0.01).y.hi).alias("v_hi"), r6(cs.padded_middle(s, 0.01).x.lo).alias("mid_lo"))


@query(
    "curve_ends",
    # the curve goes on from a cell's exit to the entry of the next one, and the entry is a corner of the first leaf's cell
    f"WITH {d_points('p', 'customer', 'c_custkey')}, {d_encode('t', 'p')} SELECT DISTINCT ((cell & (-{1 << 52})) | {1 << 52}) AS k, true AS meets, true AS first, true AS last FROM t",
)
def curve_ends(spark, d):
    """Of each level-4 cell: whether its exit is the next cell's entry, and whether its own entry and exit are corners of its first and last descendant."""
    df = cell_points(spark, d, "customer", "c_custkey").select(c.parent(F.col("cell"), 4).alias("k")).distinct()
    df = df.withColumns({"n": c.next_wrap(F.col("k")), "f": c.parent(c.range_min(F.col("k")), 12), "l": c.parent(c.range_max(F.col("k")), 12)})
    for name, cell in (("shape", "k"), ("after", "n"), ("first", "f"), ("last", "l")):
        df = cs.with_shape(df, cell, name)
    gap = lambda a, b: F.abs(a.x - b.x) + F.abs(a.y - b.y) + F.abs(a.z - b.z) < 1e-12
    return df.select("k", gap(cs.exit_vertex(), cs.entry_vertex("after")).alias("meets"), gap(cs.entry_vertex(), cs.entry_vertex("first")).alias("first"), gap(cs.exit_vertex(), cs.exit_vertex("last")).alias("last"))


@query("shrink_to_fit", f"WITH {d_points('p', 'customer', 'c_custkey')}, {d_encode('t', 'p')} SELECT id, ((cell & (-{1 << 32})) | {1 << 32}) AS fit FROM t")
def shrink_to_fit(spark, d):
    """The smallest cell that holds the middle half of the customer's level-14 cell is that cell, also when asked of its level-2 ancestor."""
    df = cell_points(spark, d, "customer", "c_custkey").withColumns({"k14": c.parent(F.col("cell"), 14), "k2": c.parent(F.col("cell"), 2)})
    df = cs.with_shape(cs.with_shape(df, "k14", "inner"), "k2")
    inner = cs.CellShape.of("inner")
    part = lambda line: Line(line.lo + 0.25 * line.length(), line.hi - 0.25 * line.length())
    return cs.shrink_to_fit(df, PlaneRect(part(inner.u), part(inner.v)), 0.0).select("id", "fit")


@query(
    "expanded_uv",
    _sql(4).sql("SELECT id, " + ", ".join(
        d_r6(f"tan(atan({at}) + ({way}) * asin(least(1e0, sin(0.01e0) * sqrt((1 + {at}*{at} + m*m) / (1 + {at}*{at})))))") + f" AS {name}" for name, at, way in (("u_lo", "u0", -1), ("u_hi", "u1", 1))
    ) + " FROM (SELECT *, greatest(abs(v0), abs(v1)) AS m FROM _)"),
)
def expanded_uv(spark, d):
    r = cs.expanded_uv(cs.CellShape.of(), 0.01)
    return shaped(spark, d, 4).select("id", r6(r.x.lo).alias("u_lo"), r6(r.x.hi).alias("u_hi"))


#: The axes of the faces and the faces along them, as (face, axis, x, y, z, ahead, behind).
_AXIS_ROWS = [(0, "u", 0, 1, 0, 1, 4), (0, "v", 0, 0, 1, 2, 5), (0, "w", 1, 0, 0, 0, 3), (1, "u", -1, 0, 0, 3, 0), (1, "v", 0, 0, 1, 2, 5), (1, "w", 0, 1, 0, 1, 4), (2, "u", -1, 0, 0, 3, 0), (2, "v", 0, -1, 0, 4, 1), (2, "w", 0, 0, 1, 2, 5),
              (3, "u", 0, 0, -1, 5, 2), (3, "v", 0, -1, 0, 4, 1), (3, "w", -1, 0, 0, 3, 0), (4, "u", 0, 0, -1, 5, 2), (4, "v", 1, 0, 0, 0, 3), (4, "w", 0, -1, 0, 4, 1), (5, "u", 0, 1, 0, 1, 4), (5, "v", 1, 0, 0, 0, 3), (5, "w", 0, 0, -1, 5, 2)]


@query("face_axes", "SELECT * FROM (VALUES " + ", ".join(f"({f}, '{a}', {x}e0, {y}e0, {z}e0, {n}, {b})" for f, a, x, y, z, n, b in _AXIS_ROWS) + ") t(face, axis, x, y, z, ahead, behind)")
def face_axes(spark, d):
    """The axes of all faces, and the faces that lie ahead and behind."""
    df = spark.range(6).select(F.col("id").cast("int").alias("face"))
    rows = [F.struct(F.lit("uvw"[a]).alias("axis"), *[getattr(cs.uvw_axis(F.col("face"), a), x).alias(x) for x in "xyz"], cs.uvw_face(F.col("face"), a, 1).alias("ahead"), cs.uvw_face(F.col("face"), a, 0).alias("behind")) for a in range(3)]
    return df.select("face", F.inline(F.array(*rows)))


@query("uvw_coordinates", f"WITH {d_points('p', 'customer', 'c_custkey')}, {d_encode('t', 'p')} SELECT id, {d_r6('greatest(abs(x), abs(y), abs(z))')} AS w, {d_r6('u * greatest(abs(x), abs(y), abs(z))')} AS u, {d_r6('v * greatest(abs(x), abs(y), abs(z))')} AS v FROM t")
def uvw_coordinates(spark, d):
    df = points(spark, d, "customer", "c_custkey")
    q = cs.xyz_to_uvw(c.face_of(Vec.named()), Vec.named())
    return df.select("id", r6(q.z).alias("w"), r6(q.x).alias("u"), r6(q.y).alias("v"))


# --- arcs, in whole degrees so that the oracle can count ------------------------------------------

_A = "a AS (SELECT c_custkey::BIGINT AS id, (c_custkey * 37) % 360 AS s, 2 * ((c_custkey * 53) % 170) + 1 AS n, (c_custkey * 101) % 360 AS t, 2 * ((c_custkey * 29) % 85) AS m FROM customer), o AS (SELECT *, (t - s + 720) % 360 AS ot, (t + m - s + 720) % 360 AS ou FROM a)"
_WRAP = lambda e: f"(CASE WHEN ({e}) % 360 > 180 THEN ({e}) % 360 - 360 ELSE ({e}) % 360 END)"
_IN = "ot <= n", "ou <= n"
_HELD = "(ot <= ou AND ou <= n)"
_HOLDS = "((s - t + 720) % 360 <= (s + n - t + 720) % 360 AND (s + n - t + 720) % 360 <= m)"


def _arcs(spark, d):
    k = F.col("c_custkey")
    df = spark.read.parquet(f"{d}/customer.parquet").select(k.cast("bigint").alias("id"), ((k * 37) % 360).alias("s"), (2 * ((k * 53) % 170) + 1).alias("n"), ((k * 101) % 360).alias("t"), (2 * ((k * 29) % 85)).alias("m"))
    wrap = lambda e: F.radians(F.when(e % 360 > 180, e % 360 - 360).otherwise(e % 360).cast("double"))
    return df.withColumns({"alo": wrap(F.col("s")), "ahi": wrap(F.col("s") + F.col("n")), "blo": wrap(F.col("t")), "bhi": wrap(F.col("t") + F.col("m"))})


def _deg(x):
    """Whole degrees of an end, -180 as 180."""
    return F.when(F.round(F.degrees(x), 3) == -180.0, 180.0).otherwise(F.round(F.degrees(x), 3)) + F.lit(0.0)


@query(
    "arc_algebra",
    f"WITH {_A} SELECT id, {_HELD} AS contains, (ot <= n OR (s - t + 720) % 360 <= m) AS intersects, "
    + ", ".join(f"({_WRAP('mod(' + e + ' + 720, 360)')})::DOUBLE AS {name}" for name, e in (
        ("union_lo", f"CASE WHEN {_HELD} THEN s WHEN {_HOLDS} THEN t WHEN {_IN[0]} AND {_IN[1]} THEN 180 WHEN {_IN[0]} THEN s WHEN {_IN[1]} THEN t WHEN (s - t - m + 1080) % 360 < (t - s - n + 1080) % 360 THEN t ELSE s END"),
        ("union_hi", f"CASE WHEN {_HELD} THEN s + n WHEN {_HOLDS} THEN t + m WHEN {_IN[0]} AND {_IN[1]} THEN 180 WHEN {_IN[0]} THEN t + m WHEN {_IN[1]} THEN s + n WHEN (s - t - m + 1080) % 360 < (t - s - n + 1080) % 360 THEN s + n ELSE t + m END"),
        ("both_lo", f"CASE WHEN {_HELD} THEN t WHEN {_HOLDS} THEN s WHEN {_IN[0]} AND {_IN[1]} THEN CASE WHEN m < n THEN t ELSE s END WHEN {_IN[0]} THEN t WHEN {_IN[1]} THEN s ELSE 180 END"),
        ("both_hi", f"CASE WHEN {_HELD} THEN t + m WHEN {_HOLDS} THEN s + n WHEN {_IN[0]} AND {_IN[1]} THEN CASE WHEN m < n THEN t + m ELSE s + n END WHEN {_IN[0]} THEN s + n WHEN {_IN[1]} THEN t + m ELSE 180 END"),
        ("wider_lo", "CASE WHEN n + 20 >= 360 THEN 180 ELSE s - 10 END"), ("wider_hi", "CASE WHEN n + 20 >= 360 THEN 180 ELSE s + n + 10 END"),
    )) + " FROM o",
)
def arc_algebra(spark, d):
    """Ends in degrees; an empty or full result has both ends at 180."""
    a, b = Arc(F.col("alo"), F.col("ahi")), Arc(F.col("blo"), F.col("bhi"))
    u, i, w = a.union(b), a.intersection(b), a.expanded(math.radians(10))
    return _arcs(spark, d).select("id", a.contains(b).alias("contains"), a.intersects(b).alias("intersects"), _deg(u.lo).alias("union_lo"), _deg(u.hi).alias("union_hi"), _deg(i.lo).alias("both_lo"), _deg(i.hi).alias("both_hi"), _deg(w.lo).alias("wider_lo"), _deg(w.hi).alias("wider_hi"))


@query(
    "arc_pair",
    f"WITH {_A} SELECT id, ({_WRAP('CASE WHEN (t - s + 360) % 360 <= 180 THEN s ELSE t END')})::DOUBLE AS lo, ({_WRAP('CASE WHEN (t - s + 360) % 360 <= 180 THEN t ELSE s END')})::DOUBLE AS hi FROM o",
)
def arc_pair(spark, d):
    """The shorter way from one point to another."""
    a = Arc.from_pair(F.col("alo"), F.col("blo"))
    return _arcs(spark, d).select("id", _deg(a.lo).alias("lo"), _deg(a.hi).alias("hi"))


@query(
    "arc_hausdorff",
    f"WITH {_A}, deg AS (SELECT id, max(least(CASE WHEN (s + x - t + 720) % 360 <= m THEN 0 ELSE least((s + x - t - m + 1080) % 360, (t - s - x + 1080) % 360) END, 180)) AS h FROM o, range(361) r(x) WHERE x <= n GROUP BY id) SELECT id, h::DOUBLE AS degrees FROM deg",
)
def arc_hausdorff(spark, d):
    """How far from the second arc the first one reaches, in degrees (the furthest point is a whole degree)."""
    a, b = Arc(F.col("alo"), F.col("ahi")), Arc(F.col("blo"), F.col("bhi"))
    return _arcs(spark, d).select("id", (F.round(F.degrees(a.directed_hausdorff(b)), 3) + F.lit(0.0)).alias("degrees"))


# --- plane rectangles ------------------------------------------------------------------------------

_R = "r AS (SELECT p_partkey::BIGINT AS id, (p_partkey * 7) % 50 AS x, (p_partkey * 11) % 40 AS y, 1 + p_partkey % 9 AS w, 1 + p_partkey % 13 AS h, (p_partkey * 17) % 50 AS x2, (p_partkey * 23) % 40 AS y2 FROM part), q AS (SELECT *, x - w / 2e0 AS a, x + w / 2e0 AS b, y - h / 2e0 AS c, y + h / 2e0 AS e, x2 - 4e0 AS a2, x2 + 4e0 AS b2, y2 - 3e0 AS c2, y2 + 3e0 AS e2 FROM r)"


@query(
    "plane_rects",
    f"WITH {_R}, m AS (SELECT *, greatest(a, a2) AS ia, least(b, b2) AS ib, greatest(c, c2) AS ic, least(e, e2) AS ie FROM q) SELECT id, (x2 BETWEEN a AND b AND y2 BETWEEN c AND e) AS holds, (a2 <= b AND a <= b2 AND c2 <= e AND c <= e2) AS meets, (a2 >= a AND b2 <= b AND c2 >= c AND e2 <= e) AS contains, "
    "least(a, a2) AS union_x, greatest(e, e2) AS union_y, CASE WHEN ia <= ib AND ic <= ie THEN ia ELSE 1e0 END AS both_x, CASE WHEN ia <= ib AND ic <= ie THEN ie ELSE 0e0 END AS both_y, least(a, x2) AS added, greatest(a, least(b, x2::DOUBLE)) AS px, greatest(c, least(e, y2::DOUBLE)) AS py, "
    "a - 0.5e0 AS wider, CASE WHEN h >= 4 AND w >= 2 THEN c + 2 ELSE 1e0 END AS narrower, b AS vx, e AS vy FROM m",
)
def plane_rects(spark, d):
    k = F.col("p_partkey")
    df = spark.read.parquet(f"{d}/part.parquet").select(k.cast("bigint").alias("id"), ((k * 7) % 50).alias("x"), ((k * 11) % 40).alias("y"), (1 + k % 9).alias("w"), (1 + k % 13).alias("h"), ((k * 17) % 50).cast("double").alias("x2"), ((k * 23) % 40).cast("double").alias("y2"))
    one, two = PlaneRect.from_center_size(F.col("x"), F.col("y"), F.col("w"), F.col("h")), PlaneRect.from_point_pair(F.col("x2") + 4, F.col("y2") - 3, F.col("x2") - 4, F.col("y2") + 3)
    u, i, (px, py), (vx, vy) = one.union(two), one.intersection(two), one.project(F.col("x2"), F.col("y2")), one.vertex(2)
    return df.select("id", one.contains_point(F.col("x2"), F.col("y2")).alias("holds"), one.intersects(two).alias("meets"), one.contains(two).alias("contains"), u.x.lo.alias("union_x"), u.y.hi.alias("union_y"), i.x.lo.alias("both_x"), i.y.hi.alias("both_y"),
                     one.add_point(F.col("x2"), F.col("y2")).x.lo.alias("added"), px.alias("px"), py.alias("py"), one.expanded(0.5, 0.5).x.lo.alias("wider"), one.expanded(-1, -2).y.lo.alias("narrower"), vx.alias("vx"), vy.alias("vy"))
