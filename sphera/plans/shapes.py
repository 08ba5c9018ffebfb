"""Queries on loops, polygons, coverings, hulls, buffers, alignment and streams' batch form."""

import math
import re

import pandas as pd
from pyspark.sql import functions as F

from sphera.functions import cells as c
from sphera.functions import points as p
from sphera.functions.points import Vec
from sphera.operators import cover, shapes
from sphera.operators import edge_tables as et
from sphera.operators.joins import spread
from sphera.plans import duck as d_
from sphera.plans.base import cell_points, d_encode, d_parent, d_points, d_r6, points, query, r6, table
from sphera.plans.scalars import caps
from sphera.plans.spatial import _DOTS, _N, _TRIPLE, triangles

_S = d_points("p", "supplier", "s_suppkey")
_REGULAR = f"WITH {_S}, k AS (SELECT id, (100 + 50 * (id % 20)) / 6371.01e0 AS r, 3 + id % 30 AS n FROM p), g AS (SELECT *, atan(1 / (tan(pi() / n) * cos(r))) AS h FROM k)"


def _triangles_sql(rest: str) -> str:
    """With the triangles of the nations in front; names as in the oracle's dialect (`by` is a keyword)."""
    return re.sub(r"\b([a-dnpq])([xyz])\b", r"\1_\2", f"WITH {_N}, {rest}")


def regular_loops(spark, d):
    """Edge table of a regular loop of n vertices about each supplier, at its cap's radius."""
    z = Vec.named()
    df = caps(spark, d).withColumn("n", F.lit(3) + F.col("id") % 30)
    df = c.fenced(df, {f"a{k}": axis.struct() for k, axis in enumerate(p.frame(z)[:2])})

    def vertex(i):
        t = 2 * math.pi * i / F.col("n")
        v = p.from_frame((Vec.of("a0"), Vec.of("a1"), z), Vec(F.sin("r") * F.cos(t), F.sin("r") * F.sin(t), F.cos("r")))
        return v.struct()

    loops = df.withColumn("vertices", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), vertex))
    return et.of_loops(loops.select(F.col("id").alias("shape"), F.lit(0).alias("chain"), "vertices"))


@query("loop_area", f"{_REGULAR} SELECT id, {d_r6('n * 2 * h - (n - 2) * pi()')} AS area, {d_r6('2 * pi() - (n * 2 * h - (n - 2) * pi())')} AS curvature FROM g")
def loop_area(spark, d):
    t = regular_loops(spark, d)
    both = et.chain_areas(t).join(et.curvatures(t), ["shape", "chain"])
    return both.select(F.col("shape").alias("id"), r6(F.col("area")).alias("area"), r6(F.col("curvature")).alias("curvature"))


@query("loop_perimeter", f"{_REGULAR} SELECT id, {d_r6('n * 2 * asin(sin(r) * sin(pi() / n))')} AS perimeter FROM g")
def loop_perimeter(spark, d):
    return et.lengths(regular_loops(spark, d)).select(F.col("shape").alias("id"), r6(F.col("length")).alias("perimeter"))


@query("loop_contains", f"{_REGULAR} SELECT id, (id % 9 + 1) * 0.19e0 < 1 AS inside, 0 AS antipode FROM g")
def loop_contains(spark, d):
    """A point from each loop's middle towards its first vertex and partly beyond, by how often the loop winds round it; it winds round no antipode of a point far outside."""
    t = regular_loops(spark, d)
    far = ((F.col("id") % 9 + 1) * 0.19).alias("f")
    first = t.where("edge = 0").select(F.col("shape").alias("id"), *[F.col(f"a{a}").alias(f"v{a}") for a in "xyz"])
    df = caps(spark, d).select("id", "x", "y", "z", far).join(first, "id")
    at = p.interpolate(Vec.named(), Vec.named("v"), F.col("f"))
    df = c.fenced(df, {"m": at.struct()}).select(F.col("id").alias("shape"), "m")
    seen = df.join(t, "shape")
    m = Vec.of("m")
    side = Vec(m.y, m.z, m.x)  # somewhere else, far off
    turns = lambda q: F.rint(F.sum(F.atan2(q.dot(q.cross(et.a_end()).cross(q.cross(et.b_end()))), q.cross(et.a_end()).dot(q.cross(et.b_end())))) / (2 * math.pi)).cast("int")
    found = seen.groupBy("shape").agg(turns(m).alias("n"), turns(m.cross(side).normalized()).alias("o"))
    return found.select(F.col("shape").alias("id"), (F.col("n") > 0).alias("inside"), F.col("o").alias("antipode"))


@query("buffer_point", f"WITH {_S}, k AS (SELECT id, (100 + 50 * (id % 20)) / 6371.01e0 AS r, ceil(pi() / acos(0.99e0)) AS n FROM p), g AS (SELECT *, atan(1 / (tan(pi() / n) * cos(r))) AS h FROM k) SELECT id, {d_r6('n * 2 * h - (n - 2) * pi()')} AS area FROM g")
def buffer_point(spark, d):
    area = shapes.apply(lambda x, y, z, r: shapes.area(shapes.buffer_point((x, y, z), r)), "double", F.col("x"), F.col("y"), F.col("z"), F.col("r"))
    return spread(caps(spark, d), "id").select("id", r6(area).alias("area"))


@query("buffer_chain")
def buffer_chain(spark, d):
    """Area of the first three points of each nation's triangle, buffered by 200 km."""
    run = shapes.apply(lambda *v: shapes.polygon_area(shapes.buffer_chain([tuple(v[i : i + 3]) for i in (0, 3, 6)], 200 / 6371.01)), "double", *[F.col(f"{p}{a}") for p in "abc" for a in "xyz"])
    return triangles(spark, d).select("id", r6(run).alias("area"))


def _moved(v):
    """The triangle and itself turned a little about the axis."""
    tri = [tuple(v[i : i + 3]) for i in (0, 3, 6)]
    s, k = math.sin(0.05), math.cos(0.05)
    return tri, [(x * k - y * s, x * s + y * k, z) for x, y, z in tri]


_AREA3 = f"abs(2 * atan2({_TRIPLE}, {_DOTS}))"
_OVER = _triangles_sql(f"o AS (SELECT id, {_AREA3} AS a FROM xyz) SELECT id, {d_r6('1000 * 2 * a')} AS total, {d_r6('1000 * a')} AS own, {d_r6('0 * a')} AS rest FROM o")


@query("polygon_overlay", _OVER)
def polygon_overlay(spark, d):
    """Of each triangle and its turned copy, in thousandths: union and intersection together, intersection and difference together, what a shape less itself leaves."""

    def run(*v):
        a, b = _moved(v)
        size = {how: shapes.polygon_area(shapes.overlay([a], [b], how)) for how in ("union", "intersection", "difference")}
        return [1000 * (size["union"] + size["intersection"]), 1000 * (size["intersection"] + size["difference"]), shapes.polygon_area(shapes.overlay([a], [a], "difference"))]

    v = F.col("v")
    df = triangles(spark, d).withColumn("v", shapes.apply(run, "array<double>", *[F.col(f"{q}{a}") for q in "abc" for a in "xyz"]))
    return df.select("id", r6(v[0]).alias("total"), r6(v[1]).alias("own"), r6(v[2]).alias("rest"))


@query("polygon_intersection")
def polygon_intersection(spark, d):
    """Vertices and area of what each triangle and its turned copy share."""
    v = [F.col(f"{p}{a}") for p in "abc" for a in "xyz"]
    both = shapes.apply(lambda *x: [[list(p) for p in loop] for loop in shapes.overlay([_moved(x)[0]], [_moved(x)[1]], "intersection")], shapes.POLYGON, *v)
    df = triangles(spark, d).withColumn("polygon", both)
    return df.select("id", F.size("polygon").alias("loops"), r6(shapes.apply(shapes.polygon_area, "double", F.col("polygon"))).alias("area"))


_HULL = d_.Steps(f"{d_points('cp', 'customer', 'c_custkey')}, {d_encode('e', 'cp')}, k AS (SELECT id, {d_parent('cell', 1)} AS cell, x, y, z FROM e), n AS (SELECT cell, count(*) AS n FROM k GROUP BY cell), pq AS (SELECT a.cell, a.id AS i, b.id AS j, a.x AS a_x, a.y AS a_y, a.z AS a_z, b.x AS b_x, b.y AS b_y, b.z AS b_z FROM k a JOIN k b ON a.cell = b.cell AND a.id <> b.id), "
                f"he AS (SELECT * FROM pq WHERE NOT EXISTS (SELECT 1 FROM (SELECT cell, x AS c_x, y AS c_y, z AS c_z FROM k) r WHERE r.cell = pq.cell AND {d_.triple('a', 'b', 'c')} < -1e-15)), o AS (SELECT cell, arg_min(a_x, i) AS o_x, arg_min(a_y, i) AS o_y, arg_min(a_z, i) AS o_z FROM he GROUP BY cell), h AS (SELECT he.*, o_x, o_y, o_z FROM he JOIN o USING (cell))", "h")  # fmt: skip


@query("convex_hull", _HULL.sql(f"SELECT n.cell, (CASE WHEN n < 3 THEN n ELSE coalesce(m, 0) END)::BIGINT AS vertices, {d_r6('CASE WHEN n < 3 THEN 0e0 ELSE s END')} AS area FROM n LEFT JOIN (SELECT cell, count(*) AS m, sum({d_.area('o', 'a', 'b')}) AS s FROM _ GROUP BY cell) x ON x.cell = n.cell"))
def convex_hull(spark, d):
    """Vertices and area of the hull of the customers of each level-1 cell: of salted parts first, then of those hulls' vertices."""
    df = cell_points(spark, d, "customer", "c_custkey").select(c.parent(F.col("cell"), 1).alias("cell"), (F.col("id") % 16).alias("salt"), "x", "y", "z")

    def part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ring = shapes.hull(list(zip(pdf.x, pdf.y, pdf.z, strict=True)))
        return pd.DataFrame({"cell": key[0], "x": [p[0] for p in ring], "y": [p[1] for p in ring], "z": [p[2] for p in ring]})

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ring = shapes.hull(list(zip(pdf.x, pdf.y, pdf.z, strict=True)))
        return pd.DataFrame({"cell": [key[0]], "vertices": [len(ring)], "area": [shapes.area(ring) if len(ring) > 2 else 0.0]})

    parts = df.groupBy("cell", "salt").applyInPandas(part, "cell long, x double, y double, z double")
    return parts.groupBy("cell").applyInPandas(whole, "cell long, vertices long, area double").select("cell", "vertices", r6(F.col("area")).alias("area"))


def _tracks(spark, d):
    df = spread(points(spark, d, "events", "event_id", "user_id", "ts"), "user_id")
    track = F.array_sort(F.collect_list(F.struct("ts", "id", F.array("x", "y", "z").alias("p"))))
    return df.groupBy("user_id").agg(F.transform(track, lambda s: s["p"]).alias("track"))


_TRACK = f"{d_points('ep', 'events', 'event_id', 'user_id', 'ts')}, tr AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) - 1 AS i, x, y, z FROM ep), tn AS (SELECT u, count(*) AS n FROM tr GROUP BY u)"
#: No hop goes over more than ten events; a longer one would show as a difference.
_SKIP = d_.Steps(f"{_TRACK}, w AS (SELECT a.u, a.i AS s, b.i AS e, m.i AS m, a.x AS a_x, a.y AS a_y, a.z AS a_z, b.x AS b_x, b.y AS b_y, b.z AS b_z, m.x AS p_x, m.y AS p_y, m.z AS p_z FROM tr a JOIN tr b ON b.u = a.u AND b.i BETWEEN a.i + 2 AND a.i + 10 JOIN tr m ON m.u = a.u AND m.i > a.i AND m.i < b.i)", "w").edge_distance("far", "p", "a", "b")


@query(
    "simplify",
    _SKIP.sql(
        f"SELECT 1 FROM _").replace("WITH ", "WITH RECURSIVE ", 1).rsplit(" SELECT 1 FROM ", 1)[0]
    + f", bad AS (SELECT u, s, min(e) AS e FROM {_SKIP.name} WHERE far > 0.2e0 OR {d_.angle('a', 'b')} >= pi() / 2 GROUP BY u, s), hop AS (SELECT tr.u, tr.i AS s, coalesce(bad.e - 1, n - 1) AS e FROM tr JOIN tn ON tn.u = tr.u LEFT JOIN bad ON bad.u = tr.u AND bad.s = tr.i), "
    "walk(u, i) AS (SELECT u, 0::BIGINT FROM tn UNION ALL SELECT hop.u, hop.e::BIGINT FROM walk JOIN hop ON hop.u = walk.u AND hop.s = walk.i JOIN tn ON tn.u = hop.u WHERE walk.i < tn.n - 1) "
    "SELECT walk.u AS user_id, max(tn.n)::INTEGER AS n, list(walk.i ORDER BY walk.i) AS kept FROM walk JOIN tn ON tn.u = walk.u GROUP BY walk.u",
)
def simplify(spark, d):
    """Vertices kept of each user's track at a tolerance of 0.2 radians."""
    kept = shapes.apply(lambda t: shapes.simplify(t, 0.2), "array<int>", F.col("track"))
    return _tracks(spark, d).select("user_id", F.size("track").alias("n"), kept.alias("kept"))


@query(
    "dtw_cost",
    f"WITH RECURSIVE {_TRACK}, pr AS (SELECT a.u, a.i, b.i AS j, power(a.x-b.x, 2) + power(a.y-b.y, 2) + power(a.z-b.z, 2) AS d FROM tr a JOIN tr b ON b.u = a.u + 1), pre AS (SELECT *, sum(d) OVER (PARTITION BY u, i ORDER BY j) AS p FROM pr), "
    "dp(u, i, j, c) AS (SELECT u, i, j, p FROM pre WHERE i = 0 UNION ALL SELECT u, i, j, p + min(m - p) OVER (PARTITION BY u ORDER BY j) FROM (SELECT s.u, s.i, s.j, s.p, s.d + least(o.c, coalesce(o.before, o.c)) AS m FROM (SELECT *, lag(c) OVER (PARTITION BY u ORDER BY j) AS before FROM dp) o JOIN pre s ON s.u = o.u AND s.i = o.i + 1 AND s.j = o.j) x) "
    f"SELECT u AS user_id, {d_r6('arg_max(c, i * 1000000 + j)')} AS cost FROM dp GROUP BY u",
)
def dtw_cost(spark, d):
    """Alignment of each user's track with the next user's."""
    df = _tracks(spark, d)
    other = df.select((F.col("user_id") - 1).alias("user_id"), F.col("track").alias("other"))
    return df.join(other, "user_id").select("user_id", r6(shapes.apply(lambda a, b: shapes.align_cost(a, b), "double", F.col("track"), F.col("other"))).alias("cost"))


@query("cover_cap")
def cover_cap(spark, d):
    """Coverings of the suppliers' caps by at most 8 cells."""
    df = spread(caps(spark, d), "id")
    ids = cover.cover_caps(F.col("x"), F.col("y"), F.col("z"), F.col("r"), max_cells=8)
    return df.select("id", F.posexplode(ids).alias("k", "cell"))


@query("interior_cover")
def interior_cover(spark, d):
    df = spread(caps(spark, d), "id")
    ids = cover.cover_caps(F.col("x"), F.col("y"), F.col("z"), F.col("r"), max_cells=8, max_level=8, interior=True)
    return df.select("id", F.posexplode_outer(ids).alias("k", "cell"))


@query("cover_recall", f"WITH {d_points('cp', 'customer', 'c_custkey')}, {_S} SELECT p.id AS cap, count(*)::BIGINT AS n FROM cp c JOIN p ON power(c.x - p.x, 2) + power(c.y - p.y, 2) + power(c.z - p.z, 2) <= power(2 * sin((100 + 50 * (p.id % 20)) / 6371.01e0 / 2), 2) GROUP BY p.id")
def cover_recall(spark, d):
    """Customers in each cap, by its covering and the exact test."""
    from sphera.functions.regions import Cap
    from sphera.operators.joins import cover_join

    df = spread(caps(spark, d), "id")
    held = df.select(F.col("id").alias("cap"), "r", *[F.col(a).alias(f"q_{a}") for a in "xyz"], F.explode(cover.cover_caps(F.col("x"), F.col("y"), F.col("z"), F.col("r"), max_cells=8)).alias("cover"))
    pts = cell_points(spark, d, "customer", "c_custkey").select(F.col("id").alias("customer"), F.col("cell").alias("leaf"), *[F.col(a).alias(f"t_{a}") for a in "xyz"])
    inside = Cap.from_angle(Vec.named("q_"), F.col("r")).contains_point(Vec.named("t_"))
    return cover_join(pts, held, "leaf", "cover", ["cap"], inside).groupBy("cap").agg(F.count("*").alias("n"))


@query("event_cells", f"WITH {d_points('p', 'events', 'event_id', 'ts')}, {d_encode('e', 'p')} SELECT strftime(ts, '%Y-%m-%d') AS start, {d_parent('cell', 2)} AS cell, count(*)::BIGINT AS n FROM e GROUP BY 1, 2")
def event_cells(spark, d):
    """The batch form of streaming.tracks.counts."""
    from sphera.streaming.tracks import counts

    return counts(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "cell", "n")


_EDGE = "ed AS (SELECT id * 3 + k AS id, " + ", ".join(f"CASE k WHEN 0 THEN {p}{a} WHEN 1 THEN {q}{a} ELSE {r}{a} END AS {n}{a}" for n, (p, q, r) in (("p", "abc"), ("q", "bca")) for a in "xyz") + " FROM xyz, range(3) s(k))"
_NEAR = "CASE WHEN (ny*pz-nz*py)*x + (nz*px-nx*pz)*y + (nx*py-ny*px)*z > 0 AND (ny*qz-nz*qy)*x + (nz*qx-nx*qz)*y + (nx*qy-ny*qx)*z < 0 THEN asin(least(1e0, abs(nx*x + ny*y + nz*z) / sqrt(nx*nx + ny*ny + nz*nz))) ELSE 2 * asin(sqrt(least(power(px-x, 2) + power(py-y, 2) + power(pz-z, 2), power(qx-x, 2) + power(qy-y, 2) + power(qz-z, 2))) / 2) END"


def triangle_edges(spark, d):
    """t_id, t_ax.., t_bx..: the three edges of each triangle."""
    each = F.array(*[F.struct((F.col("id") * 3 + k).alias("t_id"), *[F.col(f"{p}{a}").alias(f"t_a{a}") for a in "xyz"], *[F.col(f"{q}{a}").alias(f"t_b{a}") for a in "xyz"]) for k, (p, q) in enumerate(("ab", "bc", "ca"))])
    return triangles(spark, d).select(F.inline_outer(each))


@query(
    "closest_edge",
    _triangles_sql(f"{_EDGE}, n AS (SELECT *, py*qz-pz*qy AS nx, pz*qx-px*qz AS ny, px*qy-py*qx AS nz FROM ed), {d_points('cp', 'customer', 'c_custkey')}, g AS (SELECT cp.id AS customer, n.id AS edge, {_NEAR} AS distance FROM cp, n), r AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY distance, edge) AS rank FROM g) SELECT customer, {d_r6('distance')} AS distance FROM r WHERE rank = 1"),
)
def closest_edge(spark, d):
    """Distance of each customer to the nearest of the triangles' edges (two edges may share the nearest vertex)."""
    from sphera.operators import nearest

    edges = nearest.with_middles(triangle_edges(spark, d))
    q = cell_points(spark, d, "customer", "c_custkey").select(*[F.col(a).alias(f"q_{a}") for a in ("id", "x", "y", "z", "cell")])
    found = nearest.closest_edges(q, edges, 1, math.radians(12), 0.2)
    return found.select(F.col("q_id").alias("customer"), r6(F.col("distance")).alias("distance"))


@query("polyline_project", "SELECT n_nationkey::BIGINT AS id, round((1 + n_nationkey % 9) / 10e0, 6) + 0e0 AS fraction, (n_nationkey % 5) * 0.01 <= 0.025 AS covers FROM nation")
def polyline_project(spark, d):
    """A point some way along a triangle's first edge, found again; and whether the edge, moved aside by up to 0.04 radians, stays within 0.025 of itself."""

    def run(k, *x):
        a, b = tuple(x[:3]), tuple(x[3:])
        at = shapes.interpolate_chain([a, b], (1 + int(k) % 9) / 10)
        n = shapes.unit(shapes.cross(a, b))
        off = (int(k) % 5) * 0.01
        side = lambda v: shapes.unit(tuple(s * math.cos(off) + t * math.sin(off) for s, t in zip(v, n, strict=True)))
        return [shapes.uninterpolate([a, b], at), float(shapes.nearly_covers([a, b], [side(a), side(b)], 0.025))]

    v = F.col("v")
    df = triangles(spark, d).withColumn("v", shapes.apply(run, "array<double>", F.col("id"), *[F.col(f"{q}{a}") for q in "ab" for a in "xyz"]))
    return df.select("id", r6(v[0]).alias("fraction"), (v[1] == 1).alias("covers"))
