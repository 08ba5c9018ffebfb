"""Queries on building, overlay, buffers, winding, nesting and validation of shapes, held against closed forms.

Slices are triangles from the north pole to two points of the equator: their area is their width, so unions and intersections are sums.
"""

import math

from pyspark.sql import functions as F

from sphera.operators import builder as bd
from sphera.operators import polygons as pg
from sphera.operators import shapes as sh
from sphera.operators.joins import spread
from sphera.plans import duck as d_
from sphera.plans.base import d_encode, d_points, d_r6, points, query, r6, table
from sphera.plans.edgeplans import _GRID, _STARS, grid, stars

_SL = "sl AS (SELECT s_suppkey::BIGINT AS id, (s_suppkey * 7) % 360 AS a, 10 + s_suppkey % 40 AS w, (s_suppkey * 7) % 360 + 5 + (s_suppkey * 3) % 20 AS a2, 10 + (s_suppkey * 11) % 30 AS w2 FROM supplier), m AS (SELECT *, radians(w) AS one, radians(w2) AS two, radians(greatest(0, least(a + w, a2 + w2) - greatest(a, a2))) AS shared FROM sl)"
POLE = (0.0, 0.0, 1.0)


def _slice(a: int, w: int) -> list[list[tuple]]:
    at = lambda d: (math.cos(math.radians(d % 360)), math.sin(math.radians(d % 360)), 0.0)
    return [[POLE, at(int(a)), at(int(a + w))]]


def slices(spark, d):
    k = F.col("s_suppkey")
    a = (k * 7) % 360
    return spread(table(spark, d, "supplier"), "s_suppkey").select(k.cast("bigint").alias("id"), a.alias("a"), (10 + k % 40).alias("w"), (a + 5 + (k * 3) % 20).alias("a2"), (10 + (k * 11) % 30).alias("w2"))


def _of_slices(f, returns: str):
    """f(first, second) of each pair of slices."""
    return sh.apply(lambda a, w, b, v: f(_slice(a, w), _slice(b, v)), returns, F.col("a"), F.col("w"), F.col("a2"), F.col("w2"))


@query("overlay_areas", f"WITH {_SL} SELECT id, {d_r6('one + two - shared')} AS either, {d_r6('m.shared')} AS shared, {d_r6('one - m.shared')} AS rest, {d_r6('one + two - 2 * shared')} AS odd, {d_r6('m.shared / one')} AS share, m.shared > 0 AS meets, m.shared >= two AS holds FROM m")
def overlay_areas(spark, d):
    """Areas of the four set operations on pairs of slices, the share that both have, and whether one holds the other."""

    def run(x, y):
        a, b = pg.Geometry(polygon=x), pg.Geometry(polygon=y)
        size = [pg.area(pg.combine(a, b, op)["polygon"]) for op in (pg.UNION, pg.INTERSECTION, pg.DIFFERENCE, pg.SYMMETRIC)]
        return [*size, pg.overlap_fractions(x, y)[0], float(pg.geometries_intersect(a, b)), float(pg.geometry_contains(a, b))]

    df = slices(spark, d).withColumn("v", _of_slices(run, "array<double>"))
    v = F.col("v")
    return df.select("id", *[r6(v[i]).alias(n) for i, n in enumerate(("either", "shared", "rest", "odd", "share"))], (v[5] == 1).alias("meets"), (v[6] == 1).alias("holds"))


@query("winding_areas", f"WITH {_SL} SELECT id, {d_r6('one + two - shared')} AS positive, {d_r6('one + two - 2 * shared')} AS odd, {d_r6('one + two - shared')} AS non_zero, 0e0 AS negative FROM m")
def winding_areas(spark, d):
    """Both slices' loops as one set: what they wind round by each rule."""

    def run(x, y):
        return [pg.area(bd.winding_operation(x + y, rule)) if bd.winding_operation(x + y, rule) else 0.0 for rule in ("POSITIVE", "ODD", "NON_ZERO", "NEGATIVE")]

    v = F.col("v")
    return slices(spark, d).withColumn("v", _of_slices(run, "array<double>")).select("id", *[r6(v[i]).alias(n) for i, n in enumerate(("positive", "odd", "non_zero", "negative"))])


@query("clip_polylines", f"WITH {_SL} SELECT id, {d_r6('radians(20)')} AS inside, {d_r6('radians(20)')} AS outside, 1 AS parts FROM m")
def clip_polylines(spark, d):
    """A meridian from 20 south to 20 north through the slice's middle: its length inside and outside."""

    def run(a, w):
        mid = int(a) + int(w) / 2
        chain = [sh.from_degrees(-20, mid), sh.from_degrees(-7, mid), sh.from_degrees(20, mid)]
        inside, outside = (pg.clip_polyline(_slice(a, w), chain, k) for k in (True, False))
        return [sum(map(sh.length, inside)), sum(map(sh.length, outside)), float(len(inside))]

    v = F.col("v")
    df = slices(spark, d).withColumn("v", sh.apply(run, "array<double>", F.col("a"), F.col("w")))
    return df.select("id", r6(v[0]).alias("inside"), r6(v[1]).alias("outside"), v[2].cast("int").alias("parts"))


_STRIP = d_.Steps("sl AS (SELECT s_suppkey::BIGINT AS id, 10 + s_suppkey % 40 AS w, 1 + s_suppkey % 5 AS r FROM supplier)", "sl")
for _n, _lat, _lng in (("a", "-r", "0"), ("b", "-r", "w"), ("c", "r", "w"), ("e", "r", "0"), ("f", "0", "0"), ("g", "0", "w")):
    _STRIP.vector(_n, d_.at(_lat, _lng))


@query("buffer_lines", _STRIP.sql(f"SELECT id, {d_r6(d_.area('a', 'b', 'c') + ' + ' + d_.area('a', 'c', 'e'))} AS both, {d_r6(d_.area('f', 'g', 'c') + ' + ' + d_.area('f', 'c', 'e'))} AS left_side, {d_r6(d_.area('a', 'b', 'g') + ' + ' + d_.area('a', 'g', 'f'))} AS right_side FROM _"))
def buffer_lines(spark, d):
    """Strips of 1 to 5 degrees about an edge of the equator, with straight ends, on both sides or one."""

    def run(w, r):
        line = pg.Geometry(lines=[[sh.from_degrees(0, 0), sh.from_degrees(0, int(w))]])
        return [pg.area(pg.buffer(line, math.radians(int(r)), ends=pg.FLAT, side=side)) for side in (pg.BOTH, pg.LEFT, pg.RIGHT)]

    k, v = F.col("s_suppkey"), F.col("v")
    df = spread(table(spark, d, "supplier"), "s_suppkey").select(k.cast("bigint").alias("id"), (10 + k % 40).alias("w"), (1 + k % 5).alias("r"))
    return df.withColumn("v", sh.apply(run, "array<double>", F.col("w"), F.col("r"))).select("id", *[r6(v[i]).alias(n) for i, n in enumerate(("both", "left_side", "right_side"))])


_NGON = "WITH k AS (SELECT s_suppkey::BIGINT AS id, 5 + s_suppkey % 20 AS n, 2 + s_suppkey % 5 AS m FROM supplier), r AS (SELECT *, unnest(range(1, m + 1)) AS i FROM k), g AS (SELECT *, atan(1 / (tan(pi() / n) * cos(radians(6 * i)))) AS h FROM r), a AS (SELECT *, n * 2 * h - (n - 2) * pi() AS area FROM g)"


@query("nested_polygons", f"{_NGON} SELECT id, {d_r6('sum(CASE WHEN (m - i) % 2 = 0 THEN area ELSE -area END)')} AS area, sum((m - i) % 2)::BIGINT AS holes, max(m - i)::BIGINT AS deepest FROM a GROUP BY id")
def nested_polygons(spark, d):
    """Rings of 6, 12, .. degrees about the pole, given either way round and out of order: the area between them, how many are holes and how deep they lie."""

    def run(n, m):
        rings = [sh.regular_loop(POLE, math.radians(6 * (i + 1)), int(n)) for i in range(int(m))]
        loops, depths = pg.from_nested([r if i % 2 else r[::-1] for i, r in enumerate(rings)][::-1])
        nesting = pg.shape_nesting(loops)
        return [pg.area(loops), float(sum(not shell for _, shell, _, _ in nesting)), float(max(depths)), float(pg.last_descendant(depths, 0))]

    k, v = F.col("s_suppkey"), F.col("v")
    df = spread(table(spark, d, "supplier"), "s_suppkey").select(k.cast("bigint").alias("id"), (5 + k % 20).alias("n"), (2 + k % 5).alias("m")).withColumn("v", sh.apply(run, "array<double>", F.col("n"), F.col("m")))
    return df.select("id", r6(v[0]).alias("area"), v[1].cast("bigint").alias("holes"), v[2].cast("bigint").alias("deepest"))


@query("polygon_distances", "SELECT s_suppkey::BIGINT AS id, round(radians(greatest(0, 10 + s_suppkey % 40 - 30)), 6) + 0e0 AS distance, round(radians(abs(10 + s_suppkey % 40 - 30)), 6) + 0e0 AS vertex FROM supplier WHERE s_suppkey % 40 <> 20")
def polygon_distances(spark, d):
    """From points of the meridian of a ring's first vertex: outside, that vertex, 30 degrees from the pole, is the nearest point."""

    def run(deg):
        ring = sh.regular_loop(POLE, math.radians(30), 60)
        v = ring[0]
        side = sh.unit(tuple(x - y * sh.dot(v, POLE) for x, y in zip(v, POLE, strict=True)))
        p = tuple(x * math.cos(math.radians(deg)) + y * math.sin(math.radians(deg)) for x, y in zip(POLE, side, strict=True))
        return [pg.distance([ring], p), sh.angle(p, v)]

    k, v = F.col("s_suppkey"), F.col("v")
    df = spread(table(spark, d, "supplier"), "s_suppkey").where("s_suppkey % 40 <> 20").select(k.cast("bigint").alias("id"), (10 + k % 40).cast("double").alias("deg")).withColumn("v", sh.apply(run, "array<double>", F.col("deg")))
    return df.select("id", r6(v[0]).alias("distance"), r6(v[1]).alias("vertex"))


# --- building ---------------------------------------------------------------------------------------


def _snapped_stars_sql(vertices: str) -> str:
    """Area (thousandths) and vertices of stars whose vertices have moved; vertices: CTEs that end with sz (shape, m, j, x, y, z)."""
    s = d_.Steps(f"{_STARS}, {vertices}, ze AS (SELECT a.shape, a.j, o.x AS o_x, o.y AS o_y, o.z AS o_z, a.x AS a_x, a.y AS a_y, a.z AS a_z, b.x AS b_x, b.y AS b_y, b.z AS b_z FROM sz a JOIN sz b ON a.shape = b.shape AND b.j = (a.j + 1) % (2 * a.m) JOIN sz o ON o.shape = a.shape AND o.j = 0)", "ze")
    return s.sql(f"SELECT shape, count(*)::BIGINT AS vertices, {d_r6('1000 * sum(CASE WHEN j > 0 THEN ' + d_.area('o', 'a', 'b') + ' ELSE 0 END)')} AS area FROM _ GROUP BY shape")


def _built(spark, d, options, layer=bd.polygon_layer):
    def run(edges):
        b = bd.Builder(options)
        b.add_shape(edges)
        return layer(b)

    loops = bd.assemble(stars(spark, d), run)
    size = sh.apply(lambda loops: pg.area(loops) * 1000, "double", F.col("loops"))
    return loops.select("shape", F.aggregate("loops", F.lit(0).cast("bigint"), lambda s, x: s + F.size(x)).alias("vertices"), r6(size).alias("area"))


@query("build_latlng_snapped", _snapped_stars_sql("sr AS (SELECT shape, m, j, round(lat * 10) / 10e0 AS lat, round((lng + 540 - floor((lng + 540) / 360) * 360 - 180) * 10) / 10e0 AS lng FROM sl), sz AS (SELECT shape, m, j, " + ", ".join(f"{e} AS {a}" for a, e in zip("xyz", d_.at("lat", "lng"), strict=True)) + " FROM sr)"))
def build_latlng_snapped(spark, d):
    """The stars with vertices at tenths of a degree."""
    return _built(spark, d, bd.Options(bd.latlng_snap(1)))


_MIDDLE = lambda c: d_.st_to_uv(f"(((({c} >> 20) << 20) + 524288) / 1073741824e0)")  # of level-10 cells
_CENTERS = f"sq AS (SELECT shape, m, j AS nr, x, y, z FROM sx), {d_encode('sc', 'sq')}, su AS (SELECT shape, m, nr AS j, face, {_MIDDLE('i')} AS cu, {_MIDDLE('j')} AS cv FROM sc), sz AS (SELECT shape, m, j, " + ", ".join(f"{e} / sqrt(1 + cu*cu + cv*cv) AS {a}" for a, e in zip("xyz", d_.face_xyz("face", "cu", "cv"), strict=True)) + " FROM su)"


@query("build_cell_snapped", _snapped_stars_sql(_CENTERS))
def build_cell_snapped(spark, d):
    """The stars with vertices at centres of level-10 cells."""
    return _built(spark, d, bd.Options(bd.cell_snap(10)))


@query("build_identity", _snapped_stars_sql("sz AS (SELECT * FROM sx)"))
def build_identity(spark, d):
    """Edges in, the same polygons out."""
    return _built(spark, d, bd.Options())


_GS = d_.Steps(f"{_GRID}, gx AS (SELECT shape, la, la + 10 AS lb, ln, ln + 10 AS lm FROM g)", "gx")
for _n, _lat, _lng in (("a", "la", "ln"), ("b", "la", "lm"), ("c", "lb", "lm"), ("e", "lb", "ln")):
    _GS.vector(_n, d_.at(_lat, _lng))


@query("build_union_of_grid", _GS.sql(f"SELECT 1::BIGINT AS loops, 20::BIGINT AS vertices, {d_r6('sum(' + d_.area('a', 'b', 'c') + ' + ' + d_.area('a', 'c', 'e') + ')')} AS area FROM _"))
def build_union_of_grid(spark, d):
    """All quadrilaterals of the grid as edges of one shape: borders that two share go, one loop is left."""

    def run(edges):
        b = bd.Builder()
        b.add_shape(edges)
        return bd.polygon_layer(b)

    one = grid(spark, d).withColumns({"chain": F.col("shape").cast("int"), "shape": F.lit(0).cast("bigint")})
    loops = bd.assemble(one, run)
    return loops.select(F.size("loops").cast("bigint").alias("loops"), F.aggregate("loops", F.lit(0).cast("bigint"), lambda s, x: s + F.size(x)).alias("vertices"), r6(sh.apply(pg.area, "double", F.col("loops"))).alias("area"))


@query("graph_siblings", f"WITH {_GRID}, v AS (SELECT la, ln FROM g) SELECT 100::BIGINT AS edges, (2 * (SELECT count(*) FROM v a JOIN v b ON (a.la = b.la AND a.ln = b.ln + 10) OR (a.ln = b.ln AND a.la = b.la + 10)))::BIGINT AS paired, (SELECT count(*) FROM (SELECT DISTINCT la + 10 * i, ln + 10 * j FROM v, range(2) x(i), range(2) y(j)))::BIGINT AS vertices, 25::BIGINT AS loops")
def graph_siblings(spark, d):
    """The graph of the grid: edges that have a sibling, vertices, and loops by the left turn map."""
    one = grid(spark, d).withColumns({"chain": F.col("shape").cast("int"), "shape": F.lit(0).cast("bigint")})

    def run(edges):
        b = bd.Builder()
        b.add_shape(edges)
        graph = bd.filter_vertices(b.build())
        siblings = bd.sibling_map(graph)
        n = [len(graph.edges), sum(s is not None for s in siblings), len(graph.vertices), len(bd.directed_loops(graph))]
        return [[(float(x), 0.0, 0.0) for x in n]]

    v = F.col("loops")[0]
    return bd.assemble(one, run).select(*[v[i][0].cast("bigint").alias(n) for i, n in enumerate(("edges", "paired", "vertices", "loops"))])


@query("build_split_crossings", f"WITH {_SL} SELECT id, {d_r6('one + two - shared')} AS area, true AS crossed FROM m WHERE shared > 0")
def build_split_crossings(spark, d):
    """Two slices turned against each other so that their sides cross: with edges split, the loops that wind round something make their union.

    (The second slice is the first one's copy, moved along the equator: their sides meet in the pole, their bases overlap.)"""

    def run(x, y):
        return [pg.area(bd.winding_operation(x + y, "POSITIVE")), float(len(bd.winding_operation(x + y, "POSITIVE")))]

    v = F.col("v")
    df = slices(spark, d).withColumn("v", _of_slices(run, "array<double>")).where("least(a + w, a2 + w2) > greatest(a, a2)")
    return df.select("id", r6(v[0]).alias("area"), (v[1] > 0).alias("crossed"))


_TRACK = f"WITH {d_points('ep', 'events', 'event_id', 'user_id', 'ts')}, o AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM ep WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)), st AS (SELECT *, atan2(sqrt(power(y*pz-z*py, 2) + power(z*px-x*pz, 2) + power(x*py-y*px, 2)), x*px + y*py + z*pz) AS a FROM o)"


def _tracks(spark, d):
    df = spread(points(spark, d, "events", "event_id", "user_id", "ts"), "user_id")
    track = F.array_sort(F.collect_list(F.struct("ts", "id", F.array("x", "y", "z").alias("p"))))
    return df.groupBy("user_id").agg(F.transform(track, lambda s: s["p"]).alias("track"))


@query("polyline_layers", f"{_TRACK} SELECT user_id, {d_r6('sum(a)')} AS length, {d_r6('sum(a) / 2')} AS half, count(*)::BIGINT AS vertices FROM st GROUP BY user_id HAVING count(*) > 1")
def polyline_layers(spark, d):
    """Tracks put together again from their edges, and the length of the middle half of each."""

    def run(t):
        b = bd.Builder()
        b.add_polyline(t)
        lines = bd.polyline_vector_layer(b)
        whole = max(lines, key=len)
        middle = pg.chain_slice(t, 0.25, 0.75)
        return [sum(map(sh.length, lines)), sh.length(middle), float(sum(map(len, lines)) - len(lines) + 1), float(len(whole))]

    v = F.col("v")
    df = _tracks(spark, d).where(F.size("track") > 1).withColumn("v", sh.apply(run, "array<double>", F.col("track")))
    return df.select("user_id", r6(v[0]).alias("length"), r6(v[1]).alias("half"), v[2].cast("bigint").alias("vertices"))


@query("approx_alignment", f"{_TRACK} SELECT user_id, count(*)::BIGINT AS n, 0e0 AS own FROM st GROUP BY user_id")
def approx_alignment(spark, d):
    """A track against itself within a band: no cost, by a path of as many steps as vertices."""

    def run(t):
        cost, path = pg.approx_alignment(t, t, 4)
        return [cost, float(len(path))]

    v = F.col("v")
    return _tracks(spark, d).withColumn("v", sh.apply(run, "array<double>", F.col("track"))).select("user_id", v[1].cast("bigint").alias("n"), r6(v[0]).alias("own"))


_FAULTS = ["OK", "DUPLICATE_VERTICES", "LOOP_SELF_INTERSECTION", "POLYGON_INCONSISTENT_LOOP_ORIENTATIONS", "OVERLAPPING_GEOMETRY", "INVALID_VERTEX", "ANTIPODAL_VERTICES", "LOOP_CROSSING"]


@query("validation_codes", "SELECT c_custkey::BIGINT AS id, [" + ", ".join(f"'{x}'" for x in _FAULTS) + "][(c_custkey % 8 + 1)::BIGINT] AS error FROM customer")
def validation_codes(spark, d):
    """Polygons about each customer with one fault each, or none."""

    def run(k, lat, lng):
        kind = int(k) % 8
        center = sh.from_degrees(lat * 0.8, lng)
        loop = sh.regular_loop(center, 0.1, 8)
        wide, four, near, far = sh.regular_loop(center, 0.2, 8), sh.regular_loop(center, 0.1, 4), sh.regular_loop(center, 0.05, 4), sh.regular_loop(center, 0.5, 8)[1]
        polygon = [
            [loop],
            [[loop[0], *loop]],
            [[loop[0], loop[4], loop[2], loop[6]]],
            [loop, sh.regular_loop(center, 0.05, 8)],
            [loop, [loop[0], loop[1], wide[0]]],
            [[tuple(2 * x for x in loop[0]), *loop[1:]]],
            [[loop[0], tuple(-x for x in loop[0]), loop[3]]],
            # two chains that cross in two vertices of both
            [[center, near[0], far, four[2]], [center, near[1], far, four[3]]],
        ][kind]
        return pg.find_error(polygon=polygon) or "OK"

    df = spread(points(spark, d, "customer", "c_custkey"), "id")
    return df.select("id", sh.apply(run, "string", F.col("id"), F.col("lat"), F.col("lng")).alias("error"))


@query("snap_levels", "SELECT s_suppkey::BIGINT AS id, 4 + s_suppkey % 20 AS level, (4 + s_suppkey % 20)::BIGINT AS needed FROM supplier")
def snap_levels(spark, d):
    """A track moved to the centres of cells of a level has that level, which is also what the level's own snap radius asks for."""

    def run(k, x, y, z):
        level = 4 + int(k) % 20
        chain = pg.snapped_polyline([(x, y, z), sh.unit((y, z, x)), sh.unit((z, x, y))], level)
        return [float(pg.snap_level(chain)), float(bd.level_for_max_snap_radius(bd.min_snap_radius_for_level(level)))]

    v = F.col("v")
    df = spread(points(spark, d, "supplier", "s_suppkey"), "id").withColumn("v", sh.apply(run, "array<double>", F.col("id"), F.col("x"), F.col("y"), F.col("z")))
    return df.select("id", v[0].cast("int").alias("level"), v[1].cast("bigint").alias("needed"))


@query("loop_relations", "SELECT s_suppkey::BIGINT AS id, CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 3 = 1 THEN -1 ELSE 0 END AS boundary, s_suppkey % 3 = 0 AS nested FROM supplier")
def loop_relations(spark, d):
    """A ring of 10 degrees about each supplier against one that is inside it, far off, or across."""

    def run(k, x, y, z):
        p = (x, y, z)
        side = sh.unit(sh.cross(p, (0.1, 0.7, 0.3)))
        off = {0: 0.0, 1: 1.0, 2: 0.18}[int(k) % 3]
        q = tuple(a * math.cos(off) + b * math.sin(off) for a, b in zip(p, side, strict=True))
        a, b = sh.regular_loop(p, math.radians(10), 20), sh.regular_loop(q, math.radians(5), 12)
        return [float(pg.compare_boundary(a, b)), float(pg.contains_nested(a, b))]

    v = F.col("v")
    df = spread(points(spark, d, "supplier", "s_suppkey"), "id").withColumn("v", sh.apply(run, "array<double>", F.col("id"), F.col("x"), F.col("y"), F.col("z")))
    return df.select("id", v[0].cast("int").alias("boundary"), (v[1] == 1).alias("nested"))
