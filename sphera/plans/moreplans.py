"""Queries on distances of rectangles, unions of caps, shards, kinds of shapes and areas by several formulas."""

import math
import re

from pyspark.sql import functions as F

from sphera.functions import cells as c
from sphera.functions import points as p
from sphera.functions.intervals import Arc, Line
from sphera.functions.points import Vec
from sphera.functions.regions import Cap, Rect
from sphera.operators import density
from sphera.operators import edge_tables as et
from sphera.operators.joins import spread
from sphera.plans import duck as d_
from sphera.plans.base import cell_points, d_encode, d_parent, d_points, d_r6, points, query, r6
from sphera.plans.edgeplans import _STARS, stars
from sphera.plans.scalars import _D2, _PAIR, customers, pairs
from sphera.plans.spatial import _DOTS, _N, _TRIPLE, triangles

#: Boxes of whole degrees about customers, in pairs: the second is that of the next customer.
_BOX = "bx AS (SELECT c_custkey::BIGINT AS id, -60 + (c_custkey * 37) % 100 AS s, -170 + (c_custkey * 53) % 330 AS w, 5 + c_custkey % 20 AS h, 5 + c_custkey % 11 AS l FROM customer), bp AS (SELECT a.id, a.s, a.s + a.h AS n, a.w, a.w + a.l AS e, b.s AS s2, b.s + b.h AS n2, b.w AS w2, b.w + b.l AS e2 FROM bx a JOIN bx b ON b.id = a.id + 1)"


def boxes(spark, d):
    """id and columns of two rectangles in radians: a_ and b_ lat_lo, lat_hi, lng_lo, lng_hi (none goes over the far side)."""
    k = F.col("c_custkey")
    df = spark.read.parquet(f"{d}/customer.parquet").select(k.cast("bigint").alias("id"), (-60 + (k * 37) % 100).alias("s"), (-170 + (k * 53) % 330).alias("w"), (5 + k % 20).alias("h"), (5 + k % 11).alias("l"))
    rad = lambda e: F.radians(e.cast("double"))
    one = df.select("id", rad(F.col("s")).alias("a_lat_lo"), rad(F.col("s") + F.col("h")).alias("a_lat_hi"), rad(F.col("w")).alias("a_lng_lo"), rad(F.col("w") + F.col("l")).alias("a_lng_hi"))
    two = one.select((F.col("id") - 1).alias("id"), *[F.col(f"a_{n}").alias(f"b_{n}") for n in ("lat_lo", "lat_hi", "lng_lo", "lng_hi")])
    return one.join(two, "id")


def _rect(prefix: str) -> Rect:
    at = [F.col(f"{prefix}{n}") for n in ("lat_lo", "lat_hi", "lng_lo", "lng_hi")]
    return Rect(Line(*at[:2]), Arc(*at[2:]))


def _sides() -> d_.Steps:
    s = d_.Steps(_BOX, "bp")
    for name, lat, lng in (("a", "s", "w"), ("b", "n", "w"), ("c", "s", "e"), ("e", "n", "e"), ("f", "s2", "w2"), ("g", "n2", "w2"), ("h", "s2", "e2"), ("l", "n2", "e2")):
        s.vector(name, d_.at(lat, lng))
    names = []
    for k, (x, y) in enumerate((m, o) for m in ("ab", "ce") for o in ("fg", "hl")):
        for n, (q, u, v) in enumerate(((x[0], *y), (x[1], *y), (y[0], *x), (y[1], *x))):
            s.edge_distance(f"d{k}{n}", q, u, v)
            names.append(f"d{k}{n}")
    return s.add(apart=f"least({', '.join(names)})", gap="radians(greatest(0, s2 - n, s - n2))", meets="w2 <= e AND w <= e2")


@query("rect_distance", _sides().sql(f"SELECT id, {d_r6('CASE WHEN meets THEN gap ELSE apart END')} AS distance FROM _"))
def rect_distance(spark, d):
    """Least angle between each customer's box and the next one's."""
    return boxes(spark, d).select("id", r6(_rect("a_").distance(_rect("b_"))).alias("distance"))


@query("rect_expanded", f"WITH {_BOX}, m AS (SELECT *, radians(greatest(abs(s), abs(n))) AS top FROM bp) SELECT id, {d_r6('radians(s) - 0.05e0')} AS lat_lo, {d_r6('radians(n) + 0.05e0')} AS lat_hi, {d_r6('radians(l0) + 2 * asin(sin(0.05e0) / cos(top))')} AS lng_size FROM (SELECT *, e - w AS l0 FROM m) x WHERE greatest(abs(s), abs(n)) < 80")
def rect_expanded(spark, d):
    """Boxes that hold all within 0.05 radians, of those that stay off the poles: latitudes, and how many longitudes."""
    df = boxes(spark, d).where(F.greatest(F.abs("a_lat_lo"), F.abs("a_lat_hi")) < math.radians(79.99))
    r = _rect("a_").expanded_by_distance(0.05)
    return df.select("id", r6(r.lat.lo).alias("lat_lo"), r6(r.lat.hi).alias("lat_hi"), r6(r.lng.length()).alias("lng_size"))


@query("rect_boundary", f"WITH {_BOX} SELECT id, true AS across, (s2 > s AND s2 < n) AS along, false AS outside FROM bp")
def rect_boundary(spark, d):
    """Whether edges meet a box's border: one from its middle to far off does, one along a meridian from a latitude of the next box (within this one's or not) does if it begins inside, one far away does not."""
    a, b = _rect("a_"), _rect("b_")
    df = c.fenced(boxes(spark, d), {"la": a.lat.center(), "ln": a.lng.center()})
    at = lambda lat, lng: Vec(F.cos(lng) * F.cos(lat), F.sin(lng) * F.cos(lat), F.sin(lat))
    la, ln = F.col("la"), F.col("ln")
    inside = (b.lat.lo > a.lat.lo) & (b.lat.lo < a.lat.hi)
    start = F.when(inside, b.lat.lo).otherwise(a.lat.hi + 0.01)
    df = c.fenced(df, {"m": at(la, ln).struct(), "o": at(F.lit(1.5), ln).struct(), "v": at(start, ln).struct(), "t": at(a.lat.hi + 0.05, ln).struct()})
    far = (at(a.lat.hi + 0.1, ln), at(a.lat.hi + 0.2, ln + 0.1))
    return df.select("id", a.boundary_intersects(Vec.of("m"), Vec.of("o")).alias("across"), a.boundary_intersects(Vec.of("v"), Vec.of("t")).alias("along"), a.boundary_intersects(*far).alias("outside"))


@query("cap_union", f"WITH {_PAIR}, a AS (SELECT id, 2 * asin(sqrt({_D2}) / 2) AS d, 0.1e0 + id % 7 / 10e0 AS r1, 0.05e0 + id % 5 / 10e0 AS r2 FROM q) SELECT id, {d_r6('CASE WHEN r1 >= d + r2 THEN r1 WHEN r2 >= d + r1 THEN r2 ELSE least(pi(), (d + r1 + r2) / 2) END')} AS radius, true AS holds FROM a")
def cap_union(spark, d):
    """The smallest cap about two: its radius, and whether it holds both."""
    k = F.col("id")
    one, two = Cap.from_angle(Vec.named(), F.lit(0.1) + k % 7 / F.lit(10.0)), Cap.from_angle(Vec(F.col("x2"), F.col("y2"), F.col("z2")), F.lit(0.05) + k % 5 / F.lit(10.0))
    # a step at a time: in one expression each part of the union would be worked out again wherever it is used
    df = c.fenced(spread(pairs(spark, d), "id"), {"l1": one.length2, "l2": two.length2, "n": one.center.cross(two.center).struct()})
    one, two = one._replace(length2=F.col("l1")), two._replace(length2=F.col("l2"))
    df = c.fenced(df, {"s": one.union_sizes(two), "v": Vec.of("n").cross(one.center).struct()})
    df = c.fenced(df, {"w": Vec.of("v").normalized().struct()})
    df = c.fenced(df, {"u": one.union_by(two, F.col("s"), Vec.of("w"))})
    u = Cap(Vec.of("u.c"), F.col("u.l") + 1e-9)
    return df.select("id", r6(Cap(Vec.of("u.c"), F.col("u.l")).radius()).alias("radius"), (u.contains(one) & u.contains(two)).alias("holds"))


@query("most_intersecting_shard", f"WITH {d_points('cp', 'customer', 'c_custkey')}, {d_encode('t', 'cp')}, {d_points('sp', 'supplier', 's_suppkey')}, {d_encode('u', 'sp')}, q AS (SELECT DISTINCT {d_parent('cell', 2)} AS cell FROM t), sh AS (SELECT DISTINCT id % 3 AS shard, {d_parent('cell', 4)} AS s FROM u), m AS (SELECT q.cell, shard, count(*) AS n FROM q JOIN sh ON {d_parent('sh.s', 2)} = q.cell GROUP BY 1, 2) SELECT q.cell, arg_max(shard, n * 100 - shard) AS shard, (max(n) * power(4, 26))::BIGINT AS leaves FROM q LEFT JOIN m ON m.cell = q.cell GROUP BY q.cell")
def most_intersecting_shard(spark, d):
    """Of the customers' level-2 cells: which third of the suppliers' level-4 cells covers most of each."""
    q = cell_points(spark, d, "customer", "c_custkey").select(c.parent(F.col("cell"), 2).alias("cell")).distinct()
    shards = cell_points(spark, d, "supplier", "s_suppkey").select((F.col("id") % 3).alias("shard"), c.parent(F.col("cell"), 4).alias("shard_cell"))
    return density.most_intersecting_shard(q, shards)


@query("shape_kinds", f"WITH {d_points('ep', 'events', 'event_id', 'user_id', 'ts')}, n AS (SELECT user_id, count(*) AS n FROM ep GROUP BY 1 HAVING count(*) > 1) SELECT user_id AS shape, k AS dim, (CASE k WHEN 1 THEN n - 1 ELSE n END)::BIGINT AS num_edges, (CASE k WHEN 0 THEN n ELSE 1 END)::BIGINT AS num_chains, n::BIGINT AS num_vertices FROM n, range(3) r(k)")
def shape_kinds(spark, d):
    """Each user's events as points, as a track and as a loop: edges, chains and vertices."""
    df = points(spark, d, "events", "event_id", "user_id", "ts")
    more = df.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 1").select("user_id")
    df = spread(df.join(more, "user_id"), "user_id")
    chains = df.groupBy(F.col("user_id").alias("shape"), F.lit(0).alias("chain")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "x", "y", "z"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z"))).alias("vertices"))
    kinds = (et.of_points(df.select(F.col("user_id").alias("shape"), "x", "y", "z")), et.of_tracks(df, "user_id", "ts", "id"), et.of_loops(chains))
    out = None
    for k in kinds:
        n = et.counts(k)
        out = n if out is None else out.unionByName(n)
    return out.select("shape", F.col("dim").cast("bigint").alias("dim"), "num_edges", "num_chains", F.col("num_vertices").cast("bigint").alias("num_vertices"))


@query("flat_areas", f"WITH {_STARS}, o AS (SELECT e.*, s.x AS o_x, s.y AS o_y, s.z AS o_z FROM se e JOIN sx s ON s.shape = e.shape AND s.j = 0), n AS (SELECT *, (a_y-o_y)*(b_z-o_z) - (a_z-o_z)*(b_y-o_y) AS n_x, (a_z-o_z)*(b_x-o_x) - (a_x-o_x)*(b_z-o_z) AS n_y, (a_x-o_x)*(b_y-o_y) - (a_y-o_y)*(b_x-o_x) AS n_z FROM o) SELECT shape, {d_r6('1000 * sum(0.5e0 * sqrt(n_x*n_x + n_y*n_y + n_z*n_z) * sign(n_x*o_x + n_y*o_y + n_z*o_z))')} AS area FROM n GROUP BY shape")
def flat_areas(spark, d):
    """The stars' areas by flat triangles, in thousandths."""
    return et.approx_areas(stars(spark, d)).select("shape", r6(F.col("area") * 1000).alias("area"))


@query("triangle_area_formulas", re.sub(r"\b([a-dnpq])([xyz])\b", r"\1_\2", f"WITH {_N} SELECT id, {d_r6(f'1000 * abs(2 * atan2({_TRIPLE}, {_DOTS}))')} AS girard, {d_r6(f'1000 * abs(2 * atan2({_TRIPLE}, {_DOTS}))')} AS integral FROM xyz"))
def triangle_area_formulas(spark, d):
    """The triangles' areas, in thousandths, by their angles, and as an integral over the loop's own triangles."""
    from sphera.functions import edges as e

    a, b, t = Vec.named("a"), Vec.named("b"), Vec.named("c")
    df = triangles(spark, d)
    girard = e.vertex_angle(a, b, t) + e.vertex_angle(b, t, a) + e.vertex_angle(t, a, b) - math.pi
    v = [F.struct(*[F.col(f"{q}{x}").alias(x) for x in "xyz"]) for q in "abc"]
    table = et.of_loops(df.select(F.col("id").alias("shape"), F.lit(0).alias("chain"), F.array(*v).alias("vertices")))
    total = et.surface_integral(table, lambda x, y, z: e.signed_area(x, y, z), F.sum)
    return df.select("id", r6(girard * 1000).alias("girard")).join(total.select(F.col("shape").alias("id"), r6(F.col("integral") * 1000).alias("integral")), "id")


@query("latlng_equal", f"WITH {d_points('cp', 'customer', 'c_custkey')} SELECT id, true AS near, false AS other FROM cp")
def latlng_equal(spark, d):
    """Points moved by 1e-16 are equal to rounding, by 1e-9 they are not."""
    v = Vec.named()
    df = c.fenced(customers(spark, d), {"m": p.ortho(v).struct()})
    df = c.fenced(df, {"m": p.rotate(v, Vec.of("m"), F.lit(1e-9)).struct()})
    return df.select("id", p.approx_equals(v, Vec(F.col("x") + 1e-17, F.col("y"), F.col("z"))).alias("near"), p.approx_equals(v, Vec.of("m")).alias("other"))
