"""Queries on points, angles, Earth units, projections, intervals, rectangles and caps."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from sphera.functions import points as p
from sphera.functions.intervals import Arc, Line
from sphera.functions.points import Vec
from sphera.functions.regions import Cap, Rect
from sphera.plans.base import d_points, d_r6, points, query, r6

_C = d_points("p", "customer", "c_custkey")
_S = d_points("p", "supplier", "s_suppkey")
#: each customer with the next one: id, lat..z of the first, lat2..z2 of the second
_PAIR = _C + ", q AS (SELECT a.id, a.lat, a.lng, a.x, a.y, a.z, b.lat AS lat2, b.lng AS lng2, b.x AS x2, b.y AS y2, b.z AS z2 FROM p a JOIN p b ON b.id = a.id + 1)"
_D2 = "least(4e0, (x-x2)*(x-x2) + (y-y2)*(y-y2) + (z-z2)*(z-z2))"
_DOT = "(x*x2 + y*y2 + z*z2)"
_CROSS = "sqrt((y*z2-z*y2)*(y*z2-z*y2) + (z*x2-x*z2)*(z*x2-x*z2) + (x*y2-y*x2)*(x*y2-y*x2))"
_ANGLE = f"atan2({_CROSS}, {_DOT})"


def customers(spark, d):
    return points(spark, d, "customer", "c_custkey")


def pairs(spark, d):
    a = customers(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"{c}2") for c in ("lat", "lng", "x", "y", "z")])
    return a.join(b, "id")


def _two():
    return Vec.named(), Vec(F.col("x2"), F.col("y2"), F.col("z2"))


@query("latlng_to_point", f"WITH {_C} SELECT id, {d_r6('x')} AS x, {d_r6('y')} AS y, {d_r6('z')} AS z FROM p")
def latlng_to_point(spark, d):
    return customers(spark, d).select("id", *[r6(F.col(a)).alias(a) for a in "xyz"])


@query("point_to_latlng", f"WITH {_C} SELECT id, {d_r6('lat')} AS lat, {d_r6('lng')} AS lng, true AS valid FROM p")
def point_to_latlng(spark, d):
    v = Vec.named()
    return customers(spark, d).select("id", r6(p.latitude(v)).alias("lat"), r6(p.longitude(v)).alias("lng"), p.is_valid(F.col("lat"), F.col("lng")).alias("valid"))


@query("haversine_km", f"WITH {_PAIR} SELECT id, {d_r6('2 * asin(sqrt(least(1e0, power(sin(radians(lat2 - lat) / 2), 2) + power(sin(radians(lng2 - lng) / 2), 2) * cos(radians(lat)) * cos(radians(lat2))))) * 6371.01e0')} AS km FROM q")
def haversine_km(spark, d):
    return pairs(spark, d).select("id", r6(p.angle_to_km(p.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")))).alias("km"))


@query("point_angle", f"WITH {_PAIR} SELECT id, {d_r6(_ANGLE)} AS angle FROM q")
def point_angle(spark, d):
    return pairs(spark, d).select("id", r6(p.angle(*_two())).alias("angle"))


@query("chord_angle", f"WITH {_PAIR} SELECT id, {d_r6(_D2)} AS length2, {d_r6(f'2 * asin(sqrt({_D2}) / 2)')} AS angle, {d_r6(f'{_D2} + 0.01e0')} AS wider FROM q")
def chord_angle(spark, d):
    d2 = p.chord2(*_two())
    return pairs(spark, d).select("id", r6(d2).alias("length2"), r6(p.angle_of_chord2(d2)).alias("angle"), r6(p.chord2_plus_error(d2, 0.01)).alias("wider")).where(F.col("length2") <= 5)


@query("chord_sum", f"WITH {_PAIR}, a AS (SELECT id, {_ANGLE} AS a FROM q) SELECT id, {d_r6('least(4e0, power(2 * sin(least(pi(), a + 0.5e0) / 2), 2))')} AS plus, {d_r6('power(2 * sin(greatest(0e0, a - 0.5e0) / 2), 2)')} AS minus FROM a")
def chord_sum(spark, d):
    d2, half = p.chord2(*_two()), p.chord2_of_angle(F.lit(0.5))
    return pairs(spark, d).select("id", r6(p.chord2_sum(d2, half)).alias("plus"), r6(p.chord2_difference(d2, half)).alias("minus"))


@query("bearing", f"WITH {_PAIR} SELECT id, {d_r6('atan2(sin(radians(lng2 - lng)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lng2 - lng)))')} AS bearing FROM q")
def bearing(spark, d):
    return pairs(spark, d).select("id", r6(p.bearing(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))).alias("bearing"))


@query("e7_roundtrip", f"WITH {_C} SELECT id, round_even(lat * 1e7, 0)::BIGINT AS e7, round_even(lat * 1e5, 0)::BIGINT AS e5, round(round_even(lat * 1e7, 0) * 1e-7, 8) + 0e0 AS again FROM p")
def e7_roundtrip(spark, d):
    lat = F.col("lat")
    return customers(spark, d).select("id", p.to_fixed(lat, 7).cast("bigint").alias("e7"), p.to_fixed(lat, 5).cast("bigint").alias("e5"), (F.round(p.from_fixed(p.to_fixed(lat, 7), 7), 8) + F.lit(0.0)).alias("again"))


@query("unsigned_e6", f"WITH {_C}, e AS (SELECT id, round_even(lng * 1e6, 0)::BIGINT AS e FROM p) SELECT id, {d_r6('e * 1e-6')} AS lng FROM e")
def unsigned_e6(spark, d):
    e = p.to_fixed(F.col("lng"), 6).cast("bigint")
    return customers(spark, d).select("id", r6(p.from_unsigned_fixed(F.pmod(e, F.lit(1 << 32)), 6)).alias("lng"))


@query("angle_normalize", f"WITH {_C}, w AS (SELECT id, lng * 7 AS a, lat * 3 AS b FROM p) SELECT id, {d_r6('a - 360 * round_even(a / 360, 0)')} AS lng, {d_r6('greatest(-90e0, least(90e0, b))')} AS lat FROM w")
def angle_normalize(spark, d):
    lat, lng = p.normalized(F.col("lat") * 3, F.col("lng") * 7)
    return customers(spark, d).select("id", r6(lng).alias("lng"), r6(lat).alias("lat"))


@query("earth_units", f"WITH {_PAIR}, a AS (SELECT id, {_ANGLE} AS a, lat FROM q) SELECT id, {d_r6('a * 6371010e0 / 1e6')} AS megameters, {d_r6('a / 6371.01e0 * 1000')} AS as_angle, {d_r6('a * 6371.01e0 * 6371.01e0 / 1e6')} AS million_km2, {d_r6('least(2 * pi(), a * 1000 / 6371010e0 / cos(radians(lat)))')} AS lng_span FROM a")
def earth_units(spark, d):
    a = p.angle(*_two())
    return pairs(spark, d).select("id", r6(p.angle_to_meters(a) / 1e6).alias("megameters"), r6(p.km_to_angle(a * 1000)).alias("as_angle"), r6(p.steradians_to_km2(a) / 1e6).alias("million_km2"), r6(p.meters_to_longitude_radians(a * 1000, F.col("lat"))).alias("lng_span"))


@query("mercator_project", f"WITH {_C} SELECT id, {d_r6('lng')} AS mx, {d_r6('0.5e0 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) * (180 / pi())')} AS my, {d_r6('lat')} AS lat FROM p WHERE abs(lat) < 89")
def mercator_project(spark, d):
    x, y = p.mercator(F.col("lat"), F.col("lng"))
    lat, _ = p.mercator_inverse(x, y)
    return customers(spark, d).where(F.abs("lat") < 89).select("id", r6(x).alias("mx"), r6(y).alias("my"), r6(lat).alias("lat"))


@query("plate_carree", f"WITH {_C} SELECT id, {d_r6('lng * (100e0 / 180e0)')} AS px, {d_r6('lat * (100e0 / 180e0)')} AS py FROM p")
def plate_carree(spark, d):
    x, y = p.plate_carree(F.col("lat"), F.col("lng"), 100.0)
    return customers(spark, d).select("id", r6(x).alias("px"), r6(y).alias("py"))


@query("interpolate", f"WITH {_PAIR}, a AS (SELECT *, {_ANGLE} AS a FROM q) SELECT id, " + ", ".join(d_r6(f"sin(0.7e0 * a) / sin(a) * {c} + sin(0.3e0 * a) / sin(a) * {c}2") + f" AS i{c}" for c in "xyz") + " FROM a WHERE a > 0.001 AND a < 3.1")
def interpolate(spark, d):
    v = p.interpolate(*_two(), 0.3)
    a = p.angle(*_two())
    return pairs(spark, d).where((a > 0.001) & (a < 3.1)).select("id", *[r6(c).alias(f"i{n}") for c, n in zip(v, "xyz", strict=True)])


@query("rotate", f"WITH {_C} SELECT id, {d_r6('x * cos(1e0) - y * sin(1e0)')} AS rx, {d_r6('x * sin(1e0) + y * cos(1e0)')} AS ry, {d_r6('z')} AS rz FROM p")
def rotate(spark, d):
    v = p.rotate(Vec.named(), Vec.lit(0, 0, 1), F.lit(1.0))
    return customers(spark, d).select("id", *[r6(c).alias(f"r{n}") for c, n in zip(v, "xyz", strict=True)])


@query("frames", f"WITH {_C} SELECT id, 0e0 AS off, {d_r6('x')} AS bx, {d_r6('y')} AS by, {d_r6('z')} AS bz, true AS unit FROM p")
def frames(spark, d):
    """A frame's third axis is the point itself, its axes are at right angles, and coordinates go there and back."""
    v = Vec.named()
    axes = p.frame(v)
    other = Vec.lit(0.6, 0.0, 0.8)
    back = p.from_frame(axes, p.to_frame(axes, v))
    off = F.abs(axes[0].dot(axes[1])) + F.abs(axes[1].dot(axes[2])) + F.abs(axes[0].dot(axes[2])) + F.abs(p.from_frame(axes, p.to_frame(axes, other)).dot(other) - 1)
    return customers(spark, d).select("id", r6(off).alias("off"), r6(back.x).alias("bx"), r6(back.y).alias("by"), r6(back.z).alias("bz"), p.is_unit_length(p.ortho(v)).alias("unit"))


@query("interval_project", "WITH k AS (SELECT c_custkey AS id, (c_custkey % 7)::DOUBLE AS a, (c_custkey % 11)::DOUBLE AS b, (c_custkey % 13)::DOUBLE AS c, (c_custkey % 5)::DOUBLE AS e FROM customer), i AS (SELECT id, least(a, b) AS lo, greatest(a, b) AS hi, c, least(c, e) AS lo2, greatest(c, e) AS hi2 FROM k) SELECT id, lo <= c AND c <= hi AS has, greatest(lo, least(hi, c)) + 0e0 AS nearest, greatest(lo, lo2) <= least(hi, hi2) AS meets, least(lo, lo2) + 0e0 AS ulo, greatest(hi, hi2) + 0e0 AS uhi, greatest(0e0, hi - hi2, lo2 - lo) + 0e0 AS hausdorff FROM i")
def interval_project(spark, d):
    k = F.col("id")
    df = customers(spark, d).select("id", *[(k % n).cast("double").alias(c) for c, n in (("a", 7), ("b", 11), ("c", 13), ("e", 5))])
    one, two, c = Line.from_pair(F.col("a"), F.col("b")), Line.from_pair(F.col("c"), F.col("e")), F.col("c")
    u = one.union(two)
    return df.select("id", one.contains_point(c).alias("has"), one.project(c).alias("nearest"), one.intersects(two).alias("meets"), u.lo.alias("ulo"), u.hi.alias("uhi"), one.directed_hausdorff(two).alias("hausdorff"))


_ARCS = _PAIR + ", r AS (SELECT id, radians(lng) AS a, radians(lng2) AS b, radians(lat) * 2 AS c FROM q), w AS (SELECT *, CASE WHEN b - a >= 0 THEN b - a ELSE b - a + 2 * pi() END AS f FROM r), i AS (SELECT *, CASE WHEN f <= pi() THEN a ELSE b END AS lo, CASE WHEN f <= pi() THEN b ELSE a END AS hi, least(f, 2 * pi() - f) AS len FROM w)"


@query("arc_contains", f"WITH {_ARCS} SELECT id, {d_r6('lo')} AS lo, {d_r6('hi')} AS hi, {d_r6('len')} AS len, CASE WHEN lo <= hi THEN c >= lo AND c <= hi ELSE c >= lo OR c <= hi END AS has, {d_r6('2 * pi() - len')} AS rest FROM i")
def arc_contains(spark, d):
    arc = Arc.from_pair(F.radians("lng"), F.radians("lng2"))
    c = F.radians("lat") * 2
    return pairs(spark, d).select("id", r6(arc.lo).alias("lo"), r6(arc.hi).alias("hi"), r6(arc.length()).alias("len"), arc.contains_point(c).alias("has"), r6(arc.complement().length()).alias("rest"))


_RECT = "SELECT id, radians(lat) AS la, radians(lng) AS ln, radians(least(90e0, lat + 5 + id % 7)) AS lh, radians(greatest(-90e0, lat - 5 - id % 7)) AS ll, radians(10 + 2 * (id % 7))::DOUBLE AS w"


def rects(spark, d):
    """id and rectangles about the suppliers: half sizes of 5 + id % 7 degrees."""
    df = points(spark, d, "supplier", "s_suppkey")
    size = F.radians(10 + 2 * (F.col("id") % 7).cast("double"))
    return held(df, Rect.from_center_size(F.radians("lat"), F.radians("lng"), size, size))


def held(df, rect, prefix="r_"):
    """df with the rectangle's bounds in columns, and the rectangle of these columns."""
    from sphera.functions.cells import fenced

    names = [f"{prefix}{n}" for n in ("lat_lo", "lat_hi", "lng_lo", "lng_hi")]
    df = fenced(df, dict(zip(names, (rect.lat.lo, rect.lat.hi, rect.lng.lo, rect.lng.hi), strict=True)))
    a, b, c, e = (F.col(n) for n in names)
    return df, Rect(Line(a, b), Arc(c, e))


@query("rect_contains", f"WITH {_S}, r AS ({_RECT} FROM p) SELECT a.id, count(*)::BIGINT AS n FROM r a JOIN r b ON b.la BETWEEN a.ll AND a.lh AND abs((b.ln - a.ln) - 2 * pi() * round_even((b.ln - a.ln) / (2 * pi()), 0)) <= a.w / 2 GROUP BY a.id")
def rect_contains(spark, d):
    """Suppliers inside each supplier's rectangle: candidates by the cells that the rectangle's cap reaches, then the exact test."""
    from sphera.functions import cells
    from sphera.operators import nearest

    df, rect = rects(spark, d)
    cap = rect.cap_bound()
    df = cells.fenced(df, {f"m_{a}": c for c, a in zip(cap.center, "xyz", strict=True)})
    cap = cap._replace(center=Vec.named("m_"))
    boxes = df.select("id", rect.lat.lo.alias("lat_lo"), rect.lat.hi.alias("lat_hi"), rect.lng.lo.alias("lng_lo"), rect.lng.hi.alias("lng_hi"), *[c.alias(f"q_{a}") for c, a in zip(cap.center, "xyz", strict=True)])
    boxes = cells.encode(boxes, Vec.named("q_"), "q_cell").withColumnRenamed("id", "q_id")
    targets = cells.encode(df.select(F.col("id").alias("t_id"), F.radians("lat").alias("t_lat"), F.radians("lng").alias("t_lng"), *[F.col(a).alias(f"t_{a}") for a in "xyz"]), Vec.named("t_"), "t_cell")
    # half the diagonal of the largest rectangle, by its half sizes
    near = nearest.within(boxes, targets, math.radians(11 * math.sqrt(2)))
    box = Rect(Line(F.col("lat_lo"), F.col("lat_hi")), Arc(F.col("lng_lo"), F.col("lng_hi")))
    return near.where(box.contains_point(F.col("t_lat"), F.col("t_lng"))).groupBy(F.col("q_id").alias("id")).agg(F.count("*").alias("n"))


@query("rect_measures", f"WITH {_S}, r AS ({_RECT} FROM p) SELECT id, {d_r6('w * (sin(lh) - sin(ll))')} AS area, {d_r6('(lh + ll) / 2')} AS lat, {d_r6('lh - ll')} AS height FROM r")
def rect_measures(spark, d):
    df, rect = rects(spark, d)
    return df.select("id", r6(rect.area()).alias("area"), r6(rect.center()[0]).alias("lat"), r6(rect.lat.length()).alias("height"))


@query("rect_intersection", f"WITH {_S}, r AS ({_RECT} FROM p), j AS (SELECT a.id, greatest(a.ll, b.ll) AS lo, least(a.lh, b.lh) AS hi, abs((b.ln - a.ln) - 2 * pi() * round_even((b.ln - a.ln) / (2 * pi()), 0)) <= (a.w + b.w) / 2 AS lng FROM r a JOIN r b ON b.id = a.id + 1) SELECT id, lo <= hi AND lng AS meets FROM j")
def rect_intersection(spark, d):
    df, rect = rects(spark, d)
    flat = df.select("id", rect.lat.lo.alias("a"), rect.lat.hi.alias("b"), rect.lng.lo.alias("c"), rect.lng.hi.alias("e"))
    other = flat.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"{c}2") for c in "abce"])
    one, two = (Rect(Line(F.col(f"a{s}"), F.col(f"b{s}")), Arc(F.col(f"c{s}"), F.col(f"e{s}"))) for s in ("", "2"))
    return flat.join(other, "id").select("id", one.intersects(two).alias("meets"))


@query("rect_union_agg", f"WITH {_C}, c AS (SELECT p.*, c_mktsegment AS segment FROM p JOIN customer ON c_custkey = id) SELECT segment, {d_r6('min(lat)')} AS lat_lo, {d_r6('max(lat)')} AS lat_hi, count(*)::BIGINT AS n FROM c GROUP BY segment")
def rect_union_agg(spark, d):
    df = points(spark, d, "customer", "c_custkey", "c_mktsegment")
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(r6(F.min("lat")).alias("lat_lo"), r6(F.max("lat")).alias("lat_hi"), F.count("*").alias("n"))


@query("lng_bound_agg", f"WITH {_C}, c AS (SELECT radians(lng) AS a, c_mktsegment AS segment FROM p JOIN customer ON c_custkey = id), o AS (SELECT segment, a, lead(a) OVER w AS nxt, first_value(a) OVER w AS fst FROM c WINDOW w AS (PARTITION BY segment ORDER BY a)), g AS (SELECT segment, coalesce(nxt, fst + 2 * pi()) - a AS gap FROM o) SELECT segment, {d_r6('2 * pi() - max(gap)')} AS length FROM g GROUP BY segment")
def lng_bound_agg(spark, d):
    """Length of the shortest longitude interval that holds a group: all but its widest gap."""
    df = points(spark, d, "customer", "c_custkey", "c_mktsegment").select(F.col("c_mktsegment").alias("segment"), F.radians("lng").alias("a"))
    order = Window.partitionBy("segment").orderBy("a")
    gap = F.coalesce(F.lead("a").over(order), F.first("a").over(order) + 2 * math.pi) - F.col("a")
    return df.select("segment", gap.alias("gap")).groupBy("segment").agg(r6(2 * math.pi - F.max("gap")).alias("length"))


_CAPS = f"{_S}, k AS (SELECT *, (100 + 50 * (id % 20)) / 6371.01e0 AS r FROM p), c AS (SELECT *, power(2 * sin(r / 2), 2) AS l2 FROM k)"


def caps(spark, d):
    """Suppliers with the radius of their cap, 100 to 1050 km, as column r."""
    return points(spark, d, "supplier", "s_suppkey").withColumn("r", p.km_to_angle((100 + 50 * (F.col("id") % 20)).cast("double")))


@query("cap_measures", f"WITH {_CAPS} SELECT id, {d_r6('pi() * l2')} AS area, {d_r6('l2 / 2')} AS height, {d_r6('z * (1 - l2 / 4) * pi() * l2')} AS centroid_z, {d_r6('4 - l2')} AS rest, {d_r6('power(2 * sin((r + 0.1e0) / 2), 2)')} AS wider FROM c")
def cap_measures(spark, d):
    cap = Cap.from_angle(Vec.named(), F.col("r"))
    return caps(spark, d).select("id", r6(cap.area()).alias("area"), r6(cap.height()).alias("height"), r6(cap.centroid().z).alias("centroid_z"), r6(cap.complement().length2).alias("rest"), r6(cap.expanded(F.lit(0.1)).length2).alias("wider"))


@query("cap_bound", f"WITH {_CAPS} SELECT id, {d_r6('greatest(-pi() / 2, radians(lat) - r)')} AS lat_lo, {d_r6('least(pi() / 2, radians(lat) + r)')} AS lat_hi, {d_r6('CASE WHEN abs(radians(lat)) + r >= pi() / 2 THEN 2 * pi() ELSE 2 * asin(sin(r) / cos(radians(lat))) END')} AS width FROM c")
def cap_bound(spark, d):
    b = Cap.from_angle(Vec.named(), F.col("r")).rect_bound()
    return caps(spark, d).select("id", r6(b.lat.lo).alias("lat_lo"), r6(b.lat.hi).alias("lat_hi"), r6(b.lng.length()).alias("width"))


_CAP_PAIRS = f"{_CAPS}, j AS (SELECT a.id, a.r AS r1, b.r AS r2, 2 * asin(sqrt(least(4e0, power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) / 2) AS a FROM c a JOIN c b ON b.id = a.id + 1)"


@query("cap_intersects", f"WITH {_CAP_PAIRS} SELECT id, r1 * 4 + r2 * 4 >= a AS meets, r1 * 4 >= a + r2 AS holds FROM j")
def cap_intersects(spark, d):
    a = caps(spark, d).select("id", "x", "y", "z", "r")
    b = a.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"{c}2") for c in ("x", "y", "z", "r")])
    one, wide, small = Cap.from_angle(Vec.named(), F.col("r") * 4), Cap.from_angle(_two()[1], F.col("r2") * 4), Cap.from_angle(_two()[1], F.col("r2"))
    return a.join(b, "id").select("id", one.intersects(wide).alias("meets"), one.contains(small).alias("holds"))
