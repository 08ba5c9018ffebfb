"""Queries on exact predicates, crossings at vertices, wedges and clipping."""

from pyspark.sql import functions as F

from sphera.functions import cells as c
from sphera.functions import clipping as cl
from sphera.functions.intervals import Line
from sphera.functions.points import Vec
from sphera.functions.regions import PlaneRect
from sphera.operators import predicates as pr
from sphera.operators.joins import spread
from sphera.plans import duck as d_
from sphera.plans.base import d_encode, d_points, d_r6, points, query, r6

_NAMES = "abce"  # four customers in a row


def four(spark, d):
    df = points(spark, d, "customer", "c_custkey")
    out = df.select("id", *[F.col(x).alias(f"a{x}") for x in "xyz"])
    for k, p in enumerate("bce", 1):
        out = out.join(df.select((F.col("id") - k).alias("id"), *[F.col(x).alias(f"{p}{x}") for x in "xyz"]), "id")
    return spread(out, "id")


def _steps() -> d_.Steps:
    join = " ".join(f"JOIN p {n} ON {n}.id = a.id + {k}" for k, n in enumerate("bce", 1))
    return d_.Steps(f"{d_points('p', 'customer', 'c_custkey')}, q AS (SELECT a.id, {', '.join(f'{n}.{x} AS {n}_{x}' for n in _NAMES for x in 'xyz')} FROM p a {join})", "q")


_INT = lambda e: f"({e})::INTEGER"


def _predicates_sql():
    s = _steps().cross("n", "a", "b").cross("m", "c", "e")
    s.edge_distance("de", "a", "b", "c").edge_distance("df", "b", "c", "e").edge_distance("dg", "c", "a", "b").edge_distance("dh", "e", "a", "b").edge_distance("di", "a", "c", "e")
    sg = lambda p, q, r: f"sign({d_.triple(p, q, r)})"
    meets = f"{sg('a', 'b', 'c')} * {sg('a', 'b', 'e')} < 0 AND {sg('c', 'e', 'a')} * {sg('c', 'e', 'b')} < 0 AND {sg('a', 'b', 'c')} = {sg('c', 'e', 'b')}"
    z = tuple(" + ".join(parts) for parts in zip(d_.cross("a", "b"), d_.cross("b", "c"), d_.cross("c", "a"), strict=True))
    return s.add(meets=meets, zx=z[0], zy=z[1], zz=z[2])


@query(
    "exact_predicates",
    _predicates_sql().sql(
        f"SELECT id, {_INT('sign(' + d_.triple('a', 'b', 'c') + ')')} AS s, {_INT('sign(' + d_.angle('a', 'b') + ' - ' + d_.angle('a', 'c') + ')')} AS distances, {_INT('sign(' + d_.chord2('a', 'b') + ' - 1.5e0)')} AS distance, {_INT('sign(2 * sin(de / 2) - 1e0)')} AS edge_distance, "
        f"CASE WHEN meets THEN -1 ELSE {_INT('sign(2 * sin(least(di, df, dg, dh) / 2) - 1e0)')} END AS pair_distance, {_INT('sign(' + d_.dot('n', 'm') + ')')} AS directions, {_INT('sign(' + d_.dot('a', 'b') + ')')} AS dots, "
        f"{_INT('sign(' + d_.dot3(('n_y*c_z - n_z*c_y', 'n_z*c_x - n_x*c_z', 'n_x*c_y - n_y*c_x'), 'e') + ')')} AS circle, {_INT(f'sign({d_.triple(*_NAMES[:3])}) * sign((c_y*e_z - c_z*e_y)*zx + (c_z*e_x - c_x*e_z)*zy + (c_x*e_y - c_y*e_x)*zz)')} AS circumcenter FROM _"
    ),
)
def exact_predicates(spark, d):
    """Signs of orientation, distances, directions and meeting points of four points."""
    df = four(spark, d)
    one, two, lim = F.lit(1.0), F.lit(1.5), "int"
    return df.select(
        "id", pr.column(pr.sign, lim, Vec.named("a"), Vec.named("b"), Vec.named("c")).alias("s"), pr.column(pr.compare_distances, lim, Vec.named("a"), Vec.named("b"), Vec.named("c")).alias("distances"), pr.column(pr.compare_distance, lim, Vec.named("a"), Vec.named("b"), two).alias("distance"), pr.column(pr.compare_edge_distance, lim, Vec.named("a"), Vec.named("b"), Vec.named("c"), one).alias("edge_distance"),
        pr.column(pr.compare_edge_pair_distance, lim, Vec.named("a"), Vec.named("b"), Vec.named("c"), Vec.named("e"), one).alias("pair_distance"), pr.column(pr.compare_edge_directions, lim, Vec.named("a"), Vec.named("b"), Vec.named("c"), Vec.named("e")).alias("directions"), pr.column(pr.sign_dot_prod, lim, Vec.named("a"), Vec.named("b")).alias("dots"),
        pr.column(pr.circle_edge_intersection_sign, lim, Vec.named("a"), Vec.named("b"), Vec.named("c"), Vec.named("e")).alias("circle"), pr.column(pr.edge_circumcenter_sign, lim, Vec.named("c"), Vec.named("e"), Vec.named("a"), Vec.named("b"), Vec.named("c")).alias("circumcenter"),
    )


@query("degenerate_signs", "SELECT c_custkey::BIGINT AS id, 0 AS flat, true AS told_apart, true AS antisymmetric, 0 AS equal FROM customer")
def degenerate_signs(spark, d):
    """Three points of one meridian plane: 0 exactly, but told apart consistently; two equal points give 0."""
    k = F.col("c_custkey").cast("double")
    df = spread(spark.read.parquet(f"{d}/customer.parquet"), "c_custkey").select(F.col("c_custkey").cast("bigint").alias("id"), *[e.alias(n) for n, e in (("ax", F.cos(k)), ("az", F.sin(k)), ("bx", F.cos(k + 1)), ("bz", F.sin(k + 1)), ("cx", F.cos(k + 2)), ("cz", F.sin(k + 2)))])
    a, b, p = (Vec(F.col(f"{n}x"), F.lit(0.0), F.col(f"{n}z")) for n in "abc")
    s, t = pr.column(pr.sign, "int", a, b, p), pr.column(pr.sign, "int", b, a, p)
    return df.select("id", pr.column(pr.unperturbed_sign, "int", a, b, p).alias("flat"), (s != 0).alias("told_apart"), (s == -t).alias("antisymmetric"), pr.column(pr.sign, "int", a, a, p).alias("equal"))


@query("robust_cross", _steps().cross("n", "a", "b").sql("SELECT id, " + ", ".join(f"{d_r6(f'n_{x} / sqrt(n_x*n_x + n_y*n_y + n_z*n_z)')} AS {x}" for x in "xyz") + ", true AS unit FROM _"))
def robust_cross(spark, d):
    """Normals of two points; `unit`: that of a point and itself moved by 1e-12 is at right angles to it, and of unit length."""
    df = four(spark, d).withColumn("n", pr.column(pr.robust_cross_prod, "array<double>", Vec.named("a"), Vec.named("b")))
    near = Vec(Vec.named("a").x + 1e-12, Vec.named("a").y, Vec.named("a").z)
    df = df.withColumn("m", pr.column(pr.robust_cross_prod, "array<double>", Vec.named("a"), near))
    m = Vec(*[F.col("m")[i] for i in range(3)])
    return df.select("id", *[r6(F.col("n")[i]).alias("xyz"[i]) for i in range(3)], ((F.abs(m.dot(Vec.named("a"))) < 1e-3) & (F.abs(m.norm2() - 1) < 1e-9)).alias("unit"))


@query("circle_crossing_order", _steps().cross("n", "a", "b").cross("m", "b", "c").sql(
    f"SELECT id, sign(({d_.dot3(('n_y*e_z - n_z*e_y', 'n_z*e_x - n_x*e_z', 'n_x*e_y - n_y*e_x'), 'a')}) / {d_.norm(('n_y*e_z - n_z*e_y', 'n_z*e_x - n_x*e_z', 'n_x*e_y - n_y*e_x'))} - ({d_.dot3(('m_y*e_z - m_z*e_y', 'm_z*e_x - m_x*e_z', 'm_x*e_y - m_y*e_x'), 'a')}) / {d_.norm(('m_y*e_z - m_z*e_y', 'm_z*e_x - m_x*e_z', 'm_x*e_y - m_y*e_x'))})::INTEGER AS which FROM _"
))
def circle_crossing_order(spark, d):
    """Of the edges ab and bc: which meets the circle about e on which side of the other, as seen from a."""
    return four(spark, d).select("id", pr.column(pr.circle_edge_intersection_ordering, "int", Vec.named("a"), Vec.named("b"), Vec.named("b"), Vec.named("c"), Vec.named("a"), Vec.named("e")).alias("which"))


@query("voronoi_exclusion", "SELECT o_orderkey::BIGINT AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'FIRST' WHEN o_orderkey % 3 = 1 THEN 'SECOND' ELSE 'NEITHER' END AS excluded FROM orders WHERE o_orderkey <= 1000")
def voronoi_exclusion(spark, d):
    """Sites near an edge of the equator: one behind the other hides it, two side by side do not."""
    df = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey <= 1000").select(F.col("o_orderkey").cast("bigint").alias("id"))
    k = F.col("id") % 3
    at = lambda lng, lat: Vec(F.cos(F.radians(lng)) * F.cos(F.radians(lat)), F.sin(F.radians(lng)) * F.cos(F.radians(lat)), F.sin(F.radians(lat)))
    a = at(F.lit(10.0), F.when(k == 0, 0.9).otherwise(0.1))
    b = at(F.when(k == 2, 11.5).otherwise(10.01), F.when(k == 1, 0.9).otherwise(0.1))
    return df.select("id", pr.column(pr.voronoi_site_exclusion, "string", a, b, at(F.lit(0.0), F.lit(0.0)), at(F.lit(20.0), F.lit(0.0)), F.radians(F.lit(1.0))).alias("excluded"))


@query("vertex_crossings", f"{_steps().sql('SELECT id, 1::BIGINT AS holders, true AS agree, 1::BIGINT AS passes FROM _')}")
def vertex_crossings(spark, d):
    """Three angles that fill the surroundings of a point: just one holds it. Of the loop through the point and two others, a path
    through the point from one side to the other crosses once; signed crossings agree with plain ones."""

    def check(a, b, p, v):
        ring = [a, b, p] if pr.exact.ordered_ccw(a, b, p, v) else [a, p, b]
        held = sum(pr.angle_contains_vertex(ring[(i + 1) % 3], v, ring[i]) for i in range(3))
        one, two, three = ring
        # the loop comes in along one and goes out along three; the path comes from two, between them, and goes on opposite
        far = tuple(-x + 2 * y * sum(m * n for m, n in zip(two, v, strict=True)) for x, y in zip(two, v, strict=True))
        loop = [(one, v), (v, three)]
        passes = sum(pr.vertex_crossing(*e, *f) for e in loop for f in ((two, v), (v, far)))
        between = pr.exact.ordered_ccw(three, far, one, v)
        agree = all(abs(pr.signed_edge_or_vertex_crossing(*e, *f)) == pr.edge_or_vertex_crossing(*e, *f) for e in loop for f in ((two, v), (v, far)))
        return f"{held},{agree},{passes % 2 if between else 1}"

    found = F.split(pr.column(pr.by_row(check), "string", Vec.named("a"), Vec.named("b"), Vec.named("c"), Vec.named("e")), ",")
    return four(spark, d).select("id", found[0].cast("bigint").alias("holders"), (found[1] == "True").alias("agree"), found[2].cast("bigint").alias("passes"))


def _wedge_sql():
    s = _steps()
    # directions about a, as angles from b counterclockwise
    for n, x in (("tc", "c"), ("te", "e")):
        s.cross(f"p{n}", "a", "b").cross(f"q{n}", "a", x)
        v = d_.dot3((f"p{n}_y*q{n}_z - p{n}_z*q{n}_y", f"p{n}_z*q{n}_x - p{n}_x*q{n}_z", f"p{n}_x*q{n}_y - p{n}_y*q{n}_x"), "a")
        s.add(**{n: f"atan2({v}, {d_.dot(f'p{n}', f'q{n}')})"})
    return s.add(c2="CASE WHEN tc < 0 THEN tc + 2 * pi() ELSE tc END", e2="CASE WHEN te < 0 THEN te + 2 * pi() ELSE te END")


@query("wedge_relations", _wedge_sql().sql("SELECT id, 'EQUALS' AS same, CASE WHEN c2 < e2 THEN 'PROPERLY_CONTAINS' ELSE 'IS_DISJOINT' END AS part, CASE WHEN c2 < e2 THEN 'IS_PROPERLY_CONTAINED' ELSE 'IS_DISJOINT' END AS rest, c2 < e2 AS holds, c2 < e2 AS meets FROM _ WHERE c2 < e2"))
def wedge_relations(spark, d):
    """Wedges at a whose rays are b, c, e in counterclockwise order: the one from b to e against itself and that from b to c, and the other way round."""
    df = four(spark, d)
    # the wedge left of first-a-last runs counterclockwise from the last ray to the first
    order = cl.turn_from(Vec.named("a"), Vec.named("b"), Vec.named("c")) < cl.turn_from(Vec.named("a"), Vec.named("b"), Vec.named("e"))
    return df.where(order).select("id", cl.wedge_relation(Vec.named("e"), Vec.named("a"), Vec.named("b"), Vec.named("e"), Vec.named("b")).alias("same"), cl.wedge_relation(Vec.named("e"), Vec.named("a"), Vec.named("b"), Vec.named("c"), Vec.named("b")).alias("part"), cl.wedge_relation(Vec.named("c"), Vec.named("a"), Vec.named("b"), Vec.named("e"), Vec.named("b")).alias("rest"), cl.wedge_contains(Vec.named("e"), Vec.named("a"), Vec.named("b"), Vec.named("c"), Vec.named("b")).alias("holds"), cl.wedge_intersects(Vec.named("e"), Vec.named("a"), Vec.named("b"), Vec.named("c"), Vec.named("b")).alias("meets"))


@query("wedge_disjoint", _wedge_sql().sql("SELECT id, 'IS_DISJOINT' AS apart, 'PROPERLY_OVERLAPS' AS mixed, false AS meets FROM _ WHERE c2 < e2"))
def wedge_disjoint(spark, d):
    """Of the same rays: b to c against c to e share a ray only; b to e against c to b overlap."""
    df = four(spark, d).where(cl.turn_from(Vec.named("a"), Vec.named("b"), Vec.named("c")) < cl.turn_from(Vec.named("a"), Vec.named("b"), Vec.named("e")))
    return df.select("id", cl.wedge_relation(Vec.named("c"), Vec.named("a"), Vec.named("b"), Vec.named("e"), Vec.named("c")).alias("apart"), cl.wedge_relation(Vec.named("e"), Vec.named("a"), Vec.named("b"), Vec.named("b"), Vec.named("c")).alias("mixed"), cl.wedge_intersects(Vec.named("c"), Vec.named("a"), Vec.named("b"), Vec.named("e"), Vec.named("c")).alias("meets"))


# --- clipping ---------------------------------------------------------------------------------------

_RECT = "x0 BETWEEN -0.5e0 AND 0.5e0 AND y0 BETWEEN -0.25e0 AND 0.75e0"
#: The oracle walks the segment in small steps.
_SEG = "s AS (SELECT p_partkey::BIGINT AS id, ((p_partkey * 37) % 200) / 100e0 - 1 AS x0, ((p_partkey * 53) % 200) / 100e0 - 1 AS y0, ((p_partkey * 71) % 200) / 100e0 - 1 AS x1, ((p_partkey * 89) % 200) / 100e0 - 1 AS y1 FROM part)"
_TS = f"{_SEG}, b AS (SELECT *, list_filter([0e0, 1e0, CASE WHEN x1 <> x0 THEN (-0.5e0 - x0) / (x1 - x0) END, CASE WHEN x1 <> x0 THEN (0.5e0 - x0) / (x1 - x0) END, CASE WHEN y1 <> y0 THEN (-0.25e0 - y0) / (y1 - y0) END, CASE WHEN y1 <> y0 THEN (0.75e0 - y0) / (y1 - y0) END], lambda t: t IS NOT NULL AND t >= 0 AND t <= 1) AS ts FROM s), k AS (SELECT *, unnest(ts) AS t FROM b), w AS (SELECT id, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y FROM k), h AS (SELECT id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS e FROM w WHERE x BETWEEN -0.5000000001e0 AND 0.5000000001e0 AND y BETWEEN -0.2500000001e0 AND 0.7500000001e0 GROUP BY id)"


@query("clip_edges", f"WITH {_TS} SELECT s.id, h.id IS NOT NULL AS meets, {d_r6('coalesce(h.a, 1e0)')} AS x_lo, {d_r6('coalesce(h.b, 0e0)')} AS x_hi, {d_r6('coalesce(h.c, 1e0)')} AS y_lo, {d_r6('coalesce(h.e, 0e0)')} AS y_hi FROM s LEFT JOIN h ON h.id = s.id")
def clip_edges(spark, d):
    """Segments cut to a rectangle, and the bounds of what is left; the oracle tries all crossings with its four lines."""
    k = F.col("p_partkey")
    at = lambda m: ((k * m) % 200) / F.lit(100.0) - 1
    df = spark.read.parquet(f"{d}/part.parquet").select(k.cast("bigint").alias("id"), at(37).alias("x0"), at(53).alias("y0"), at(71).alias("x1"), at(89).alias("y1"))
    rect = PlaneRect(Line(F.lit(-0.5), F.lit(0.5)), Line(F.lit(-0.25), F.lit(0.75)))
    seg = [F.col(n) for n in ("x0", "y0", "x1", "y1")]
    r = cl.clipped_edge_bound(*seg, rect)
    return df.select("id", cl.intersects_rect(*seg, rect).alias("meets"), r6(r.x.lo).alias("x_lo"), r6(r.x.hi).alias("x_hi"), r6(r.y.lo).alias("y_lo"), r6(r.y.hi).alias("y_hi"))


@query(
    "face_segments",
    f"WITH {d_points('p', 'customer', 'c_custkey')}, q AS (SELECT a.id, unnest(range(2001)) / 2000e0 AS t, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz FROM p a JOIN p b ON b.id = a.id + 1 WHERE a.id % 5 = 0), w AS (SELECT id, t, ax + t * (bx - ax) AS x, ay + t * (b_y - ay) AS y, az + t * (bz - az) AS z FROM q), "
    f"{d_encode('f', 'w')} SELECT id, (min(face) FILTER (t = 0))::INTEGER AS first, (min(face) FILTER (t = 1))::INTEGER AS last FROM f GROUP BY id",
)
def face_segments(spark, d):
    """The first and last faces of the edges between customers, by their segments."""
    df = cl.face_segments(four(spark, d).where("id % 5 = 0").select("id", *[f"{p}{x}" for p in "ab" for x in "xyz"]), Vec.named("a"), Vec.named("b"))
    s = F.col("segment")
    return df.groupBy("id").agg(F.min_by(s["face"], s["number"]).alias("first"), F.max_by(s["face"], s["number"]).alias("last"))


@query("face_clips", f"WITH {d_points('p', 'customer', 'c_custkey')}, {d_encode('f', 'p')} SELECT a.id, {d_r6('a.u')} AS u0, {d_r6('a.v')} AS v0 FROM f a JOIN f b ON b.id = a.id + 1")
def face_clips(spark, d):
    """An edge cut to the face of its first point, padded, begins at that point's coordinates."""
    df = points(spark, d, "customer", "c_custkey")
    nxt = df.select((F.col("id") - 1).alias("id"), *[F.col(x).alias(f"b{x}") for x in "xyz"])
    df = df.select("id", *[F.col(x).alias(f"a{x}") for x in "xyz"]).join(nxt, "id").transform(spread, "id").withColumn("face", c.face_of(Vec.named("a")))
    part = cl.clip_to_face(F.col("face"), Vec.named("a"), Vec.named("b"), 1e-9)
    (u0, v0), _ = cl.clipped_ends(F.col("face"), Vec.named("a"), Vec.named("b"), part)
    return df.where(part.exists()).select("id", r6(u0).alias("u0"), r6(v0).alias("v0"))


@query("interpolate_double", "SELECT p_partkey::BIGINT AS id, round(2 + 3 * ((p_partkey % 50) - 10) / 20e0, 9) + 0e0 AS y FROM part")
def interpolate_double(spark, d):
    x = (F.col("p_partkey") % 50).cast("double")
    y = cl.interpolate_double(x, F.lit(10.0), F.lit(30.0), F.lit(2.0), F.lit(5.0))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("id"), (F.round(y, 9) + F.lit(0.0)).alias("y"))


def _limits_sql():
    s = _steps().edge_distance("de", "c", "a", "b").cross("n", "a", "b")
    inside = f"{d_.dot3(d_.cross('n', 'a'), 'c')} > 0 AND {d_.dot3(d_.cross('n', 'b'), 'c')} < 0"
    return s.add(inside=inside)


@query("distance_limits", _limits_sql().sql(f"SELECT id, de < 0.8e0 AS less, inside AND de < 0.8e0 AS inner_less, {d_r6('least(1e0, de)')} AS updated, {d_r6('CASE WHEN inside THEN least(1e0, de) ELSE 1e0 END')} AS inner_updated, 4.5e0 * 2.220446049250313e-16 * {d_.chord2('a', 'b')} < 2e-15 AS bounded FROM _"))
def distance_limits(spark, d):
    from sphera.functions.points import chord2

    return four(spark, d).select(
        "id", cl.is_distance_less(Vec.named("c"), Vec.named("a"), Vec.named("b"), 0.8).alias("less"), cl.is_interior_distance_less(Vec.named("c"), Vec.named("a"), Vec.named("b"), 0.8).alias("inner_less"), r6(cl.min_distance_update(Vec.named("c"), Vec.named("a"), Vec.named("b"), F.lit(1.0))).alias("updated"),
        r6(cl.min_interior_distance_update(Vec.named("c"), Vec.named("a"), Vec.named("b"), F.lit(1.0))).alias("inner_updated"), (4.5 * 2.220446049250313e-16 * chord2(Vec.named("a"), Vec.named("b")) < 2e-15).alias("bounded"),
    )
