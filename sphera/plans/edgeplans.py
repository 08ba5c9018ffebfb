"""Queries on tables of edges: measures, the shape index, containment, crossings, distances between edges, cells and shapes."""

import math

from pyspark.sql import functions as F

from sphera.functions import cells as c
from sphera.functions.points import Vec
from sphera.operators import edge_distance as ed
from sphera.operators import edge_tables as et
from sphera.operators import joins
from sphera.operators import shape_index as si
from sphera.plans import duck as d_
from sphera.plans.base import cell_points, d_encode, d_parent, d_points, d_r6, points, query, r6
from sphera.plans.spatial import triangles

_C = d_points("cp", "customer", "c_custkey")
#: Star-shaped polygons about the suppliers: 10 to 28 vertices, by turns at r and r / 2 degrees from the middle.
_STARS = (
    f"{d_points('sp', 'supplier', 's_suppkey')}, st AS (SELECT id AS shape, lat * 0.7e0 AS la, lng AS ln, 5 + id % 10 AS m, 2e0 + id % 3 AS r FROM sp), "
    "sk AS (SELECT *, unnest(range(2 * m)) AS j FROM st), sv AS (SELECT *, CASE WHEN j % 2 = 0 THEN r ELSE r / 2 END AS rr, 2 * pi() * j / (2 * m) AS t FROM sk), "
    "sl AS (SELECT shape, m, j, la + rr * sin(t) AS lat, ln + rr * cos(t) / cos(radians(la)) AS lng FROM sv), "
    f"sx AS (SELECT shape, m, j, {', '.join(f'{e} AS {a}' for a, e in zip('xyz', d_.at('lat', 'lng'), strict=True))} FROM sl), "
    "se AS (SELECT a.shape, a.j::BIGINT AS edge, a.x AS a_x, a.y AS a_y, a.z AS a_z, b.x AS b_x, b.y AS b_y, b.z AS b_z FROM sx a JOIN sx b ON a.shape = b.shape AND b.j = (a.j + 1) % (2 * a.m))"
)


def stars(spark, d):
    df = points(spark, d, "supplier", "s_suppkey")
    la, m, r = F.col("lat") * 0.7, F.lit(5) + F.col("id") % 10, F.lit(2.0) + F.col("id") % 3

    def vertex(j):
        rr, t = F.when(j % 2 == 0, r).otherwise(r / 2), 2 * math.pi * j / (2 * m)
        lat, lng = F.radians(la + rr * F.sin(t)), F.radians(F.col("lng") + rr * F.cos(t) / F.cos(F.radians(la)))
        return F.struct((F.cos(lng) * F.cos(lat)).alias("x"), (F.sin(lng) * F.cos(lat)).alias("y"), F.sin(lat).alias("z"))

    loops = df.select(F.col("id").alias("shape"), F.lit(0).alias("chain"), F.transform(F.sequence(F.lit(0).cast("bigint"), 2 * m - 1), vertex).alias("vertices"))
    return et.of_loops(loops)


def _customers(spark, d):
    return cell_points(spark, d, "customer", "c_custkey").select(*[F.col(a).alias(f"q_{a}") for a in ("id", "x", "y", "z", "cell")])


_O = f"{_STARS}, so AS (SELECT e.*, o.x AS o_x, o.y AS o_y, o.z AS o_z, n.b_x AS c_x, n.b_y AS c_y, n.b_z AS c_z FROM se e JOIN sx o ON o.shape = e.shape AND o.j = 0 JOIN se n ON n.shape = e.shape AND n.edge = (e.edge + 1) % (2 * o.m))"
_TURN = f"(CASE WHEN {d_.triple('a', 'b', 'c')} > 0 THEN 1 ELSE -1 END * acos(greatest(-1e0, least(1e0, ({' + '.join(f'({x})*({y})' for x, y in zip(d_.cross('a', 'b'), d_.cross('b', 'c'), strict=True))}) / ({d_.norm(d_.cross('a', 'b'))} * {d_.norm(d_.cross('b', 'c'))})))))"


@query(
    "shape_measures",
    f"WITH {_O} SELECT shape, 2 AS dim, count(*)::BIGINT AS num_edges, 1::BIGINT AS num_chains, count(*)::BIGINT AS num_vertices, {d_r6('sum(' + d_.angle('a', 'b') + ')')} AS length, {d_r6('1000 * sum(CASE WHEN edge > 0 THEN ' + d_.area('o', 'a', 'b') + ' ELSE 0 END)')} AS area, "
    f"round(sum({_TURN}), 4) + 0e0 AS curvature FROM so GROUP BY shape",
)
def shape_measures(spark, d):
    """Counts, perimeter, area (in thousandths) and curvature of each star."""
    t = stars(spark, d)
    df = et.counts(t).join(et.lengths(t).select("shape", "length"), "shape").join(et.areas(t), "shape").join(et.curvatures(t).select("shape", "curvature"), "shape")
    return df.select("shape", "dim", "num_edges", "num_chains", "num_vertices", r6(F.col("length")).alias("length"), r6(F.col("area") * 1000).alias("area"), (F.round("curvature", 4) + F.lit(0.0)).alias("curvature"))


_ALONG = d_.norm(d_.cross("a", "b"))


@query(
    "shape_centroids",
    f"WITH {_STARS}, k AS (SELECT *, 0.5e0 * {d_.angle('a', 'b')} / {_ALONG} AS h FROM se) SELECT shape, " + ", ".join(f"{d_r6(f'1000 * sum(({e}) * h)')} AS {a}" for a, e in zip("xyz", d_.cross("a", "b"), strict=True)) + " FROM k GROUP BY shape",
)
def shape_centroids(spark, d):
    """Centroid times area, in thousandths."""
    return et.centroids(stars(spark, d)).select("shape", *[r6(F.col(a) * 1000).alias(a) for a in "xyz"])


@query("shape_bounds", f"WITH {_STARS} SELECT shape, {d_r6('degrees(max(lat))')} AS top FROM (SELECT shape, unnest([{', '.join(f'atan2((a_z*(1-k)+b_z*k), sqrt(power(a_x*(1-k)+b_x*k, 2) + power(a_y*(1-k)+b_y*k, 2)))' for k in ('0e0',))}]) AS lat FROM (SELECT *, 0 AS k FROM se)) GROUP BY shape")
def shape_bounds(spark, d):
    """Highest latitude of each star, which its outermost vertices have (its edges there do not bulge beyond them)."""
    top = et.bounds(stars(spark, d))
    high = et.vertices(stars(spark, d)).groupBy("shape").agg(F.max(F.atan2("z", F.hypot("x", "y"))).alias("v"))
    found = top.join(high, "shape").where("lat_hi >= v - 1e-12 AND lat_hi < v + 0.01 AND lat_lo < lat_hi AND lng_lo <> lng_hi")
    return found.select("shape", r6(F.degrees("v")).alias("top"))


@query("edge_positions", f"WITH {_STARS}, n AS (SELECT shape, count(*) AS n FROM se GROUP BY shape) SELECT shape, edge, edge AS edge_id, ((edge + n - 1) % n)::BIGINT AS prev, ((edge + 1) % n)::BIGINT AS next FROM se JOIN n USING (shape)")
def edge_positions(spark, d):
    t = et.with_neighbours(et.with_edge_ids(stars(spark, d)))
    return t.select("shape", *[F.col(x).cast("bigint").alias(x) for x in ("edge", "edge_id", "prev", "next")])


_SEEN = f"atan2({d_.dot3(('ca_y*cb_z - ca_z*cb_y', 'ca_z*cb_x - ca_x*cb_z', 'ca_x*cb_y - ca_y*cb_x'), 'p')}, ca_x*cb_x + ca_y*cb_y + ca_z*cb_z)"
_WIND = (
    f"{_STARS}, {_C}, pr AS (SELECT cp.id AS q_id, e.shape, cp.x AS p_x, cp.y AS p_y, cp.z AS p_z, e.a_x, e.a_y, e.a_z, e.b_x, e.b_y, e.b_z FROM cp, se e), "
    f"cr AS (SELECT *, {', '.join(f'{e} AS ca_{a}' for a, e in zip('xyz', d_.cross('p', 'a'), strict=True))}, {', '.join(f'{e} AS cb_{a}' for a, e in zip('xyz', d_.cross('p', 'b'), strict=True))} FROM pr)"
)


@query("index_containment", f"WITH {_WIND} SELECT q_id, shape FROM cr GROUP BY q_id, shape HAVING round(sum({_SEEN}) / (2 * pi())) > 0")
def index_containment(spark, d):
    """Which stars hold which customers, by the shape index."""
    index = si.build(stars(spark, d), 8)
    return si.containing_shapes(index, _customers(spark, d), "open")


#: A grid of quadrilaterals of 10 degrees between latitudes of -40 and 40, numbered by nation.
_GRID = "g AS (SELECT n_nationkey::BIGINT AS shape, -40 + 10 * (n_nationkey // 5) AS la, 10 * (n_nationkey % 5) AS ln FROM nation)"


def grid(spark, d):
    k = F.col("n_nationkey")
    df = spark.read.parquet(f"{d}/nation.parquet").select(k.cast("bigint").alias("shape"), F.lit(0).alias("chain"), (-40 + 10 * F.floor(k / 5)).alias("la"), (10 * (k % 5)).alias("ln"))

    def at(a, b):
        lat, lng = F.radians((F.col("la") + a).cast("double")), F.radians((F.col("ln") + b).cast("double"))
        return F.struct((F.cos(lng) * F.cos(lat)).alias("x"), (F.sin(lng) * F.cos(lat)).alias("y"), F.sin(lat).alias("z"))

    return et.of_loops(df.select("shape", "chain", F.array(at(0, 0), at(0, 10), at(10, 10), at(10, 0)).alias("vertices")))


def _grid_vertices(spark, d):
    v = et.vertices(grid(spark, d)).select("x", "y", "z").distinct()
    ids = v.withColumn("q_id", F.round(F.degrees(F.asin("z"))).cast("bigint") * 1000 + F.round(F.degrees(F.atan2("y", "x"))).cast("bigint"))
    return c.encode(ids.select("q_id", *[F.col(a).alias(f"q_{a}") for a in "xyz"]), Vec.named("q_"), "q_cell")


@query(
    "vertex_models",
    f"WITH {_GRID}, v AS (SELECT shape, (la + 10 * a) * 1000 + ln + 10 * b AS q_id FROM g, range(2) x(a), range(2) y(b)), n AS (SELECT q_id, count(DISTINCT shape) AS n FROM v GROUP BY q_id) SELECT q_id::BIGINT AS q_id, 0::BIGINT AS open, n::BIGINT AS closed, CASE WHEN n = 4 THEN 1 END::BIGINT AS inner_once FROM n",
)
def vertex_models(spark, d):
    """How many quadrilaterals of the grid hold each vertex of it, under three models; with semi-open borders an inner vertex is in just one."""
    index, v = si.build(grid(spark, d), 8), _grid_vertices(spark, d)
    n = {m: si.containing_shapes(index, v, m).groupBy("q_id").agg(F.count("*").alias(m)) for m in ("open", "closed", "semi_open")}
    df = v.select("q_id").join(n["open"], "q_id", "left").join(n["closed"], "q_id", "left").join(n["semi_open"], "q_id", "left")
    return df.select("q_id", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("closed", F.lit(0)).alias("closed"), F.when(F.col("closed") == 4, F.coalesce("semi_open", F.lit(0))).alias("inner_once"))


@query("incident_edges", f"WITH {_GRID}, v AS (SELECT shape, (la + 10 * a) * 1000 + ln + 10 * b AS q_id FROM g, range(2) x(a), range(2) y(b)) SELECT q_id::BIGINT AS q_id, 2 * count(*)::BIGINT AS n FROM v GROUP BY q_id")
def incident_edges(spark, d):
    """Edges that begin or end at each vertex of the grid."""
    index, v = si.build(grid(spark, d), 8), _grid_vertices(spark, d)
    return si.incident_edges(index, v).groupBy("q_id").agg(F.count("*").alias("n"))


_PAIRS = f"{_STARS}, pq AS (SELECT l.shape AS s1, l.edge AS e1, r.shape AS s2, r.edge AS e2, " + ", ".join(f"{t}.{p}_{a} AS {n}_{a}" for n, (t, p) in {"a": ("l", "a"), "b": ("l", "b"), "c": ("r", "a"), "e": ("r", "b")}.items() for a in "xyz") + " FROM se l JOIN se r ON (l.shape, l.edge) < (r.shape, r.edge))"
_SG = lambda p, q, r: f"sign({d_.triple(p, q, r)})"


@query("crossing_edge_pairs", f"WITH {_PAIRS} SELECT s1, e1, s2, e2 FROM pq WHERE NOT (a_x = c_x AND a_y = c_y AND a_z = c_z) AND NOT (a_x = e_x AND a_y = e_y AND a_z = e_z) AND NOT (b_x = c_x AND b_y = c_y AND b_z = c_z) AND NOT (b_x = e_x AND b_y = e_y AND b_z = e_z) AND {_SG('a', 'b', 'c')} * {_SG('a', 'b', 'e')} < 0 AND {_SG('c', 'e', 'a')} * {_SG('c', 'e', 'b')} < 0 AND {_SG('a', 'b', 'c')} = {_SG('c', 'e', 'b')}")
def crossing_edge_pairs(spark, d):
    """All pairs of the stars' edges that cross, by the index."""
    pairs = si.crossing_pairs(si.build(stars(spark, d), 8))
    return pairs.select(F.col("l_shape").alias("s1"), F.col("l_edge").cast("bigint").alias("e1"), F.col("r_shape").alias("s2"), F.col("r_edge").cast("bigint").alias("e2"))


def _tri_edges(spark, d):
    """shape, dim, chain, edge of the nations' triangles."""
    t = triangles(spark, d)
    v = [F.struct(*[F.col(f"{p}{a}").alias(a) for a in "xyz"]) for p in "abc"]
    return et.of_loops(t.select(F.col("id").alias("shape"), F.lit(0).alias("chain"), F.array(*v).alias("vertices")))


_TRI = "tr AS (SELECT n_nationkey::BIGINT AS shape, -60e0 + (n_nationkey * 37) % 110 AS la, -170e0 + (n_nationkey * 71) % 330 AS ln FROM nation), tv AS (SELECT shape, k, " + ", ".join(f"{e} AS {a}" for a, e in zip("xyz", d_.at("la + CASE k WHEN 2 THEN 8 ELSE 0 END", "ln + CASE k WHEN 1 THEN 8 ELSE 0 END"), strict=True)) + " FROM tr, range(3) r(k)), te AS (SELECT a.shape, a.k AS edge, a.shape * 3 + a.k AS id, a.x AS c_x, a.y AS c_y, a.z AS c_z, b.x AS e_x, b.y AS e_y, b.z AS e_z FROM tv a JOIN tv b ON a.shape = b.shape AND b.k = (a.k + 1) % 3)"


def _near(first: str, source: str, flip: str = "") -> d_.Steps:
    """Steps from pairs with edges ab and ce to `apart`, their distance."""
    s = d_.Steps(first, source)
    s.edge_distance("d1", "a", "c", "e").edge_distance("d2", "b", "c", "e").edge_distance("d3", "c", "a", "b").edge_distance("d4", "e", "a", "b")
    meets = f"{_SG('a', 'b', 'c')} * {_SG('a', 'b', 'e')} < 0 AND {_SG('c', 'e', 'a')} * {_SG('c', 'e', 'b')} < 0 AND {_SG('a', 'b', 'c')} = {_SG('c', 'e', 'b')}"
    return s.add(apart=f"CASE WHEN {meets} THEN 0e0 ELSE least(d1, d2, d3, d4) END")


_TE = f"{_STARS}, {_TRI}, pt AS (SELECT te.id, te.shape AS nation, se.shape, se.edge, c_x, c_y, c_z, e_x, e_y, e_z, a_x, a_y, a_z, b_x, b_y, b_z FROM te, se)"


def _targets(spark, d):
    """Star edges as t_ columns; t_id is 100 shape + edge."""
    t = stars(spark, d)
    return t.select((F.col("shape") * 100 + F.col("edge")).alias("t_id"), F.col("shape").alias("t_shape"), *[F.col(e).alias(f"t_{e}") for e in et.ENDS])


def _tri_targets(spark, d, per_edge=True):
    t = _tri_edges(spark, d)
    return ed.edge_targets(t.withColumn("id", F.col("shape") * 3 + F.col("edge") if per_edge else F.col("shape")))


@query("closest_edge_to_edge", _near(_TE, "pt").sql(f"SELECT id AS q_id, {d_r6('min(apart)')} AS distance FROM _ GROUP BY id"))
def closest_edge_to_edge(spark, d):
    """From each edge of the triangles to the nearest edge of a star."""
    return ed.closest(_tri_targets(spark, d), _targets(spark, d)).select("q_id", r6(F.col("distance")).alias("distance"))


@query("closest_edge_to_index", _near(_TE, "pt").sql(f"SELECT nation AS q_id, shape, {d_r6('min(apart)')} AS distance FROM _ GROUP BY nation, shape HAVING min(apart) <= 0.2e0"))
def closest_edge_to_index(spark, d):
    """From each triangle as a whole to all stars within 0.2 radians."""
    found = ed.closest_shapes(_tri_targets(spark, d, False), _targets(spark, d), 0.2)
    return found.select("q_id", F.col("t_shape").alias("shape"), r6(F.col("distance")).alias("distance"))


_CELLS = f"{_STARS}, {_C}, {d_encode('t', 'cp')}, k AS (SELECT DISTINCT id, face, (i >> 28) << 28 AS i0, (j >> 28) << 28 AS j0 FROM t WHERE id % 10 = 1)"


def _cell_steps() -> d_.Steps:
    s = d_.Steps(_CELLS, "k")
    s.add(u0=d_.st_to_uv("(i0 / 1073741824e0)"), u1=d_.st_to_uv(f"((i0 + {1 << 28}) / 1073741824e0)"), v0=d_.st_to_uv("(j0 / 1073741824e0)"), v1=d_.st_to_uv(f"((j0 + {1 << 28}) / 1073741824e0)"))
    for name, u, v in (("f", "u0", "v0"), ("g", "u1", "v0"), ("h", "u1", "v1"), ("l", "u0", "v1")):
        s.add(**{f"{name}_{x}": f"{e} / sqrt(1 + ({u})*({u}) + ({v})*({v}))" for x, e in zip("xyz", d_.face_xyz("face", u, v), strict=True)})
    s.parts.append(f"ks AS (SELECT c.id, n, CASE n WHEN 0 THEN f_x WHEN 1 THEN g_x WHEN 2 THEN h_x ELSE l_x END AS c_x, CASE n WHEN 0 THEN f_y WHEN 1 THEN g_y WHEN 2 THEN h_y ELSE l_y END AS c_y, CASE n WHEN 0 THEN f_z WHEN 1 THEN g_z WHEN 2 THEN h_z ELSE l_z END AS c_z, "
                   f"CASE n WHEN 0 THEN g_x WHEN 1 THEN h_x WHEN 2 THEN l_x ELSE f_x END AS e_x, CASE n WHEN 0 THEN g_y WHEN 1 THEN h_y WHEN 2 THEN l_y ELSE f_y END AS e_y, CASE n WHEN 0 THEN g_z WHEN 1 THEN h_z WHEN 2 THEN l_z ELSE f_z END AS e_z FROM {s.name} c, range(4) r(n))")  # fmt: skip
    s.parts.append("kp AS (SELECT ks.id, ks.n, se.shape, se.edge, c_x, c_y, c_z, e_x, e_y, e_z, a_x, a_y, a_z, b_x, b_y, b_z FROM ks, se)")
    s.name = "kp"
    s.edge_distance("d1", "a", "c", "e").edge_distance("d2", "b", "c", "e").edge_distance("d3", "c", "a", "b").edge_distance("d4", "e", "a", "b")
    meets = f"{_SG('a', 'b', 'c')} * {_SG('a', 'b', 'e')} < 0 AND {_SG('c', 'e', 'a')} * {_SG('c', 'e', 'b')} < 0 AND {_SG('a', 'b', 'c')} = {_SG('c', 'e', 'b')}"
    return s.add(apart=f"CASE WHEN {meets} THEN 0e0 ELSE least(d1, d2, d3, d4) END", inside=f"CASE WHEN {d_.triple('c', 'e', 'a')} >= 0 THEN 1 ELSE 0 END")


@query("closest_edge_to_cell", _cell_steps().sql(f"SELECT id AS q_id, {d_r6('min(d)')} AS distance FROM (SELECT id, shape, edge, CASE WHEN sum(inside) = 4 THEN 0e0 ELSE min(apart) END AS d FROM _ GROUP BY id, shape, edge) x GROUP BY id"))
def closest_edge_to_cell(spark, d):
    """From the level-2 cell of every tenth customer to the nearest edge of a star; an edge that begins in the cell is at 0."""
    own = cell_points(spark, d, "customer", "c_custkey").where("id % 10 = 1").select("id", c.parent(F.col("cell"), 2).alias("cell"))
    # each cell once, whatever number of customers it has
    each, t = own.select("cell").distinct(), _targets(spark, d)
    found = ed.closest(ed.cell_targets(each, "cell"), t, touching=ed.inside_cells(each, t, "cell"))
    return joins.balanced_join(own, found.select(F.col("q_id").alias("cell"), "distance"), "cell").select(F.col("id").alias("q_id"), r6(F.col("distance")).alias("distance"))


_FAR = f"{_STARS}, {_TRI}, pt AS (SELECT te.id, se.shape, se.edge, -c_x AS c_x, -c_y AS c_y, -c_z AS c_z, -e_x AS e_x, -e_y AS e_y, -e_z AS e_z, a_x, a_y, a_z, b_x, b_y, b_z FROM te, se)"


@query("furthest_edge", _near(_FAR, "pt").sql(f"SELECT id AS q_id, {d_r6('pi() - min(apart)')} AS distance, max(pi() - apart) > 3.0e0 AS far FROM _ GROUP BY id"))
def furthest_edge(spark, d):
    """From each edge of the triangles to the furthest edge of a star, and whether one reaches beyond 3 radians."""
    q, t = _tri_targets(spark, d), _targets(spark, d)
    return ed.furthest(q, t).join(ed.is_distance_greater(q, t, 3.0), "q_id").select("q_id", r6(F.col("distance")).alias("distance"), F.col("greater").alias("far"))


@query("is_edge_distance_less", _near(_TE, "pt").sql("SELECT id AS q_id, min(apart) < 0.1e0 AS less FROM _ GROUP BY id"))
def is_edge_distance_less(spark, d):
    return ed.is_distance_less(_tri_targets(spark, d), _targets(spark, d), 0.1)


@query("edge_hausdorff", _near(f"{_STARS}, {_TRI}, pt AS (SELECT te.id, c_x, c_y, c_z, c_x AS e_x, c_y AS e_y, c_z AS e_z, a_x, a_y, a_z, b_x, b_y, b_z FROM te, se)", "pt").sql(f"SELECT {d_r6('max(m)')} AS distance, max(m) < 0.3e0 AS less FROM (SELECT id, min(apart) AS m FROM _ GROUP BY id) x"))
def edge_hausdorff(spark, d):
    """How far the triangles' vertices reach from the stars' edges."""
    q, t = _tri_targets(spark, d), _targets(spark, d)
    return ed.directed_hausdorff(q, t).crossJoin(ed.is_directed_hausdorff_less(q, t, 0.3)).select(r6(F.col("distance")).alias("distance"), "less")


@query("edge_pairs_closest_points", _near(_TE, "pt").sql(f"SELECT id AS q_id, 100 * shape + edge AS t_id, {d_r6('apart')} AS distance FROM _"))
def edge_pairs_closest_points(spark, d):
    """The angle between the nearest points of edge pairs: it must be the edges' distance. Also those that lie wholly near each other do."""
    q, t = _tri_targets(spark, d), _targets(spark, d)
    # the triangles are few, the stars' edges many: each task has a part of these with all of those
    pairs = ed.with_closest_points(joins.spread(t, "t_id").crossJoin(F.broadcast(q)))
    from sphera.functions.points import angle

    return pairs.select("q_id", "t_id", r6(angle(Vec.of("near.p"), Vec.of("near.q"))).alias("distance"))


@query("index_statistics", f"WITH {_STARS} SELECT shape, edge, true AS found FROM se")
def index_statistics(spark, d):
    """Every edge's middle is in an index cell that lists the edge, and no cell but the deepest has more than eight that are shorter than itself."""
    t = stars(spark, d)
    index = si.build(t, 8)
    mid = et.a_end().plus(et.b_end()).normalized()
    mids = t.select((F.col("shape") * 1000 + F.col("edge")).alias("q_id"), F.col("shape").alias("own"), F.col("edge").alias("own_edge"), *[x.alias(f"q_{a}") for x, a in zip(mid, "xyz", strict=True)])
    at = si.locate(index, c.encode(mids, Vec.named("q_"), "q_cell"))
    hit = at.where("own = shape").select("own", "own_edge", F.exists("edges", lambda e: e["edge"] == F.col("own_edge")).alias("hit"))
    from sphera.functions.points import angle

    size = F.expr("1.459213746386106") * F.pow(F.lit(2.0), -c.level(F.col("cell")))
    short = F.filter("edges", lambda e: angle(Vec(e["ax"], e["ay"], e["az"]), Vec(e["bx"], e["by"], e["bz"])) < size)
    most = index.groupBy("cell").agg(F.sum(F.size(short)).alias("n")).where((F.col("n") > 8) & (c.level(F.col("cell")) < si.MAX_LEVEL))
    full = most.agg((F.count("*") == 0).alias("ok"))
    return hit.groupBy("own", "own_edge").agg(F.max("hit").alias("hit")).crossJoin(full).select(F.col("own").alias("shape"), F.col("own_edge").cast("bigint").alias("edge"), (F.col("hit") & F.col("ok")).alias("found"))


@query("index_relation", f"WITH {_STARS}, v0 AS (SELECT shape, j AS id, x, y, z FROM sx), {d_encode('v', 'v0')}, {_C}, {d_encode('cc', 'cp')}, u AS (SELECT DISTINCT {d_parent('cell', 2)} AS cell FROM v) SELECT DISTINCT {d_parent('cc.cell', 2)} AS k, true AS found FROM cc JOIN u ON {d_parent('cc.cell', 2)} = u.cell")
def index_relation(spark, d):
    """Level-2 cells of customers that hold a star's vertex: the index must know them."""
    t = stars(spark, d)
    index = si.build(t, 8)
    held = c.encode(et.vertices(t), Vec.named(), "leaf").select(c.parent(F.col("leaf"), 2).alias("k")).distinct()
    own = cell_points(spark, d, "customer", "c_custkey").select(c.parent(F.col("cell"), 2).alias("k")).distinct().join(held, "k", "left_semi")
    return si.relation(index, own, "k").select("k", (F.col("relation") != "DISJOINT").alias("found"))


@query("contains_vertex", f"WITH {_GRID}, v AS (SELECT shape, (la + 10 * a) * 1000 + ln + 10 * b AS q_id FROM g, range(2) x(a), range(2) y(b)), n AS (SELECT q_id, count(*) AS n FROM v GROUP BY q_id HAVING count(*) = 4) SELECT q_id::BIGINT AS q_id, 1::BIGINT AS n FROM n")
def contains_vertex(spark, d):
    """How many of the four quadrilaterals about an inner vertex of the grid hold it."""
    held = et.contains_vertex(grid(spark, d)).withColumn("q_id", F.round(F.degrees(F.asin("z"))).cast("bigint") * 1000 + F.round(F.degrees(F.atan2("y", "x"))).cast("bigint"))
    return held.groupBy("q_id").agg(F.count("*").alias("all"), F.sum(F.col("contains").cast("bigint")).alias("n")).where("all = 4").select("q_id", "n")
