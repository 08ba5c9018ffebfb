"""Closest and furthest edges of targets that are points, edges, cells or whole sets of edges.

A target is rows of edges under one q_id (a point: an edge without length); so is the other side. Candidates come by the cells of
the edges' middles (`nearest.within`), so there is no cross join; the exact distance of two edges decides. Shapes with
an inside that hold a point of the target are at distance 0, if their containment is given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphera.functions import cells, edges
from sphera.functions.points import Vec, angle, let
from sphera.operators import nearest
from sphera.operators.lineage import cut_lineage

PI = math.pi


def edge_pair(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Least angle between two edges, either of which may have no length."""
    return edges.pair_distance(a, b, c, d)


def edge_pair_max(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Largest angle between points of two edges: half a turn less how far the antipodes of one are from the other."""
    return PI - edge_pair(a.times(-1.0), b.times(-1.0), c, d)


def closest_points(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Struct p, q: the points of two edges nearest each other; where they cross, the crossing twice."""
    cases = F.array(
        F.struct(edges.distance(a, c, d).alias("d"), a.struct().alias("p"), edges.project(a, c, d).struct().alias("q")),
        F.struct(edges.distance(b, c, d).alias("d"), b.struct().alias("p"), edges.project(b, c, d).struct().alias("q")),
        F.struct(edges.distance(c, a, b).alias("d"), edges.project(c, a, b).struct().alias("p"), c.struct().alias("q")),
        F.struct(edges.distance(d, a, b).alias("d"), edges.project(d, a, b).struct().alias("p"), d.struct().alias("q")),
    )
    x = edges.intersection(a, b, c, d).struct()
    return F.when(edges.crosses(a, b, c, d), F.struct(x.alias("p"), x.alias("q"))).otherwise(let(F.array_min(cases), lambda m: F.struct(m["p"].alias("p"), m["q"].alias("q"))))


def with_closest_points(pairs: DataFrame, out: str = "near") -> DataFrame:
    """pairs (q_ and t_ edges) with `closest_points` as the struct `out`, a step at a time: only the projection that is wanted is worked out."""
    a, b, c, d = Vec.named("q_a"), Vec.named("q_b"), Vec.named("t_a"), Vec.named("t_b")
    cases = ((a, c, d), (b, c, d), (c, a, b), (d, a, b))
    df = cells.fenced(pairs, {f"__d{k}": edges.distance(*case) for k, case in enumerate(cases)} | {"__meets": edges.crosses(a, b, c, d)})
    least = F.least(*[F.col(f"__d{k}") for k in range(4)])
    pick = lambda i: F.when(F.col("__d0") == least, cases[0][i].struct()).when(F.col("__d1") == least, cases[1][i].struct()).when(F.col("__d2") == least, cases[2][i].struct()).otherwise(cases[3][i].struct())
    mine = (F.col("__d0") == least) | (F.col("__d1") == least)
    df = cells.fenced(df, {"__p": pick(0), "__u": pick(1), "__v": pick(2), "__mine": mine}, *[f"__d{k}" for k in range(4)])
    df = cells.fenced(df, {"__f": edges.project(Vec.of("__p"), Vec.of("__u"), Vec.of("__v")).struct(), "__x": F.when(F.col("__meets"), edges.intersection(a, b, c, d).struct())}, "__u", "__v")
    p, f, x = F.col("__p"), F.col("__f"), F.col("__x")
    at = lambda own, foot: F.when(F.col("__meets"), x).when(F.col("__mine"), own).otherwise(foot)
    return cells.fenced(df, {out: F.struct(at(p, f).alias("p"), at(f, p).alias("q"))}, "__p", "__f", "__x", "__mine", "__meets")


def is_edge_near(a: Vec, b: Vec, c: Vec, d: Vec, tolerance: float) -> Column:
    """Whether every point of cd is within the tolerance of ab: its ends are, and so is where cd is furthest from ab's circle, if that is inside it."""
    n = a.cross(b).normalized()
    m = c.cross(d)
    top = n.minus(m.times(n.dot(m) / m.norm2())).normalized()  # of cd's circle, nearest n
    on = lambda p: (m.cross(c).dot(p) > 0) & (m.cross(d).dot(p) < 0)
    ends = (edges.distance(c, a, b) <= tolerance) & (edges.distance(d, a, b) <= tolerance)
    inside = lambda p: ~on(p) | (edges.distance(p, a, b) <= tolerance)
    return ends & inside(top) & inside(top.times(-1.0))


def point_targets(df: DataFrame, id_: str = "id") -> DataFrame:
    """q_ edges of points (id, x, y, z)."""
    return df.select(F.col(id_).alias("q_id"), *[F.col(a).alias(f"q_{p}{a}") for p in "ab" for a in "xyz"])


def edge_targets(df: DataFrame, id_: str = "id") -> DataFrame:
    return df.select(F.col(id_).alias("q_id"), *[F.col(f"{p}{a}").alias(f"q_{p}{a}") for p in "ab" for a in "xyz"])


def cell_targets(df: DataFrame, id_: str = "id", cell: str = "cell") -> DataFrame:
    """The four sides of each cell. Edges and points inside a cell are at distance 0 by `inside_cells`."""
    from sphera.functions.cellshape import with_shape

    sides = with_shape(df, cell, "__shape").select(F.col(id_).alias("q_id"), F.explode("__shape.sides").alias("s"))
    return sides.select("q_id", *[F.col("s")[p][a].alias(f"q_{p}{a}") for p in "ab" for a in "xyz"])


def inside_cells(df: DataFrame, t_edges: DataFrame, id_: str = "id", cell: str = "cell") -> DataFrame:
    """q_id, t_id of edges that begin in a target's cell: distance 0."""
    from sphera.operators.joins import points_in_cells

    leaves = cells.encode(t_edges.select("t_id", *[F.col(f"t_a{a}") for a in "xyz"]), Vec.named("t_a"), "__leaf")
    return points_in_cells(leaves, df.select(F.col(id_).alias("q_id"), F.col(cell).alias("__cell")), "__leaf", "__cell").select("q_id", "t_id").distinct()


def _middles(df: DataFrame, prefix: str) -> DataFrame:
    return nearest.with_middles(df, prefix)


def longest(df: DataFrame, prefix: str) -> float:
    """Length of the longest edge: one number."""
    return float(df.agg(F.max(angle(Vec.named(f"{prefix}a"), Vec.named(f"{prefix}b")))).first()[0] or 0.0)


def within(q: DataFrame, t: DataFrame, radians: float, reach: float | None = None, skip: bool = False) -> DataFrame:
    """q_id, t_id, distance of all targets and edges within an angle; reach: half the longest edges of both sides together."""
    if reach is None:
        reach = (longest(q, "q_") + longest(t, "t_")) / 2
    q = _middles(q, "q_") if "q_cell" not in q.columns else q
    t = _middles(t, "t_") if "t_cell" not in t.columns else t
    near = nearest.within(q, t, min(PI, radians + reach)).drop("d2")
    if skip:
        near = near.where("q_id <> t_id")
    apart = edge_pair(Vec.named("q_a"), Vec.named("q_b"), Vec.named("t_a"), Vec.named("t_b"))
    near = cells.fenced(near, {"distance": apart}).where(F.col("distance") <= radians)
    return near.groupBy("q_id", "t_id").agg(F.min("distance").alias("distance"))


def closest(q: DataFrame, t: DataFrame, k: int = 1, max_distance: float = PI, max_error: float = 0.0, touching: DataFrame | None = None, skip: bool = False, start: float | None = None) -> DataFrame:
    """The k closest t_id of each q_id (ties by t_id) with distance and rank, none beyond max_distance.

    touching: q_id, t_id that are at distance 0 for other reasons (insides). skip: no q_id with itself. max_error: results may be
    this much further than the true ones; the search stops one radius earlier where that is allowed.
    """
    q, t = cut_lineage(_middles(q, "q_")), cut_lineage(_middles(t, "t_"))
    reach = (longest(q, "q_") + longest(t, "t_")) / 2
    order = Window.partitionBy("q_id").orderBy("distance", "t_id")
    radius = min(max_distance, start if start is not None else max(reach, 2 * math.sqrt(4.0 * k / max(1, t.count()))))
    left, out = q, None
    while True:
        found = within(left, t, radius, reach, skip)
        if touching is not None:
            zero = touching.select("q_id", "t_id").withColumn("distance", F.lit(0.0))
            found = found.unionByName(zero.join(left.select("q_id").distinct(), "q_id", "left_semi")).groupBy("q_id", "t_id").agg(F.min("distance").alias("distance"))
        found = cut_lineage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if radius >= max_distance - max_error:
            return found if out is None else out.unionByName(found)
        full = found.groupBy("q_id").agg(F.count("*").alias("__c")).where(F.col("__c") >= k).select("q_id")
        done = found.join(full, "q_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = left.join(full, "q_id", "left_anti")
        if left.isEmpty():
            return out
        radius = min(max_distance, 4 * radius)


def closest_brute_force(q: DataFrame, t: DataFrame, k: int = 1, max_distance: float = PI) -> DataFrame:
    """The same from every pair, for small tables and tests."""
    pairs = q.crossJoin(F.broadcast(t))
    apart = edge_pair(Vec.named("q_a"), Vec.named("q_b"), Vec.named("t_a"), Vec.named("t_b"))
    found = cells.fenced(pairs, {"distance": apart}).groupBy("q_id", "t_id").agg(F.min("distance").alias("distance")).where(F.col("distance") <= max_distance)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "t_id"))).where(F.col("rank") <= k)


def furthest(q: DataFrame, t: DataFrame, k: int = 1, min_distance: float = 0.0) -> DataFrame:
    """The k furthest t_id of each q_id, none nearer than min_distance: the closest of the antipodes, for targets of one edge or a point.

    (Of a target of several edges the furthest edge is that of its furthest part, as the closest is.)
    """
    anti = q.withColumns({f"q_{p}{a}": -F.col(f"q_{p}{a}") for p in "ab" for a in "xyz"})
    return closest(anti, t, k, PI - min_distance).withColumn("distance", PI - F.col("distance"))


def is_distance_less(q: DataFrame, t: DataFrame, limit: float, or_equal: bool = False) -> DataFrame:
    """q_id, less: whether any edge is nearer than the limit."""
    found = within(q, t, limit)
    found = (found if or_equal else found.where(F.col("distance") < limit)).select("q_id").distinct().withColumn("less", F.lit(True))
    return q.select("q_id").distinct().join(found, "q_id", "left").select("q_id", F.coalesce("less", F.lit(False)).alias("less"))


def is_distance_greater(q: DataFrame, t: DataFrame, limit: float, or_equal: bool = False) -> DataFrame:
    """q_id, greater: whether any edge reaches further than the limit."""
    anti = q.withColumns({f"q_{p}{a}": -F.col(f"q_{p}{a}") for p in "ab" for a in "xyz"})
    return is_distance_less(anti, t, PI - limit, or_equal).withColumnRenamed("less", "greater")


def closest_shapes(q: DataFrame, t: DataFrame, limit: float) -> DataFrame:
    """q_id, t_shape, distance: shapes within the limit, in order of distance (t with t_shape)."""
    shapes = t.select("t_id", "t_shape").distinct()
    return within(q, t, limit).join(shapes, "t_id").groupBy("q_id", "t_shape").agg(F.min("distance").alias("distance"))


def project(q: DataFrame, t: DataFrame, found: DataFrame) -> DataFrame:
    """found (q_id, t_id of point targets) with x, y, z: the edge's point nearest the target."""
    joined = found.join(q, "q_id").join(t.select("t_id", *[f"t_{p}{a}" for p in "ab" for a in "xyz"]), "t_id")
    at = edges.project(Vec.named("q_a"), Vec.named("t_a"), Vec.named("t_b"))
    return cells.fenced(joined, {"at": at.struct()}).select(*found.columns, "at.x", "at.y", "at.z")


def directed_hausdorff(q: DataFrame, t: DataFrame) -> DataFrame:
    """One row: the vertex of q (rows of edges, q_id each) whose nearest edge of t is furthest, and how far."""
    points = q.select(F.monotonically_increasing_id().alias("q_id"), *[F.col(f"q_a{a}").alias(f"q_{p}{a}") for p in "ab" for a in "xyz"])
    return closest(cut_lineage(points), t, 1).orderBy(F.desc("distance"), "q_id").limit(1).select("distance")


def is_directed_hausdorff_less(q: DataFrame, t: DataFrame, limit: float) -> DataFrame:
    """One row: whether every vertex of q has an edge of t nearer than the limit."""
    points = cut_lineage(q.select(F.monotonically_increasing_id().alias("q_id"), *[F.col(f"q_a{a}").alias(f"q_{p}{a}") for p in "ab" for a in "xyz"]))
    return is_distance_less(points, t, limit).agg(F.coalesce(F.min("less"), F.lit(True)).alias("less"))
