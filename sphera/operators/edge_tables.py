"""Shapes as tables of edges: one row an edge, so that a shape may be of any size and any task holds a part of it.

Columns: shape (bigint), dim (0 points, 1 polylines, 2 polygons), chain, edge (its number in the chain), and the ends ax..az, bx..bz
(points: both the same). A polygon's inside is on the left of its edges. Measures are sums over edges, so they
add up before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphera.functions import cells, edges
from sphera.functions.cellshape import edge_latitudes
from sphera.functions.points import Vec, angle, ortho

PI = math.pi
ENDS = [f"{p}{a}" for p in "ab" for a in "xyz"]
COLUMNS = ["shape", "dim", "chain", "edge", *ENDS]


def a_end() -> Vec:
    """Where edges begin."""
    return Vec.named("a")


def b_end() -> Vec:
    return Vec.named("b")


def _of_array(df: DataFrame, vertices: str, dim: int, last: Column) -> DataFrame:
    """Edges of an array of vertices (structs x, y, z) per row; last: the vertex after the last one, null for none."""
    n = F.size(vertices)
    df = df.select("shape", "chain", F.posexplode(vertices).alias("edge", "__a"), F.col(vertices).alias("__all"), last.alias("__last"), n.alias("__n"))
    after = F.when(F.col("edge") + 1 < F.col("__n"), F.get("__all", F.col("edge") + 1)).otherwise(F.col("__last"))
    df = df.withColumn("__b", after).where("__b is not null")
    ends = [F.col(f"__{p}")[a].alias(f"{p}{a}") for p in "ab" for a in "xyz"]
    return df.select("shape", F.lit(dim).alias("dim"), "chain", "edge", *ends)


def of_loops(df: DataFrame, vertices: str = "vertices") -> DataFrame:
    """Edges of loops: shape, chain and an array of vertex structs a row; the last vertex joins the first. A loop of one vertex has one edge of no length."""
    return _of_array(df, vertices, 2, F.get(vertices, F.lit(0)))


def of_polylines(df: DataFrame, vertices: str = "vertices") -> DataFrame:
    return _of_array(df, vertices, 1, F.lit(None))


def of_closed_polylines(df: DataFrame, vertices: str = "vertices") -> DataFrame:
    """As of_loops, without an inside."""
    return of_loops(df, vertices).withColumn("dim", F.lit(1))


def of_points(df: DataFrame) -> DataFrame:
    """shape, x, y, z: one edge without length a point; each is a chain of its own, in the order of the coordinates."""
    chain = (F.row_number().over(Window.partitionBy("shape").orderBy("x", "y", "z")) - 1).cast("int")
    return df.select("shape", F.lit(0).alias("dim"), chain.alias("chain"), F.lit(0).alias("edge"), *[F.col(a).alias(f"{p}{a}") for p in "ab" for a in "xyz"])


def of_tracks(points: DataFrame, shape: str, *order: str) -> DataFrame:
    """Polylines from rows of points: each row with the next in order; no array of a whole track is built."""
    own = Window.partitionBy(shape).orderBy(*order)
    df = points.withColumns({f"b{a}": F.lead(a).over(own) for a in "xyz"} | {"edge": F.row_number().over(own) - 1}).where("bx is not null")
    return df.select(F.col(shape).alias("shape"), F.lit(1).alias("dim"), F.lit(0).alias("chain"), "edge", *[F.col(a).alias(f"a{a}") for a in "xyz"], *[f"b{a}" for a in "xyz"])


def reversed_chains(table: DataFrame) -> DataFrame:
    """Every chain walked the other way: polylines backwards, polygons turned inside out (their complement)."""
    most = Window.partitionBy("shape", "chain")
    return table.withColumn("edge", F.max("edge").over(most) - F.col("edge")).withColumnsRenamed({f"{p}{a}": f"__{q}{a}" for p, q in ("ab", "ba") for a in "xyz"}).withColumnsRenamed({f"__{p}": p for p in ENDS}).select(*COLUMNS)


# --- counts and places --------------------------------------------------------------------------


def counts(table: DataFrame) -> DataFrame:
    """shape, dim, num_edges, num_chains, num_vertices."""
    ends = F.count("*") + F.when(F.max("dim") == 1, F.sum(F.when((F.col("edge") == F.col("__most")) & ~_closes(), 1).otherwise(0))).otherwise(0)
    own = Window.partitionBy("shape", "chain")
    df = table.withColumns({"__most": F.max("edge").over(own), **{f"__f{a}": F.min_by(f"a{a}", "edge").over(own) for a in "xyz"}})
    return df.groupBy("shape").agg(F.max("dim").alias("dim"), F.count("*").alias("num_edges"), F.countDistinct("chain").alias("num_chains"), ends.alias("num_vertices"))


def _closes() -> Column:
    """Whether an edge ends where its chain began (columns __fx..)."""
    return (F.col("bx") == F.col("__fx")) & (F.col("by") == F.col("__fy")) & (F.col("bz") == F.col("__fz"))


def with_edge_ids(table: DataFrame) -> DataFrame:
    """table with edge_id, the edge's number in its shape: chains one after the other. chain and edge are its chain position."""
    sizes = table.groupBy("shape", "chain").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("shape").orderBy("chain").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shape", "chain", F.coalesce(before, F.lit(0)).alias("chain_start"), F.col("__size").alias("chain_length"))
    return table.join(starts, ["shape", "chain"]).withColumn("edge_id", F.col("chain_start") + F.col("edge"))


def with_neighbours(table: DataFrame) -> DataFrame:
    """table with prev and next: edge numbers before and after in the chain, round its end where the chain is closed, else null."""
    own = Window.partitionBy("shape", "chain")
    df = table.withColumns({"__n": F.max("edge").over(own) + 1, **{f"__f{a}": F.min_by(f"a{a}", "edge").over(own) for a in "xyz"}, **{f"__l{a}": F.max_by(f"b{a}", "edge").over(own) for a in "xyz"}})
    closed = (F.col("__lx") == F.col("__fx")) & (F.col("__ly") == F.col("__fy")) & (F.col("__lz") == F.col("__fz"))
    df = df.withColumns({
        "prev": F.when(F.col("edge") > 0, F.col("edge") - 1).when(closed, F.col("__n") - 1),
        "next": F.when(F.col("edge") + 1 < F.col("__n"), F.col("edge") + 1).when(closed, F.lit(0)),
    })
    return df.drop("__n", *[f"__{p}{a}" for p in "fl" for a in "xyz"])


def vertices(table: DataFrame) -> DataFrame:
    """shape, x, y, z: the distinct vertices of each shape."""
    return table.select("shape", F.explode(F.array(a_end().struct(), b_end().struct())).alias("v")).select("shape", "v.x", "v.y", "v.z").distinct()


# --- measures -----------------------------------------------------------------------------------


def _first_vertex(table: DataFrame) -> DataFrame:
    own = Window.partitionBy("shape", "chain")
    return table.withColumns({f"__o{a}": F.min_by(f"a{a}", "edge").over(own) for a in "xyz"})


def lengths(table: DataFrame) -> DataFrame:
    """shape, chain, length: of a polyline, or the perimeter of a loop."""
    return table.groupBy("shape", "chain").agg(F.sum(angle(a_end(), b_end())).alias("length"))


def chain_areas(table: DataFrame) -> DataFrame:
    """shape, chain, signed_area (negative for a loop that is the smaller way round a hole) and area (of its left, 0 to 4 pi)."""
    df = _first_vertex(table.where("dim = 2"))
    part = edges.signed_area(Vec.named("__o"), a_end(), b_end())
    df = df.groupBy("shape", "chain").agg(F.sum(F.when(F.col("edge") > 0, part).otherwise(0.0)).alias("__s"))
    whole = F.pmod(F.col("__s"), F.lit(4 * PI))
    return df.select("shape", "chain", F.when(whole > 2 * PI, whole - 4 * PI).otherwise(whole).alias("signed_area"), whole.alias("area"))


def areas(table: DataFrame) -> DataFrame:
    """shape, area of polygons whose holes run clockwise."""
    return chain_areas(table).groupBy("shape").agg(F.sum("signed_area").alias("__s")).select("shape", F.when(F.col("__s") < 0, F.col("__s") + 4 * PI).otherwise(F.col("__s")).alias("area"))


def approx_areas(table: DataFrame) -> DataFrame:
    """shape, area by flat triangles from the first vertex: quicker, for small shapes."""
    df = _first_vertex(table.where("dim = 2"))
    o = Vec.named("__o")
    n = a_end().minus(o).cross(b_end().minus(o))
    flat = 0.5 * n.norm() * F.signum(n.dot(o))
    return df.groupBy("shape").agg(F.sum(flat).alias("area"))


def curvatures(table: DataFrame) -> DataFrame:
    """shape, chain, curvature: the sum of turns at the vertices; 2 pi less the area. max_error: what rounding can add, by the number of vertices."""
    own = Window.partitionBy("shape", "chain").orderBy("edge")
    all_ = Window.partitionBy("shape", "chain")
    df = table.withColumns({f"__c{a}": F.coalesce(F.lead(f"b{a}").over(own), F.min_by(f"b{a}", "edge").over(all_)) for a in "xyz"})
    turn = edges.turn_angle(a_end(), b_end(), Vec.named("__c"))
    return df.groupBy("shape", "chain").agg(F.sum(turn).alias("curvature"), (F.count("*") * F.lit(9.73 * 2.220446049250313e-16 / 2)).alias("max_error"))


def centroids(table: DataFrame) -> DataFrame:
    """shape, x, y, z: true centroids times measure: points by number, polylines by length, polygons by area."""
    n = a_end().cross(b_end())
    size = n.norm()
    half = F.when(size > 0, 0.5 * angle(a_end(), b_end()) / size).otherwise(0.0)
    line = edges.true_centroid(a_end(), b_end())
    parts = [F.sum(F.when(F.col("dim") == 0, p).when(F.col("dim") == 1, l).otherwise(c * half)).alias(a) for a, p, l, c in zip("xyz", a_end(), line, n, strict=True)]
    return table.groupBy("shape").agg(*parts)


def surface_integral(table: DataFrame, f, total) -> DataFrame:
    """shape, chain and the sum over each loop's triangles from its first vertex of f(a, b, c), a Column; total: how to add it up (F.sum)."""
    df = _first_vertex(table.where("dim = 2"))
    return df.where("edge > 0").groupBy("shape", "chain").agg(total(f(Vec.named("__o"), a_end(), b_end())).alias("integral"))


def bounds(table: DataFrame) -> DataFrame:
    """shape, lat_lo, lat_hi, lng_lo, lng_hi (radians) of what the edges cover: latitudes of their highest and lowest points, longitudes followed along each chain.

    A chain that goes round a pole has all longitudes; the poles inside polygons are not looked for. Several chains: the
    hull of their longitudes that leaves out the largest gap is not sought; it is that of the widest chain if they nest, else all.
    """
    high, low = edge_latitudes(a_end(), b_end())
    step = F.atan2(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx"), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"))
    df = cells.fenced(table, {"__high": high, "__low": low, "__step": step, "__lng": F.atan2("ay", "ax")})
    own = Window.partitionBy("shape", "chain")
    run = F.sum("__step").over(own.orderBy("edge"))
    df = df.withColumns({"__run": run, "__from": F.min_by("__lng", "edge").over(own)})
    one = df.groupBy("shape", "chain").agg(F.max("__high").alias("hi"), F.min("__low").alias("lo"), F.least(F.min("__run"), F.lit(0.0)).alias("west"), F.greatest(F.max("__run"), F.lit(0.0)).alias("east"), F.first("__from").alias("start"))
    one = one.withColumns({"west": F.col("start") + F.col("west"), "east": F.col("start") + F.col("east")})
    # all chains seen from the middle of the widest
    pick = F.max_by(F.col("west") + F.col("east"), F.col("east") - F.col("west")).over(Window.partitionBy("shape")) / 2
    one = one.withColumn("__mid", pick)
    shift = 2 * PI * F.rint((F.col("__mid") - (F.col("west") + F.col("east")) / 2) / (2 * PI))
    one = one.withColumns({"west": F.col("west") + shift, "east": F.col("east") + shift})
    out = one.groupBy("shape").agg(F.min("lo").alias("lat_lo"), F.max("hi").alias("lat_hi"), F.min("west").alias("w"), F.max("east").alias("e"))
    full = F.col("e") - F.col("w") >= 2 * PI - 1e-15
    turned = lambda x: F.atan2(F.sin(x), F.cos(x))
    return out.select("shape", "lat_lo", "lat_hi", F.when(full, -PI).otherwise(turned(F.col("w"))).alias("lng_lo"), F.when(full, PI).otherwise(turned(F.col("e"))).alias("lng_hi"))


# --- vertices inside their polygon ---------------------------------------------------------------


def contains_vertex(table: DataFrame) -> DataFrame:
    """shape, x, y, z, contains: whether a polygon holds its own vertex, so that of polygons that share it and tile its surroundings just one does.

    It does if it holds the first step from the vertex in the direction `ortho`: if the next edge counterclockwise from there comes in.
    Edges that go out and come in along the same line cancel.
    """
    out = table.where("dim = 2").select("shape", a_end().struct().alias("v"), b_end().struct().alias("w"), F.lit(1).alias("way"))
    into = table.where("dim = 2").select("shape", b_end().struct().alias("v"), a_end().struct().alias("w"), F.lit(-1).alias("way"))
    rays = out.unionByName(into).where("v <> w").groupBy("shape", "v", "w").agg(F.sum("way").alias("way")).where("way <> 0")
    v, w = Vec.of("v"), Vec.of("w")
    ref = ortho(v)
    turn = F.pmod(F.atan2(v.cross(ref).dot(w), ref.dot(w)), F.lit(2 * PI))
    rays = cells.fenced(rays, {"turn": turn})
    found = rays.groupBy("shape", "v").agg((F.min_by("way", "turn") < 0).alias("contains"))
    return found.select("shape", "v.x", "v.y", "v.z", "contains")


def reference_points(table: DataFrame) -> DataFrame:
    """shape, x, y, z, contained: a point and whether the shape holds it: for polygons their first vertex, for others any point, outside."""
    first = table.groupBy("shape").agg(F.max("dim").alias("dim"), F.min_by(a_end().struct(), F.struct("chain", "edge")).alias("v"))
    held = contains_vertex(table).select("shape", F.struct("x", "y", "z").alias("v"), "contains")
    return first.join(held, ["shape", "v"], "left").select("shape", "v.x", "v.y", "v.z", (F.coalesce("contains", F.lit(False)) & (F.col("dim") == 2)).alias("contained"))


def winding(table: DataFrame, points: DataFrame, q: str = "q_") -> DataFrame:
    """Every point against every polygon, by the angle under which it sees the edges: the brute-force form of containment.

    points: q + id, x, y, z. Returns q_id, shape, turns (how often the boundary winds round the point, less how often round its antipode).
    """
    p = Vec.named(q)
    ca, cb = p.cross(a_end()), p.cross(b_end())
    seen = F.atan2(p.dot(ca.cross(cb)), ca.dot(cb))
    pairs = points.crossJoin(F.broadcast(table.where("dim = 2")))
    return pairs.groupBy(f"{q}id", "shape").agg(F.rint(F.sum(seen) / (2 * PI)).cast("int").alias("turns"))


def to_polyline(table: DataFrame) -> DataFrame:
    """shape, vertices: an array of the vertices of each polyline, for shapes that fit a task."""
    parts = F.array_sort(F.collect_list(F.struct("chain", "edge", a_end().struct().alias("a"), b_end().struct().alias("b"))))
    df = table.groupBy("shape").agg(parts.alias("e"))
    last = F.element_at("e", -1)["b"]
    return df.select("shape", F.concat(F.transform("e", lambda x: x["a"]), F.array(last)).alias("vertices"))


def to_polygon(table: DataFrame) -> DataFrame:
    """shape, loops: an array of each chain's vertices, for shapes that fit a task."""
    own = table.groupBy("shape", "chain").agg(F.array_sort(F.collect_list(F.struct("edge", a_end().struct().alias("a")))).alias("e"))
    loops = F.array_sort(F.collect_list(F.struct("chain", F.transform("e", lambda x: x["a"]).alias("loop"))))
    return own.groupBy("shape").agg(loops.alias("l")).select("shape", F.transform("l", lambda x: x["loop"]).alias("loops"))
