"""Nearest, furthest and within-distance queries over points, without a cross join.

Targets within a radius are found by cells: each query point's cap is covered by the cells of one
level that it can reach (the vertex neighbours of a cell at least twice as wide as the radius), which is an equi-join with the
targets' ancestors; the exact distance decides. For the k nearest, targets are counted by cell first: each query's radius comes from
any k targets of the finest cell about it that has so many, so that dense places are searched finely and sparse ones once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphera.functions import cells
from sphera.functions.edges import distance as edge_distance
from sphera.functions.points import Vec, chord2
from sphera.operators.joins import balanced_join, spread, with_ancestors
from sphera.operators.lineage import cut_lineage


def level_for_radius(radians: float) -> int:
    """The finest level whose cells are nowhere narrower than twice the radius; -1 where there is none.

    A point is at least half a cell inside the block of the four cells at its nearest vertex.
    """
    if radians <= 0:
        return 29
    return max(-1, min(29, math.floor(math.log2(cells.MIN_WIDTH.deriv / (2 * radians)))))


#: Candidates that two tables may make by the plain join on four cells.
PLAIN = 1 << 23


def within(queries: DataFrame, targets: DataFrame, radians: float, q: str = "q_", t: str = "t_") -> DataFrame:
    """Pairs within an angle, with `d2`, the squared chord. Both sides need prefix + x, y, z, cell (leaf); queries prefix + id.

    Where the four cells of a cap would make many pairs that are not within, the smaller side's caps are covered by small cells instead.
    """
    at = level_for_radius(radians)
    limit = (2 * math.sin(min(math.pi, radians) / 2)) ** 2
    d2 = chord2(Vec.named(q), Vec.named(t))
    nq, nt = queries.count(), targets.count()
    if at > 20 or nq * nt * min(1.0, 8 * radians**2) <= PLAIN:
        if at < 1:
            near = queries.withColumn("__n", F.explode_outer(F.array(*[F.lit(f) for f in _faces()])))
            joined = near.join(targets.withColumn("__n", cells.from_face(cells.face(F.col(f"{t}cell")))), "__n")
        else:
            near = cells.vertex_neighbors(queries, at, f"{q}cell", "__n")
            joined = near.join(targets.withColumn("__n", cells.parent(F.col(f"{t}cell"), at)), "__n")
    else:
        small, large, s, b = (queries, targets, q, t) if nq <= nt else (targets, queries, t, q)
        joined = balanced_join(large.withColumn("__n", cells.parent(F.col(f"{b}cell"), fine_level(F.lit(radians)))), cap_cells(spread(small, f"{s}id"), F.lit(radians), s, "__n"), "__n").select("__n", *queries.columns, *targets.columns)
    return joined.drop("__n").withColumn("d2", d2).where(F.col("d2") <= limit)


def within_own(queries: DataFrame, targets: DataFrame, radians: str, q: str = "q_", t: str = "t_") -> DataFrame:
    """Candidate pairs of a query and a target within the angle in the query's column `radians`: by small cells of a level for each size of angle, so few are not within. Each pair once."""
    levels = sorted(r[0] for r in queries.select(fine_level(F.col(radians)).alias("l")).where("l is not null").distinct().collect())  # at most 31 numbers
    return balanced_join(with_ancestors(targets, f"{t}cell", levels, "__n"), cap_cells(queries, F.col(radians), q, "__n"), "__n").drop("__n")


def fine_level(radians: Column) -> Column:
    """A level of which some hundred cells cover a cap, most of them wholly inside it."""
    return F.greatest(F.lit(0), F.least(F.lit(cells.MAX_LEVEL), F.ceil(F.log2(F.lit(cells.AVG_DIAG.deriv / 2 / 0.25) / F.greatest(radians, F.lit(1e-9)))))).cast("int")


def cap_cells(df: DataFrame, radians: Column, prefix: str, out: str) -> DataFrame:
    """A row for each cell of the cap's fine level that may meet the cap about prefix + x, y, z (with leaf prefix + cell).

    From the four cells about the nearest vertex of the level that is wide enough (all faces, if none is), down in three steps, without the cells whose middle is further than the angle and the cell's own reach.
    """
    df = df.withColumns({"__r": radians, "__fine": fine_level(radians)}).withColumn("__at", F.greatest(F.lit(0), level_for_chord(F.pow(2 * F.sin(F.least(F.lit(math.pi), F.col("__r")) / 2), F.lit(2.0)))).cast("int"))
    df = df.withColumn("__at", F.least("__at", "__fine"))
    wide = df.where("__at < 1").withColumn(out, F.explode(F.array(*[F.lit(f) for f in _faces()])))
    df = cells.vertex_neighbors(df.where("__at >= 1"), F.col("__at"), f"{prefix}cell", out).unionByName(wide)
    for step in (2, 2, 1):
        # a middle is at most half a diagonal from its cell's corners, and a tenth more on coarse levels
        to = F.least(F.col("__fine"), F.col("__at") + step)
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), (2 * (cells.MAX_LEVEL - to)).cast("int"))
        df = df.withColumns({out: F.explode(F.sequence(cells.range_min(F.col(out)) + (size - 1), cells.range_max(F.col(out)) - (size - 1), 2 * size)), "__at": to})
        df = cells.with_center(df, out, "__m")
        reach = F.least(F.lit(math.pi), F.col("__r") + 0.55 * cells.MAX_DIAG.deriv * F.pow(F.lit(2.0), -F.col("__at")))
        df = df.where(chord2(Vec.named(prefix), Vec.of("__m")) <= F.pow(2 * F.sin(reach / 2), F.lit(2.0))).drop("__m")
    return df.drop("__r", "__fine", "__at")


def _faces() -> list[int]:
    ids = [(f << 61) + (1 << 60) for f in range(6)]
    return [i - (1 << 64) if i >= 1 << 63 else i for i in ids]


def level_for_chord(d2: Column) -> Column:
    """level_for_radius of the angle of a squared chord, as a column."""
    radians = 2 * F.asin(F.least(F.lit(1.0), 0.5 * F.sqrt(d2)))
    return F.when(radians <= 0, 29).otherwise(F.greatest(F.lit(-1), F.least(F.lit(29), F.floor(F.log2(F.lit(cells.MIN_WIDTH.deriv / 2) / radians))))).cast("int")


#: Levels at which targets are counted.
_STEPS = tuple(range(0, 30, 3))


def _bounds(queries: DataFrame, targets: DataFrame, k: int, q: str, t: str) -> DataFrame:
    """queries with `__bound`, a squared chord within which each has k targets: the furthest of any k targets of the finest counted cell about it that has so many (4 if there are fewer than k in all).

    Dense places thus get small bounds and sparse ones large ones; of a cell no more than k targets are read.
    """
    leaf = F.col(f"{t}cell")
    up = lambda cell, at: F.when(cells.level(cell) >= at, cells.parent(cell, at))
    fine = targets.groupBy(cells.parent(leaf, _STEPS[-1]).alias("__c")).agg(F.count("*").alias("__n"))
    counts = fine.select("__n", F.explode(F.array(*[up(F.col("__c"), at) for at in _STEPS])).alias("__c")).groupBy("__c").agg(F.sum("__n").alias("__n")).where(F.col("__n") >= k).select("__c")
    path = queries.select(f"{q}id", F.explode(F.array(*[cells.parent(F.col(f"{q}cell"), at) for at in _STEPS])).alias("__c"))
    home = path.join(counts, "__c", "left_semi").groupBy(f"{q}id").agg(F.max_by("__c", cells.level(F.col("__c"))).alias("__home"))
    home = cut_lineage(home)
    levels = [r[0] for r in home.select(cells.level(F.col("__home")).alias("l")).distinct().collect()]  # at most len(_STEPS) numbers
    wanted = home.select(F.col("__home").alias("__c")).distinct()
    any_k = Window.partitionBy("__c").orderBy(f"{t}id")
    near = with_ancestors(targets.select(f"{t}id", *[f"{t}{a}" for a in "xyz"], f"{t}cell"), f"{t}cell", sorted(levels), "__c").join(wanted, "__c", "left_semi")
    few = near.withColumn("__r", F.row_number().over(any_k)).where(F.col("__r") <= k).select("__c", *[f"{t}{a}" for a in "xyz"])
    at_home = queries.select(f"{q}id", *[f"{q}{a}" for a in "xyz"]).join(home, f"{q}id").withColumnRenamed("__home", "__c").join(few, "__c")
    bound = at_home.groupBy(f"{q}id").agg((F.max(chord2(Vec.named(q), Vec.named(t))) * (1 + 1e-12) + 1e-30).alias("__bound"))
    return queries.join(bound, f"{q}id", "left").withColumn("__bound", F.least(F.lit(4.0), F.coalesce("__bound", F.lit(4.0))))


def nearest(queries: DataFrame, targets: DataFrame, k: int, q: str = "q_", t: str = "t_") -> DataFrame:
    """The k nearest targets of each query (ties by target id) with `d2` and `rank`. queries and targets as in within(), both with prefix + id; query ids are unique.

    Each query gets a bound that holds k targets, then one join by the cells that its bound reaches, on its own level; nothing is searched twice.
    """
    bounded = cut_lineage(_bounds(queries, targets, k, q, t).withColumn("__lev", level_for_chord(F.col("__bound"))))
    levels = [r[0] for r in bounded.select("__lev").distinct().collect()]  # at most 31 numbers
    reach = cells.vertex_neighbors(bounded.where("__lev >= 1"), F.col("__lev"), f"{q}cell", "__n")
    if min(levels, default=1) < 1:
        reach = reach.unionByName(bounded.where("__lev < 1").withColumn("__n", F.explode(F.array(*[F.lit(f) for f in _faces()]))))
    held = with_ancestors(targets, f"{t}cell", sorted({max(0, at) if at >= 1 else 0 for at in levels}), "__n")
    found = reach.join(held, "__n").drop("__n", "__lev").withColumn("d2", chord2(Vec.named(q), Vec.named(t))).where(F.col("d2") <= F.col("__bound")).drop("__bound")
    order = Window.partitionBy(f"{q}id").orderBy("d2", f"{t}id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def farthest(queries: DataFrame, targets: DataFrame, k: int, q: str = "q_", t: str = "t_") -> DataFrame:
    """The k furthest targets of each query: the nearest to its antipode. `d2` is the distance from the query itself."""
    anti = queries.withColumns({f"{q}{a}": -F.col(f"{q}{a}") for a in "xyz"})
    anti = cells.encode(anti.drop(f"{q}cell"), Vec.named(q), f"{q}cell")
    return nearest(anti, targets, k, q, t).withColumns({f"{q}{a}": -F.col(f"{q}{a}") for a in "xyz"}).withColumn("d2", 4 - F.col("d2"))


def directed_hausdorff(queries: DataFrame, targets: DataFrame, q: str = "q_", t: str = "t_") -> DataFrame:
    """One row: d2 of the query whose nearest target is furthest, and its id."""
    return nearest(queries, targets, 1, q, t).orderBy(F.desc("d2"), f"{q}id").limit(1).select(f"{q}id", "d2")


def angle(d2: Column) -> Column:
    return 2 * F.asin(0.5 * F.sqrt(d2))


def edges_within(queries: DataFrame, edges: DataFrame, radians: float, longest: float, q: str = "q_", t: str = "t_") -> DataFrame:
    """Pairs of a query point and an edge within an angle, with `distance`. Edges: t + id, ax..az, bx..bz, and x, y, z, cell of their middle.

    longest: no edge is longer; candidates are the middles within the angle and half of it.
    """
    near = within(queries, edges, min(math.pi, radians + longest / 2), q, t).drop("d2")
    near = cells.fenced(near, {"distance": edge_distance(Vec.named(q), Vec.named(f"{t}a"), Vec.named(f"{t}b"))})
    return near.where(F.col("distance") <= radians)


def closest_edges(queries: DataFrame, edges: DataFrame, k: int, longest: float, start: float, q: str = "q_", t: str = "t_") -> DataFrame:
    """The k closest edges of each query (ties by edge id) with `distance` and `rank`; as nearest(), with edges_within()."""
    order = Window.partitionBy(f"{q}id").orderBy("distance", f"{t}id")
    left, out, radius = queries, None, start
    while True:
        found = cut_lineage(edges_within(left, edges, radius, longest, q, t).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if radius >= math.pi:
            return found if out is None else out.unionByName(found)
        full = found.groupBy(f"{q}id").agg(F.count("*").alias("__c")).where(F.col("__c") >= k).select(f"{q}id")
        done = found.join(full, f"{q}id", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = left.join(full, f"{q}id", "left_anti")
        if left.isEmpty():
            return out
        radius = min(math.pi, 4 * radius)


def with_middles(edges: DataFrame, t: str = "t_") -> DataFrame:
    """edges (t + ax..az, bx..bz) with t + x, y, z, cell of their middle."""
    mid = Vec.named(f"{t}a").plus(Vec.named(f"{t}b")).normalized()
    return cells.encode(cells.fenced(edges, {f"{t}x": mid.x, f"{t}y": mid.y, f"{t}z": mid.z}), Vec.named(t), f"{t}cell")
