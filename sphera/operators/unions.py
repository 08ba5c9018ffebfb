"""Set algebra over cell unions kept as rows (keys, cell).

A cell is a run of leaves, numbered along the curve, so unions combine as ranges: boundaries are
swept in order with running counts of both sides, stretches that satisfy the operation are merged
with their neighbours, and each is cut into the largest cells that fit, level by level. Results are
normalized: disjoint, sorted by `cells.curve_order`, no four siblings together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphera.functions import cells
from sphera.operators.joins import cells_intersecting, with_ancestors

LEAVES = 6 << 60


def first_leaf(cell: Column) -> Column:
    """Number of the cell's first leaf along the curve; a bigint below 6 * 4**30."""
    return F.shiftrightunsigned(cells.range_min(cell), 1)


def leaves(cell: Column) -> Column:
    """How many leaves a cell has; a bigint."""
    return cells.lsb(cell)


def tiles(ranges: DataFrame, low: str = "low", high: str = "high", out: str = "cell") -> DataFrame:
    """The fewest cells of each range of leaves [low, high): a row each, in place of the two columns.

    At every level finer than the coarsest that fits, cells stand only before the first and after the
    last place where the next coarser ones fit.
    """
    keep = [c for c in ranges.columns if c not in (low, high)]
    df = ranges.where(F.col(low) < F.col(high)).select("*", F.explode_outer(F.sequence(F.lit(0), F.lit(30))).alias("__l"))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), (2 * (30 - F.col("__l"))).cast("int"))
    # aligned places by bits: a division would round
    ceil = lambda c, s: (F.col(c) + (s - 1)).bitwiseAND(-s)
    floor = lambda c, s: F.col(c).bitwiseAND(-s)
    coarse = F.when(F.col("__l") > 0, 4 * size)
    df = df.withColumns({"__s": size, "__a": ceil(low, size), "__b": floor(high, size), "__ac": ceil(low, coarse), "__bc": floor(high, coarse)})
    last = F.col("__b") - F.col("__s")
    run = lambda a, b: F.when(b >= a, F.sequence(a, b, F.col("__s"))).otherwise(F.array().cast("array<bigint>"))
    nested = F.col("__ac") < F.col("__bc")  # a coarser cell fits
    both = F.concat(run(F.col("__a"), F.col("__ac") - F.col("__s")), run(F.col("__bc"), last))
    starts = F.when(F.col("__a") >= F.col("__b"), F.array().cast("array<bigint>")).when(nested, both).otherwise(run(F.col("__a"), last))
    # where no coarser cell fits but the coarse bounds cross, a still coarser level can't fit either
    df = df.select(*keep, F.col("__s"), F.explode_outer(starts).alias("__d")).where("__d is not null")
    return df.select(*keep, F.shiftleft("__d", 1).bitwiseOR(F.col("__s")).alias(out))


def _ranges(df: DataFrame, keys: list[str], cell: str, side: str) -> DataFrame:
    low = first_leaf(F.col(cell))
    each = F.array(F.struct(low.alias("at"), F.lit(1).alias("d")), F.struct((low + leaves(F.col(cell))).alias("at"), F.lit(-1).alias("d")))
    zero = F.lit(0)
    rows = df.where(F.col(cell) != 0).select(*keys, F.inline_outer(each))
    return rows.select(*keys, "at", (F.col("d") if side == "a" else zero).alias("a"), (F.col("d") if side == "b" else zero).alias("b"))


def combine(left: DataFrame, right: DataFrame | None, keys: list[str], how: str, cell: str = "cell") -> DataFrame:
    """keys, cell: union, intersection or difference by key. Boundaries are summed before the sweep, so repeated cells cost nothing there."""
    rows = _ranges(left, keys, cell, "a")
    if right is not None:
        rows = rows.unionByName(_ranges(right, keys, cell, "b"))
    steps = rows.groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> 0 or b <> 0")
    order = Window.partitionBy(*keys).orderBy("at")
    swept = steps.select(*keys, "at", F.sum("a").over(order).alias("a"), F.sum("b").over(order).alias("b"))
    inside = {"union": "a > 0 or b > 0", "intersection": "a > 0 and b > 0", "difference": "a > 0 and b = 0"}[how]
    flagged = swept.withColumn("in", F.expr(inside))
    edges = flagged.withColumn("was", F.coalesce(F.lag("in").over(order), F.lit(False))).where("in <> was")
    merged = edges.withColumn("high", F.lead("at").over(order)).where("in").select(*keys, F.col("at").alias("low"), "high")
    return tiles(merged, out=cell)


def normalize(df: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    return combine(df, None, keys, "union", cell)


def denormalize(df: DataFrame, min_level: int, level_mod: int = 1, cell: str = "cell") -> DataFrame:
    """Each cell as its descendants of the next level that is at least min_level and a multiple of level_mod above it."""
    at = F.greatest(F.lit(min_level), cells.level(F.col(cell)))
    up = F.least(F.lit(30), at + F.pmod(min_level - at, F.lit(level_mod)))
    df = df.withColumn("__n", cells.lsb_for_level(up))
    # the last leaf of face 3 is the largest bigint, the first of face 4 next to the least: no sum may go beyond them
    low, high = cells.range_min(F.col(cell)) + (F.col("__n") - 1), cells.range_max(F.col(cell)) - (F.col("__n") - 1)
    out = F.explode_outer(F.sequence(low, high, F.shiftleft("__n", 1)))
    return df.withColumn("__c", out).withColumn(cell, F.col("__c")).drop("__c", "__n")


def contains(unions: DataFrame, probes: DataFrame, keys: list[str], cell: str, probe: str) -> DataFrame:
    """probes with `contained`: whether the (normalized) union of the same keys has the cell or an ancestor of it."""
    levels = list(range(31))
    up = with_ancestors(probes.select(*keys, probe).distinct(), probe, levels, "__a")
    hit = up.join(unions.select(*keys, F.col(cell).alias("__a")), [*keys, "__a"], "left_semi").select(*keys, probe).distinct().withColumn("contained", F.lit(True))
    return probes.join(hit, [*keys, probe], "left").withColumn("contained", F.coalesce("contained", F.lit(False)))


def intersecting(left: DataFrame, right: DataFrame, a: str = "cell", b: str = "other") -> DataFrame:
    return cells_intersecting(left, right, a, b)


def measures(df: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """keys, cells, leaf_count (decimal), area (of average cells, steradians) of normalized unions."""
    area = F.pow(F.lit(0.25), cells.level(F.col(cell))) * cells.AVG_AREA.deriv
    return df.groupBy(*keys).agg(F.count("*").alias("cells"), F.sum(leaves(F.col(cell)).cast("decimal(38,0)")).alias("leaf_count"), F.sum(area).alias("area"))


def from_range(df: DataFrame, low: str, high: str, out: str = "cell") -> DataFrame:
    """The union of the leaves low to high (ids, both included), as rows."""
    return tiles(df.withColumns({"low": F.shiftrightunsigned(low, 1), "high": F.shiftrightunsigned(high, 1) + 1}).drop(*[c for c in (low, high) if c not in ("low", "high")]), out=out)


def whole_sphere(spark) -> DataFrame:
    return spark.range(6).select(cells.from_face(F.col("id")).alias("cell"))


def expand(df: DataFrame, keys: list[str], at: int, cell: str = "cell") -> DataFrame:
    """The union with all cells of level `at` that touch it; cells below that level count as their ancestors there."""
    df = df.select(*keys, F.when(cells.level(F.col(cell)) > at, cells.parent(F.col(cell), at)).otherwise(F.col(cell)).alias(cell)).distinct()
    near = cells.all_neighbors(df, at, cell, "__n").select(*keys, F.col("__n").alias(cell))
    return normalize(df.unionByName(near), keys, cell)


# --- properties of unions -----------------------------------------------------------------------------


def validity(df: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """keys, valid (real cells, none of which holds another), normalized (valid, and no four siblings)."""
    order = Window.partitionBy(*keys).orderBy("__low", F.desc("__size"))
    rows = df.select(*keys, F.col(cell).alias("__c"), first_leaf(F.col(cell)).alias("__low"), leaves(F.col(cell)).alias("__size"))
    rows = rows.withColumn("__end", F.max(F.col("__low") + F.col("__size")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    valid = cells.is_valid(F.col("__c")) & F.coalesce(F.col("__end") <= F.col("__low"), F.lit(True))
    four = rows.where(~cells.is_face(F.col("__c"))).groupBy(*keys, cells.parent(F.col("__c")).alias("__up")).agg(F.countDistinct("__c").alias("__k"))
    whole = four.groupBy(*keys).agg((F.max("__k") == 4).alias("__four"))
    out = rows.groupBy(*keys).agg(F.min(valid).alias("valid")).join(whole, keys, "left")
    return out.select(*keys, "valid", (F.col("valid") & ~F.coalesce("__four", F.lit(False))).alias("normalized"))


def areas(df: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """keys, exact_area, approx_area, average_area of disjoint cells."""
    from sphera.functions.cellshape import CellShape, with_shape

    s = CellShape.of("__shape")
    each = with_shape(df.select(*keys, F.col(cell).alias("__c")), "__c", "__shape").select(*keys, s.exact_area().alias("e"), s.approx_area().alias("a"), s.average_area().alias("g"))
    return each.groupBy(*keys).agg(F.sum("e").alias("exact_area"), F.sum("a").alias("approx_area"), F.sum("g").alias("average_area"))


def cap_bounds(df: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """keys, x, y, z, length2: a cap about the middle of the cells, weighted by area, that holds the caps about all of them."""
    from sphera.functions.cellshape import CellShape, with_shape
    from sphera.functions.points import Vec, chord2, chord2_sum

    s = CellShape.of("__shape")
    each = with_shape(df.select(*keys, F.col(cell).alias("__c")), "__c", "__shape")
    # vertices alone are not enough: a cap of over half the sphere may hold them and leave out a part of their cell
    each = each.select(*keys, s.average_area().alias("w"), s.mid.struct().alias("m"), s.cap_bound().length2.alias("own"))
    mid = each.groupBy(*keys).agg(*[F.sum(F.col("m")[a] * F.col("w")).alias(f"s{a}") for a in "xyz"])
    unit = Vec.named("s").normalized()
    mid = cells.fenced(mid, {"c": F.when(Vec.named("s").norm2() > 1e-20, unit.struct()).otherwise(Vec.lit(1, 0, 0).struct())})
    far = chord2_sum(chord2(Vec.of("c"), Vec.of("m")), F.col("own"))
    return each.join(mid.select(*keys, "c"), keys).groupBy(*keys, "c").agg(F.max(far).alias("length2")).select(*keys, "c.x", "c.y", "c.z", "length2")


def rect_bounds(df: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """keys, lat_lo, lat_hi, lng_lo, lng_hi: all latitudes, and the longitudes without the widest gap between cells."""
    from sphera.functions.cellshape import CellShape, with_shape

    two_pi = 6.283185307179586
    r = CellShape.of("__shape").rect_bound()
    each = with_shape(df.select(*keys, F.col(cell).alias("__c")), "__c", "__shape")
    each = cells.fenced(each, {"b": F.struct(r.lat.lo.alias("s"), r.lat.hi.alias("n"), r.lng.lo.alias("w"), r.lng.length().alias("l"))}).select(*keys, "b.*")
    order = Window.partitionBy(*keys).orderBy("w", F.desc("l"))
    # walking east, how far all before reach; the gap before each, and that from the last round to the first
    run = each.withColumn("east", F.max(F.col("w") + F.col("l")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ends = each.groupBy(*keys).agg(F.min("w").alias("first"), F.max(F.col("w") + F.col("l")).alias("last"), F.min("s").alias("lat_lo"), F.max("n").alias("lat_hi"), F.max("l").alias("widest"))
    gaps = run.where("east is not null and w > east").groupBy(*keys).agg(F.max(F.struct((F.col("w") - F.col("east")).alias("gap"), "w", "east")).alias("g"))
    out = ends.join(gaps, keys, "left")
    round_ = F.col("first") + two_pi - F.col("last")
    full = (F.col("widest") >= two_pi) | ((round_ <= 0) & F.col("g").isNull())
    inner = F.col("g.gap") > F.greatest(round_, F.lit(0.0))
    turned = lambda x: F.atan2(F.sin(x), F.cos(x))
    lo = F.when(full, -two_pi / 2).when(inner, turned(F.col("g.w"))).otherwise(turned(F.col("first")))
    hi = F.when(full, two_pi / 2).when(inner, turned(F.col("g.east"))).otherwise(turned(F.col("last")))
    return out.select(*keys, "lat_lo", "lat_hi", lo.alias("lng_lo"), hi.alias("lng_hi"))


def expanded(df: DataFrame, keys: list[str], radians: float, max_level_diff: int, cell: str = "cell") -> DataFrame:
    """keys, cell: with all cells within about an angle: neighbours on the finest level as wide as the angle, but no more than max_level_diff below a union's largest cell."""
    from sphera.operators.nearest import level_for_radius

    wide = max(0, min(30, level_for_radius(radians / 2))) if radians > 0 else 30
    top = df.groupBy(*keys).agg(F.min(cells.level(F.col(cell))).alias("__top"))
    rows = df.join(top, keys).withColumn("__at", F.least(F.lit(wide), F.col("__top") + max_level_diff))
    out = df.select(*keys, F.col(cell).alias("cell"))
    for at in [r[0] for r in rows.select("__at").distinct().collect()]:  # at most 31 numbers
        own = rows.where(F.col("__at") == at).select(*keys, F.when(cells.level(F.col(cell)) > at, cells.parent(F.col(cell), int(at))).otherwise(F.col(cell)).alias("__c")).distinct()
        out = out.unionByName(cells.all_neighbors(own, int(at), "__c", "cell").select(*keys, "cell")) if at > 0 else out
    return out.distinct()
