"""Indexes of points and of labelled cells as tables, and the closest cells of targets.

A point index is rows (id, x, y, z, cell, data); a cell index is rows (cell, label). Adding and removing are unions and anti joins;
iterating is sorting by the cell. Ranges are the stretches of the curve between the borders of indexed cells: all leaves of one
have the same cells around them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphera.functions import cells
from sphera.functions.points import Vec
from sphera.operators import edge_distance as ed
from sphera.operators.joins import balanced_join, cells_intersecting, levels_of, with_ancestors
from sphera.operators.lineage import cut_lineage
from sphera.operators.unions import first_leaf, leaves

LEAVES = 6 << 58  # on the whole curve, in units of four leaves


# --- points ------------------------------------------------------------------------------------------


def point_index(points: DataFrame) -> DataFrame:
    """points (id, x, y, z and any data) with their leaf cell; the order of the index is by cell."""
    return cells.encode(points, Vec.named())


def add_points(index: DataFrame, more: DataFrame) -> DataFrame:
    return index.unionByName(point_index(more))


def remove_points(index: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Without the rows whose keys (the id, by default) are in the other table."""
    keys = keys or ("id",)
    return index.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def clear(index: DataFrame) -> DataFrame:
    return index.limit(0)


def num_points(index: DataFrame) -> int:
    return index.count()


def seek(index: DataFrame, target: int, n: int) -> DataFrame:
    """The first n points at or after a cell, in the order of the curve."""
    return index.where(cells.curve_order(F.col("cell")) >= cells.curve_order(F.lit(target))).orderBy(cells.curve_order(F.col("cell")), "id").limit(n)


def in_region(found: DataFrame, cover: DataFrame, leaf: str, cell: str) -> DataFrame:
    """Rows whose point lies in the cells of a region."""
    from sphera.operators.joins import points_in_cells

    return points_in_cells(found, cover, leaf, cell, "left_semi")


# --- labelled cells ----------------------------------------------------------------------------------


def cell_index(cells_: DataFrame, cell: str = "cell", label: str = "label") -> DataFrame:
    """cell, label: valid cells, in any order, repeats allowed."""
    return cells_.select(F.col(cell).alias("cell"), F.col(label).alias("label")).where(cells.is_valid(F.col("cell")))


def add_union(index: DataFrame, union: DataFrame, label) -> DataFrame:
    """All cells of a union under one label."""
    return index.unionByName(union.select("cell", F.lit(label).cast(index.schema["label"].dataType).alias("label")))


def ranges(index: DataFrame) -> DataFrame:
    """face, low, high (numbers of leaves along the curve, high beyond the last) and depth, how many indexed cells hold the range.

    Every border of a cell begins a range; running depths are added up face by face, so no task sees more than a face.
    """
    low = first_leaf(F.col("cell"))
    marks = index.select(cells.face(F.col("cell")).alias("face"), F.inline(F.array(F.struct(low.alias("low"), F.lit(1).alias("d")), F.struct((low + leaves(F.col("cell"))).alias("low"), F.lit(-1).alias("d")))))
    whole = F.lit(1 << 60)
    ends = index.sparkSession.range(6).select(F.col("id").cast("bigint").alias("face"), (F.col("id") * whole).alias("low"), F.lit(0).alias("d"))
    marks = marks.unionByName(ends).groupBy("face", "low").agg(F.sum("d").alias("d"))
    own = Window.partitionBy("face").orderBy("low")
    run = marks.withColumns({"depth": F.sum("d").over(own), "high": F.coalesce(F.lead("low").over(own), (F.col("face") + 1) * whole)})
    return run.where("low < high").select("face", "low", "high", "depth")


def non_empty_ranges(index: DataFrame) -> DataFrame:
    return ranges(index).where("depth > 0")


def contents(index: DataFrame, ranges_: DataFrame) -> DataFrame:
    """low, cell, label: the indexed cells that hold each range (a range is never wider than a cell that meets it)."""
    leaf = F.shiftleft("low", 1).bitwiseOR(F.lit(1))
    at = ranges_.withColumn("__leaf", leaf)
    return with_ancestors(at, "__leaf", levels_of(index, "cell"), "__a").join(index.withColumnRenamed("cell", "__a"), "__a").select("low", F.col("__a").alias("cell"), "label")


def intersecting_labels(index: DataFrame, targets: DataFrame, cell: str, key: str) -> DataFrame:
    """key, label: labels of indexed cells that meet each target cell, each once."""
    own = targets.select(key, F.col(cell).alias("__t")).distinct()
    found = cut_lineage(cells_intersecting(own.select("__t").distinct(), index.select("cell", "label").distinct(), "__t", "cell").select("__t", "label").distinct())
    return _each_once(balanced_join(own, found, "__t").select(key, "label"), (own, key))


def _each_once(rows: DataFrame, *sides: tuple[DataFrame, str]) -> DataFrame:
    """rows without repeats, which can only be where a side (distinct rows of a key and a cell) has a key twice: else none are compared."""
    if all(df.groupBy(key).count().where("count > 1").isEmpty() for df, key in sides):
        return rows
    return rows.distinct()


def tolerant_join(left: DataFrame, right: DataFrame, tolerance: float, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of cells whose distance is at most an angle; 0: those that meet. left, right: a / b + id, cell.

    Cells near each other have sides near each other; pairs of which one holds the other are joined by their ids.
    """
    left, right = left.select(f"{a}id", f"{a}cell").distinct(), right.select(f"{b}id", f"{b}cell").distinct()
    # each cell once, whatever number of ids it has
    one, two = cut_lineage(left.select(f"{a}cell").distinct()), cut_lineage(right.select(f"{b}cell").distinct())
    pairs = cells_intersecting(one, two, f"{a}cell", f"{b}cell").select(f"{a}cell", f"{b}cell")
    if tolerance > 0:
        q = ed.cell_targets(one, f"{a}cell", f"{a}cell")
        t = ed.cell_targets(two, f"{b}cell", f"{b}cell")
        t = t.withColumnsRenamed({c: "t" + c[1:] for c in t.columns})
        pairs = pairs.unionByName(ed.within(q, t, tolerance).select(F.col("q_id").alias(f"{a}cell"), F.col("t_id").alias(f"{b}cell")))
    pairs = cut_lineage(pairs.distinct())
    found = balanced_join(balanced_join(left, pairs, f"{a}cell"), right, f"{b}cell")
    return _each_once(found.select(f"{a}id", f"{b}id"), (left, f"{a}id"), (right, f"{b}id"))


def estimate_covered_cells(index: DataFrame, at: int) -> DataFrame:
    """One row: how many cells of a level the indexed cells meet, as if they did not overlap."""
    own = cells.level(F.col("cell"))
    return index.agg(F.coalesce(F.sum(F.pow(F.lit(4.0), F.greatest(F.lit(0), at - own))), F.lit(0.0)).alias("cells"))


# --- closest cells -------------------------------------------------------------------------------------


def _sides(index: DataFrame) -> DataFrame:
    """t_ edges of the cells, t_id the label."""
    t = ed.cell_targets(index, "label", "cell")
    return t.withColumnsRenamed({c: "t" + c[1:] for c in t.columns})


def _holding(q: DataFrame, index: DataFrame) -> DataFrame:
    """q_id, t_id of targets that begin in an indexed cell: at distance 0."""
    from sphera.operators.joins import points_in_cells

    at = cells.encode(q.select("q_id", *[F.col(f"q_a{a}") for a in "xyz"]), Vec.named("q_a"), "__leaf")
    return points_in_cells(at, index.select(F.col("label").alias("t_id"), F.col("cell").alias("__cell")), "__leaf", "__cell").select("q_id", "t_id").distinct()


def closest_cells(q: DataFrame, index: DataFrame, k: int = 1, max_distance: float = 3.141592653589793, target_cells: DataFrame | None = None) -> DataFrame:
    """The k closest labels of each target (rows of edges as in `edge_distance`), with distance and rank; cells that hold a part of the target, or are in it, are at 0.

    target_cells: q_id, cell of targets that are cells, so that indexed cells inside them count too.
    """
    # of a cell's labels no others than the first k can be among the k closest
    index = index.select("cell", "label").distinct().withColumn("__k", F.row_number().over(Window.partitionBy("cell").orderBy("label"))).where(F.col("__k") <= k).drop("__k")
    touching = _holding(q, index)
    if target_cells is not None:
        inside = cells_intersecting(target_cells.select("q_id", F.col("cell").alias("__t")), index.withColumnRenamed("label", "t_id"), "__t", "cell").select("q_id", "t_id")
        touching = touching.unionByName(inside).distinct()
    return ed.closest(q, _sides(index), k, max_distance, touching=touching)


def closest_cells_brute_force(q: DataFrame, index: DataFrame, k: int = 1) -> DataFrame:
    """The same from every pair."""
    found = ed.closest_brute_force(q, _sides(index), 1 << 30).drop("rank").unionByName(_holding(q, index).withColumn("distance", F.lit(0.0)))
    found = found.groupBy("q_id", "t_id").agg(F.min("distance").alias("distance"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "t_id"))).where(F.col("rank") <= k)


def is_cell_distance_less(q: DataFrame, index: DataFrame, limit: float) -> DataFrame:
    """q_id, less: whether any indexed cell is nearer than the limit."""
    found = closest_cells(q, index, 1, limit).where(F.col("distance") < limit).select("q_id").withColumn("less", F.lit(True))
    return q.select("q_id").distinct().join(found, "q_id", "left").select("q_id", F.coalesce("less", F.lit(False)).alias("less"))
