"""Queries that write values to text or bytes and read them back."""

import math

from pyspark.sql import functions as F

from sphera.functions import cells as c
from sphera.operators.joins import spread
from sphera.plans.base import cell_points, d_encode, d_parent, d_points, d_r6, points, query, r6, table
from sphera.sources import shapecoding as sc
from sphera.sources import textformat as tf

_E = d_points("ep", "events", "event_id", "user_id", "ts")


@query("code_uints", "WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey::BIGINT AS id, len(v)::BIGINT AS n, list_sum(v)::BIGINT AS total, v[1]::BIGINT AS first, len(list_filter(v, lambda x: x < 100))::BIGINT AS below FROM o")
def code_uints(spark, d):
    """Part numbers of each order, packed, then read: their number and sum, the first one, and how many are less than 100 by a search in the bytes."""
    df = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("bigint").alias("id")).agg(F.array_sort(F.collect_list("l_partkey")).alias("v"))
    packed = sc.column(lambda v: sc.encode_uints([int(x) for x in v]), "binary", F.col("v"))
    read = sc.column(lambda b: [len(p := sc.PackedUints(b)), sum(p.decode()), p[0], p.lower_bound(100)], "array<long>", F.col("b"))
    r = F.col("r")
    return df.withColumn("b", packed).withColumn("r", read).select("id", r[0].alias("n"), r[1].alias("total"), r[2].alias("first"), r[3].alias("below"))


_K = f"WITH {d_points('cp', 'customer', 'c_custkey', 'c_nationkey')}, {d_encode('t', 'cp')}, k AS (SELECT c_nationkey, {d_parent('cell', 9)} AS cell FROM t WHERE face < 4)"


@query("code_cells", f"{_K} SELECT c_nationkey::BIGINT AS id, count(*)::BIGINT AS n, max(cell) AS last, count(*) FILTER (cell < 4611686018427387904)::BIGINT AS below FROM k GROUP BY 1")
def code_cells(spark, d):
    """Level-9 cells of each nation's customers (on the first four faces), packed: their number, the last, and a search for a face's first cell."""
    df = cell_points(spark, d, "customer", "c_custkey", "c_nationkey").where(c.face(F.col("cell")) < 4)
    df = df.groupBy(F.col("c_nationkey").cast("bigint").alias("id")).agg(F.array_sort(F.collect_list(c.parent(F.col("cell"), 9))).alias("v"))
    packed = sc.column(lambda v: sc.encode_cell_vector([int(x) for x in v]), "binary", F.col("v"))
    read = sc.column(lambda b: [len(p := sc.PackedCells(b)), p[len(p) - 1], p.lower_bound(1 << 62)], "array<long>", F.col("b"))
    r = F.col("r")
    return df.withColumn("b", packed).withColumn("r", read).select("id", r[0].alias("n"), r[1].alias("last"), r[2].alias("below"))


@query("code_strings", "WITH o AS (SELECT c_nationkey, list(c_name ORDER BY c_custkey) AS v FROM customer GROUP BY 1) SELECT c_nationkey::BIGINT AS id, v[len(v)] AS last, array_to_string(v, '|') AS joined FROM o")
def code_strings(spark, d):
    """Names of each nation's customers as one vector of strings; the last by itself, and all again."""
    df = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]).alias("v"))

    def pack(v):
        out = sc.StringVector()
        for x in v:
            out.add(x)
        return out.encode()

    df = df.withColumn("b", sc.column(pack, "binary", F.col("v")))
    last = sc.column(lambda b: (p := sc.PackedStrings(b))[len(p) - 1].decode(), "string", F.col("b"))
    joined = sc.column(lambda b: "|".join(x.decode() for x in sc.PackedStrings(b)), "string", F.col("b"))
    return df.select("id", last.alias("last"), joined.alias("joined"))


def _tracks(spark, d):
    df = spread(points(spark, d, "events", "event_id", "user_id", "ts"), "user_id")
    track = F.array_sort(F.collect_list(F.struct("ts", "id", F.array("x", "y", "z").alias("p"))))
    return df.groupBy("user_id").agg(F.transform(track, lambda s: s["p"]).alias("track"))


@query("code_points", f"WITH {_E} SELECT user_id, count(*)::BIGINT AS n, {d_r6('sum(x)')} AS x, {d_r6('sum(y)')} AS y, {d_r6('sum(z)')} AS z, (2 + 24 * count(*))::BIGINT AS bytes FROM ep GROUP BY user_id")
def code_points(spark, d):
    """Each user's points, exactly: the sum of what is read."""
    df = _tracks(spark, d).withColumn("b", sc.column(lambda t: sc.encode_point_vector([tuple(map(float, p)) for p in t]), "binary", F.col("track")))
    read = sc.column(lambda b: [float(len(p := sc.PackedPoints(b))), *[math.fsum(q[i] for q in p) for i in range(3)]], "array<double>", F.col("b"))
    r = F.col("r")
    return df.withColumn("r", read).select("user_id", r[0].cast("bigint").alias("n"), *[r6(r[i + 1]).alias("xyz"[i]) for i in range(3)], F.when(r[0] < 128, F.length("b")).otherwise(F.length("b") - 1).cast("bigint").alias("bytes"))


@query("code_points_compressed", f"WITH {_E}, {d_encode('t', 'ep')} SELECT user_id, count(*)::BIGINT AS n, list(({d_parent('cell', 12)})::VARCHAR ORDER BY ts, id)[1] AS first, true AS small FROM t GROUP BY user_id")
def code_points_compressed(spark, d):
    """Each user's points moved to centres of level-12 cells, compressed: cells of what is read; fewer than 8 bytes a point."""

    from sphera.operators.cover import cell_at, center, signed

    def pack(t):
        return sc.encode_point_vector([center(cell_at(tuple(map(float, p)), 12)) for p in t], sc.COMPACT)

    df = _tracks(spark, d).withColumn("b", sc.column(pack, "binary", F.col("track")))
    read = sc.column(lambda b: [len(p := sc.PackedPoints(b)), signed(cell_at(p[0], 12))], "array<long>", F.col("b"))
    r = F.col("r")
    return df.withColumn("r", read).select("user_id", r[0].alias("n"), r[1].cast("string").alias("first"), (F.length("b") < 8 * F.size("track") + 8).alias("small"))


@query("code_shapes", f"WITH {_E} SELECT user_id, (3 * count(*) - 1)::BIGINT AS edges, {d_r6('sum(z)')} AS z, 3::BIGINT AS shapes FROM ep GROUP BY user_id")
def code_shapes(spark, d):
    """Each user's points as a set of points, a polyline and a loop, tagged and stored together: edges of all three, and the polyline's vertices."""

    def pack(t):
        p = [tuple(map(float, x)) for x in t]
        return sc.encode_tagged_shapes([sc.Shape(sc.POINTS, [p]), sc.Shape(sc.LAX_POLYLINE, [p]), None, sc.Shape(sc.LAX_POLYGON, [p])], sc.FAST)

    def read(b):
        shapes = sc.TaggedShapes(b)
        kept = [s for s in shapes if s is not None]
        return [float(sum(s.num_edges() for s in kept)), math.fsum(v[2] for v in kept[1].chains[0]), float(len(kept))]

    r = F.col("r")
    df = _tracks(spark, d).withColumn("r", sc.column(lambda t: read(pack(t)), "array<double>", F.col("track")))
    return df.select("user_id", r[0].cast("bigint").alias("edges"), r6(r[1]).alias("z"), r[2].cast("bigint").alias("shapes"))


_G = "g AS (SELECT n_nationkey::BIGINT AS id, -60 + (n_nationkey * 37) % 110 AS la, -170 + (n_nationkey * 71) % 330 AS ln FROM nation)"
_TEXT = "printf('%.6f:%.6f', la::DOUBLE, ln::DOUBLE)", "printf('%.6f:%.6f', la::DOUBLE, ln + 8e0)", "printf('%.6f:%.6f', la + 8e0, ln::DOUBLE)"


@query("text_polygons", f"WITH {_G} SELECT id, {_TEXT[0]} || ', ' || {_TEXT[1]} || ', ' || {_TEXT[2]} AS loop, {_TEXT[0]} || ', ' || {_TEXT[1]} || ', ' || {_TEXT[2]} || '; ' || {_TEXT[0]} || ', ' || {_TEXT[2]} || ', ' || {_TEXT[1]} AS polygon, 'empty' AS none, 'full' AS whole FROM g")
def text_polygons(spark, d):
    """Loops and polygons from text and back."""
    k = F.col("n_nationkey")
    la, ln = (-60 + (k * 37) % 110).cast("double"), (-170 + (k * 71) % 330).cast("double")
    a, b, e = (tf.format_latlng(x, y, 4) for x, y in ((la, ln), (la, ln + 8), (la + 8, ln)))
    df = table(spark, d, "nation").select(k.cast("bigint").alias("id"), F.concat_ws(",", a, b, e).alias("one"), F.concat_ws(" , ", a, e, b).alias("two"))
    df = df.withColumns({"loop": tf.parse_loop(F.col("one")), "polygon": tf.parse_polygon(F.concat("one", F.lit(" ;"), "two"))})
    return df.select("id", tf.loop_text(F.col("loop")).alias("loop"), tf.polygon_text(F.col("polygon")).alias("polygon"), tf.polygon_text(tf.parse_polygon(F.lit("empty"))).alias("none"), tf.polygon_text(tf.parse_polygon(F.lit("full"))).alias("whole"))


@query("text_index", f"WITH {_G} SELECT id, {_TEXT[0]} || ' | ' || {_TEXT[1]} || ' # ' || {_TEXT[0]} || ', ' || {_TEXT[2]} || ' # ' || {_TEXT[0]} || ', ' || {_TEXT[1]} || ', ' || {_TEXT[2]} AS text, 2 AS points, 1 AS lines, 1 AS polygons FROM g")
def text_index(spark, d):
    """Points, a polyline and a polygon in one text, read and written again."""
    k = F.col("n_nationkey")
    la, ln = (-60 + (k * 37) % 110).cast("double"), (-170 + (k * 71) % 330).cast("double")
    a, b, e = (tf.format_latlng(x, y, 4) for x, y in ((la, ln), (la, ln + 8), (la + 8, ln)))
    text = F.concat(a, F.lit("|"), b, F.lit("#"), a, F.lit(","), e, F.lit("#"), a, F.lit(","), b, F.lit(","), e)
    df = table(spark, d, "nation").select(k.cast("bigint").alias("id"), tf.parse_index(text).alias("i"))
    i = F.col("i")
    return df.select("id", tf.index_text(i).alias("text"), F.size(i["points"]).alias("points"), F.size(i["polylines"]).alias("lines"), F.size(i["polygons"]).alias("polygons"))


@query("text_rects", f"WITH {_G} SELECT id, printf('%.6f:%.6f, %.6f:%.6f', la::DOUBLE, ln::DOUBLE, la + 8e0, ln + 8e0) AS rect, la::DOUBLE AS lat, ln + 8e0 AS lng FROM g")
def text_rects(spark, d):
    """Bounds of points in text, and single points."""
    k = F.col("n_nationkey")
    la, ln = (-60 + (k * 37) % 110).cast("double"), (-170 + (k * 71) % 330).cast("double")
    a, b, e = (tf.format_latlng(x, y, 4) for x, y in ((la, ln), (la, ln + 8), (la + 8, ln)))
    df = table(spark, d, "nation").select(k.cast("bigint").alias("id"), tf.parse_rect(F.concat_ws(", ", b, e, a)).alias("r"), tf.parse_latlng(b).alias("p"))
    return df.select("id", tf.rect_text(F.col("r")).alias("rect"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))


@query("text_cells", f"WITH {d_points('cp', 'customer', 'c_custkey')}, {d_encode('t', 'cp')} SELECT id, {d_parent('cell', 6)} AS cell, 2 AS n FROM t")
def text_cells(spark, d):
    """Cells from a face and child positions, singly and as a list with a repeat."""
    df = cell_points(spark, d, "customer", "c_custkey").withColumn("t", c.debug_string(c.parent(F.col("cell"), 6)))
    both = tf.parse_cell_union(F.concat_ws(", ", "t", c.debug_string(c.parent(F.col("cell"), 5)), "t"))
    df = c.fenced(df, {"u": both, "p": tf.parse_cell(F.col("t"))})
    return df.select("id", F.col("p").alias("cell"), F.size("u").alias("n"))


@query("encoded_index", f"WITH {d_points('cp', 'customer', 'c_custkey')}, {d_encode('t', 'cp')}, s AS (SELECT c_custkey % 7 AS k, {d_parent('t.cell', 8)} AS cell FROM t JOIN customer ON c_custkey = t.id) SELECT k::BIGINT AS id, count(DISTINCT cell)::BIGINT AS cells, count(*)::BIGINT AS points, true AS found FROM s GROUP BY k")
def encoded_index(spark, d):
    """Points by level-8 cell as an encoded index: its cells, its points, and whether each point's leaf is found."""
    df = cell_points(spark, d, "customer", "c_custkey").groupBy((F.col("id") % 7).alias("id")).agg(F.collect_list(F.struct("x", "y", "z", "cell")).alias("v"))

    def run(v):
        from sphera.operators.cover import parent

        points = [(r["x"], r["y"], r["z"]) for r in v]
        leaves = [sc.unsigned(int(r["cell"])) for r in v]
        by_cell: dict[int, list[int]] = {}
        for i, leaf in enumerate(leaves):
            by_cell.setdefault(parent(leaf, 8), []).append(i)
        index = sc.EncodedIndex(sc.encode_index([(cell, 0, False, ids) for cell, ids in by_cell.items()], [sc.Shape(sc.POINTS, [points])]))
        found = all(i in index.cell(index.locate(leaf))[1][0][2] for i, leaf in enumerate(leaves))
        return [len(index), sum(len(index.cell(i)[1][0][2]) for i in range(len(index))), int(found)]

    r = F.col("r")
    return df.withColumn("r", sc.column(run, "array<long>", F.col("v"))).select("id", r[0].alias("cells"), r[1].alias("points"), (r[2] == 1).alias("found"))
