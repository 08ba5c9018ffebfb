"""What keeps queries within their limits on large tables, on small ones: work that does not grow with pairs, keys that are dealt out."""

import itertools
import math
import random

from pyspark.sql import functions as F

from sphera.functions import cells as c
from sphera.functions.points import Vec
from sphera.operators import joins, nearest


def points(spark, n, seed, prefix="", squeeze=1.0):
    """Points of which many are near the pole, as uniform latitudes give them."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lat, lng = math.pi / 2 * (1 - squeeze * r.random()), r.uniform(-math.pi, math.pi)
        rows.append((i, math.cos(lat) * math.cos(lng), math.cos(lat) * math.sin(lng), math.sin(lat)))
    df = spark.createDataFrame(rows, ", ".join(f"{prefix}{x} {t}" for x, t in zip(("id", "x", "y", "z"), ("long", "double", "double", "double"), strict=True)))
    return c.encode(df, Vec.named(prefix), f"{prefix}cell"), rows


def joins_of(df):
    """Names of the physical joins of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [n for n in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct") if n in plan]


def test_points_are_counted_before_the_join(spark):
    pts, _ = points(spark, 300, 1)
    held = pts.select("id", c.parent(F.col("cell"), 2 + (F.col("id") % 4).cast("int")).alias("k"))
    counted = joins.points_by_cell(pts.select(F.col("cell").alias("leaf")), held, "leaf", "k")
    want = joins.points_in_cells(pts.select(F.col("id").alias("p"), F.col("cell").alias("leaf")), held, "leaf", "k").groupBy("id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counted.select("id", "n").collect())) == sorted(map(tuple, want.collect()))
    # each cell is in the result once, whatever number of points it has, and neither side goes through the driver
    assert counted.count() == 300 and "BroadcastHashJoin" not in joins_of(counted)


def close(a, b):
    return sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True))


def test_caps_of_own_sizes_find_all_and_little_else(spark):
    pts, all_p = points(spark, 400, 2, "t_")
    qs, all_q = points(spark, 12, 3, "q_")
    size = {i: 0.02 * (i + 1) for i in range(12)}
    qs = qs.withColumn("r", 0.02 * (F.col("q_id") + 1))
    found = nearest.within_own(qs, pts, "r").select("q_id", "t_id").collect()
    got = set(map(tuple, found))
    assert len(got) == len(found)  # each pair once
    want = {(q[0], t[0]) for q, t in itertools.product(all_q, all_p) if close(q, t) <= (2 * math.sin(size[q[0]] / 2)) ** 2}
    assert want and want <= got
    # cells cover less than three times the caps
    covered = nearest.cap_cells(qs, F.col("r"), "q_", "k").groupBy("q_id", "r").agg(F.sum(F.pow(F.lit(0.25), c.level(F.col("k")))).alias("a")).collect()
    assert all(row.a * 4 * math.pi / 6 < 3 * 2 * math.pi * (1 - math.cos(row.r)) for row in covered)


def test_within_by_small_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PLAIN", 0)
    monkeypatch.setattr(joins, "MOST_PAIRS", 50)
    pts, all_p = points(spark, 300, 4, "t_", 0.2)
    qs, all_q = points(spark, 40, 5, "q_", 0.2)
    for r in (0.003, 0.1, 0.5):
        for a, b in ((qs, pts), (pts.toDF(*[f"q_{x}" for x in ("id", "x", "y", "z", "cell")]), qs.toDF(*[f"t_{x}" for x in ("id", "x", "y", "z", "cell")]))):
            one, two = (all_q, all_p) if a is qs else (all_p, all_q)
            want = sorted((q[0], t[0]) for q, t in itertools.product(one, two) if close(q, t) <= (2 * math.sin(r / 2)) ** 2)
            assert sorted(map(tuple, nearest.within(a, b, r).select("q_id", "t_id").collect())) == want


def test_heavy_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_PAIRS", 1000)
    left = spark.range(500).select((F.col("id") * 0).alias("k"), F.col("id").alias("a")).unionByName(spark.range(3).select(F.col("id").alias("k"), (F.col("id") + 500).alias("a")))
    right = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("b"))
    both = joins.balanced_join(left, right, "k")
    assert both.count() == 501 * 20 + 20 and both.distinct().count() == both.count()
    assert "BroadcastNestedLoopJoin" not in joins_of(both)
    most = max(both.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect(), key=lambda r: r["count"])["count"]
    assert most < 5000  # of 10020 pairs of one key


def test_covered_regions_meet_a_point_once(spark):
    pts, _ = points(spark, 200, 6, "t_")
    leaf = pts.select("t_id", F.col("t_cell").alias("leaf"))
    # a region whose cells hold one another, and repeat
    covered = leaf.where("t_id < 20").select((F.col("t_id") % 3).alias("region"), F.explode(F.array(*[c.parent(F.col("leaf"), at) for at in (1, 3, 3, 6)])).alias("k"))
    got = joins.cover_join(leaf, covered, "leaf", "k", ["region"], F.col("t_id") >= 0).select("region", "t_id")
    want = joins.points_in_cells(leaf, covered, "leaf", "k").select("region", "t_id").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def tasks_of(df):
    """How many of its partitions a table has rows in."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_costly_functions_of_a_row_run_on_all_cores(spark):
    from sphera.plans import catalogue

    q = catalogue.queries()
    for name in ("cover_cap", "interior_cover", "nested_polygons", "vertex_crossings", "degenerate_signs", "overlay_areas", "winding_areas", "clip_polylines", "validation_codes", "polyline_layers", "approx_alignment", "code_points_compressed"):
        df = q[name](spark, "/root/testdata/sf0.001")
        assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism, name


def test_union_of_caps_in_steps(spark):
    from sphera.functions.regions import Cap

    df, _ = points(spark, 50, 7)
    one, two = Cap.from_angle(Vec.named(), 0.1 + F.col("id") / 40), Cap(Vec(F.col("z"), F.col("x"), F.col("y")), F.lit(0.3))
    df = c.fenced(df, {"s": one.union_sizes(two), "w": one.center.cross(two.center).cross(one.center).normalized().struct()})
    df = c.fenced(df, {"u": one.union_by(two, F.col("s"), Vec.of("w")), "v": F.struct(one.union(two).center.struct().alias("c"), one.union(two).length2.alias("l"))})
    off = sum((F.abs(F.col(f"u.c.{a}") - F.col(f"v.c.{a}")) for a in "xyz"), F.abs(F.col("u.l") - F.col("v.l")))
    assert df.agg(F.max(off)).first()[0] < 1e-14


def test_level_of_a_centre_by_few_trials(monkeypatch):
    from sphera.operators.cover import cell_at, center
    from sphera.sources import shapecoding as sc

    tried = []
    monkeypatch.setattr(sc, "center", lambda k: tried.append(k) or center(k))
    r = random.Random(8)
    for at in range(2, 31):
        lat, lng = r.uniform(-1.5, 1.5), r.uniform(-3, 3)
        p = (math.cos(lat) * math.cos(lng), math.cos(lat) * math.sin(lng), math.sin(lat))
        assert sc._center_level(center(cell_at(p, at))) == at and sc._center_level(p) == -1
    assert len(tried) < 29 * 9  # not 31 for a point that is none


def loops(spark, n, seed):
    from sphera.operators import edge_tables as et

    r = random.Random(seed)
    rows = []
    for i in range(n):
        lat, lng = math.asin(r.uniform(-1, 1)), r.uniform(-3, 3)
        at = lambda a, b: (math.cos(b) * math.cos(a), math.sin(b) * math.cos(a), math.sin(a))
        rows.append((i, 0, [at(lat, lng), at(lat, lng + 0.05), at(lat + 0.05, lng)]))
    return et.of_loops(spark.createDataFrame(rows, "shape long, chain int, vertices array<struct<x:double,y:double,z:double>>"))


def test_index_forgets_shapes_that_have_nothing_to_do_with_a_cell(spark, monkeypatch):
    from sphera.operators import shape_index as si

    seen = []
    real = si.cut_lineage
    monkeypatch.setattr(si, "cut_lineage", lambda df: seen.append((df.columns, real(df))) or seen[-1][1])
    t = loops(spark, 60, 9)
    index = si.build(t, 3)
    states = [df.count() for columns, df in seen if "center" in columns and "edges" not in columns]
    assert len(states) > 2 and max(states) < 6 * 60
    pairs = si.crossing_pairs(index).select("l_shape", "l_edge", "r_shape", "r_edge")
    assert pairs.count() == pairs.distinct().count() > 0


def test_squares_of_an_edge_hold_all_of_it(spark):
    from sphera.operators import shape_index as si

    t = loops(spark, 40, 10).select("shape", "edge", *[f"{p}{a}" for p in "ab" for a in "xyz"])
    found = si.squares(t, 7, "s").select("*", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k"))
    v = Vec(*[F.col(f"a{a}") * (40 - F.col("k")) + F.col(f"b{a}") * F.col("k") for a in "xyz"]).normalized()
    found = c.decode(c.encode(c.fenced(found, {"v": v.struct()}), Vec.of("v"), "leaf"), "leaf", "d_")
    own = F.col("d_face") * (1 << 14) + F.shiftright("d_i", 23) * (1 << 7) + F.shiftright("d_j", 23)
    assert found.where(~F.array_contains("s", own.cast("int"))).isEmpty()
    assert found.agg(F.max(F.size("s"))).first()[0] < 14


def test_all_pairs_of_triangles_and_stars(spark):
    from sphera.operators import edge_distance as ed
    from sphera.plans import catalogue

    d = "/root/testdata/sf0.001"
    q = catalogue.queries()["edge_pairs_closest_points"](spark, d)
    assert q.count() == 75 * catalogue.queries()["edge_positions"](spark, d).count()
    a = loops(spark, 6, 11).select((F.col("shape") * 3 + F.col("edge")).alias("q_id"), *[F.col(f"{p}{a}").alias(f"q_{p}{a}") for p in "ab" for a in "xyz"])
    b = loops(spark, 7, 12).select((F.col("shape") * 3 + F.col("edge")).alias("t_id"), *[F.col(f"{p}{a}").alias(f"t_{p}{a}") for p in "ab" for a in "xyz"])
    ends = (Vec.named("q_a"), Vec.named("q_b"), Vec.named("t_a"), Vec.named("t_b"))
    df = c.fenced(ed.with_closest_points(a.crossJoin(b)), {"d": ed.edge_pair(*ends)})
    p, n = Vec.of("near.p"), Vec.of("near.q")
    assert df.agg(F.max(F.abs(F.sqrt(p.minus(n).norm2()) - 2 * F.sin(F.col("d") / 2)))).first()[0] < 1e-9


def test_sums_beyond_a_bigint_and_full_spheres(spark, tmp_path):
    from sphera.plans import catalogue

    spark.range(3000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(100000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    row = catalogue.queries()["cell_index_ranges"](spark, str(tmp_path)).first()
    assert row.weighted is None and row.leaves == 6 * 4**30 and 0 < row.covered < row.leaves
    row = catalogue.queries()["union_expanded"](spark, str(tmp_path)).first()
    assert row.own == 6 * 4**5 and row.grows


def test_a_point_beside_a_centre_is_none(spark):
    rows = [(0, 6e-17, 0.0, -1.0), (1, 0.0, 0.0, -1.0)]
    df = c.face_siti(spark.createDataFrame(rows, "id int, x double, y double, z double"), Vec.named())
    assert [r.level for r in df.orderBy("id").collect()] == [-1, 0]


def test_cells_are_measured_once_whatever_number_of_ids_they_have(spark, monkeypatch):
    from sphera.operators import cellindex as ci
    from sphera.operators import edge_distance as ed

    seen = []
    real = ed.within
    monkeypatch.setattr(ed, "within", lambda q, t, *more: seen.append((q.count(), t.count())) or real(q, t, *more))
    pts, _ = points(spark, 60, 13)
    cell = c.parent(F.col("cell"), 3)
    many = pts.crossJoin(spark.range(5).withColumnRenamed("id", "n")).select((F.col("id") * 5 + F.col("n")).alias("id"), cell.alias("k"))
    a, b = many.select(F.col("id").alias("aid"), F.col("k").alias("acell")), many.select(F.col("id").alias("bid"), F.col("k").alias("bcell"))
    found = ci.tolerant_join(a, b, 0.05)
    distinct = many.select("k").distinct().count()
    assert seen == [(4 * distinct, 4 * distinct)]
    n = found.count()
    assert n == found.distinct().count() and n % 25 == 0 and found.where("aid = bid").count() == 300
    # the k closest labels of cells that have many
    index = many.select(F.col("k").alias("cell"), F.col("id").alias("label"))
    q = ed.point_targets(pts.where("id < 5").select("id", *[F.col(x) for x in "xyz"]))
    got = ci.closest_cells(q, index, 7).select("q_id", "t_id", "rank").collect()
    want = ci.closest_cells_brute_force(q, index, 7).select("q_id", "t_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    labels = ci.intersecting_labels(index, many.select("id", "k"), "k", "id")
    assert labels.count() == labels.distinct().count() == many.join(index, F.col("k") == F.col("cell")).count()


def test_bounds_look_at_each_cell_once(spark, monkeypatch):
    from sphera.operators import unions
    from sphera.plans import catalogue

    seen = []
    for name in ("rect_bounds", "cap_bounds"):
        real = getattr(unions, name)
        monkeypatch.setattr(unions, name, lambda u, keys, real=real: seen.append((u.count(), u.distinct().count())) or real(u, keys))
    got = catalogue.queries()["union_bounds"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 7 and all(r.holds for r in got)
    assert len(seen) == 2 and all(a == b for a, b in seen)
