"""Cells, intervals, unions, joins and shapes against known values and brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sphera.functions import cells as c
from sphera.functions import edges as e
from sphera.functions import points as p
from sphera.functions.intervals import PI, Arc, Line
from sphera.functions.points import Vec
from sphera.functions.regions import Cap, Rect
from sphera.operators import cover, density, exact, nearest, shapes, terms, unions
from sphera.sources import coding, textformat


def points(spark, n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        z, t = r.uniform(-1, 1), r.uniform(-math.pi, math.pi)
        s = math.sqrt(1 - z * z)
        rows.append((i, s * math.cos(t), s * math.sin(t), z))
    return spark.createDataFrame(rows, "id long, x double, y double, z double")


def unsigned(v):
    return v & (1 << 64) - 1


def test_faces_of_the_axes(spark):
    axes = [(0, 0), (0, 90), (90, 0), (0, 180), (0, -90), (-90, 0)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(axes)], "id long, lat double, lng double")
    df = c.encode(df.withColumn("p", p.from_degrees(F.col("lat"), F.col("lng")).struct()), Vec.of("p"))
    assert [r.f for r in df.orderBy("id").select(c.face(F.col("cell")).alias("f")).collect()] == list(range(6))


def test_codec_round_trip(spark):
    df = c.encode(points(spark, 400), Vec.named())
    got = c.with_center(c.decode(df)).collect()
    for r in got:
        assert unsigned(r.cell) >> 61 == r.face and r.cell & 1
        assert math.dist((r.x, r.y, r.z), (r.center.x, r.center.y, r.center.z)) < 4e-9
        assert cover._face_ij(unsigned(r.cell))[:3] == (r.face, r.i, r.j)


def test_algebra(spark):
    df = c.encode(points(spark, 60, 2), Vec.named())
    for at in (0, 1, 7, 29, 30):
        x = c.parent(F.col("cell"), at)
        rows = df.select(F.col("cell"), x.alias("up"), c.level(x).alias("level"), c.range_min(x).alias("lo"), c.range_max(x).alias("hi"), c.token(x).alias("token"), c.from_token(c.token(x)).alias("again"), c.debug_string(x).alias("name"), c.from_debug_string(c.debug_string(x)).alias("named"), c.next_wrap(c.prev_wrap(x)).alias("same"), c.distance_from_begin(x).alias("at")).collect()
        for r in rows:
            u = unsigned(r.up)
            assert r.level == at == cover.level(u) and u == cover.parent(unsigned(r.cell), at)
            assert r.lo <= r.cell <= r.hi and r.again == r.up == r.named == r.same and r.token == f"{u:016x}".rstrip("0")
            assert r["at"] == u >> 2 * (30 - at) + 1 and len(r.name) == 2 + at


def test_tokens_that_are_none(spark):
    df = spark.createDataFrame([(t,) for t in ("X", "", " 1", "zz", "12345678901234567", "876b e99")], "t string")
    assert [r[0] for r in df.select(c.from_token(F.col("t"))).collect()] == [0] * 6
    assert df.select(c.token(F.lit(0).cast("bigint"))).first()[0] == "X"


def test_known_neighbours(spark):
    names = "2/033020001100"
    df = spark.createDataFrame([(names,)], "n string").select(c.from_debug_string(F.col("n")).alias("cell"))
    around = c.all_neighbors(df, 12)
    assert around.count() == 8
    own = cover._face_ij(unsigned(df.first()[0]))
    for r in around.collect():
        f, i, j, size = cover._face_ij(unsigned(r.neighbor))
        assert f == own[0] and max(abs(i - own[1]), abs(j - own[2])) == size
    corner = spark.createDataFrame([("0/",)], "n string").select(c.from_debug_string(F.col("n")).alias("cell"))
    assert sorted(unsigned(r.neighbor) >> 61 for r in c.edge_neighbors(corner).collect()) == [1, 2, 4, 5]


def test_advance_and_common_ancestor(spark):
    df = spark.createDataFrame([("0/012", "0/0133"), ("5/3", "5/31"), ("1/0", "4/0"), ("3/2", "3/2")], "a string, b string")
    a, b = c.from_debug_string(F.col("a")), c.from_debug_string(F.col("b"))
    assert [r[0] for r in df.select(c.common_ancestor_level(a, b)).collect()] == [2, 1, -1, 1]
    assert [c_[0] for c_ in df.select(c.debug_string(c.advance(a, F.lit(1)))).collect()] == ["0/013", "Invalid: c400000000000000", "1/1", "3/3"]
    assert [c_[0] for c_ in df.select(c.debug_string(c.advance_wrap(a, F.lit(-1)))).collect()] == ["0/011", "5/2", "0/3", "3/1"]
    assert [c_[0] for c_ in df.select(c.debug_string(c.next_wrap(a))).collect()] == ["0/013", "0/0", "1/1", "3/3"]


def test_intervals_agree_with_samples(spark):
    ends = [-PI, -2.0, -0.5, 0.0, 1.0, 2.5, PI]
    pairs = list(itertools.product(ends, repeat=4))
    r = random.Random(1)
    rows = [(i, *v) for i, v in enumerate(r.sample(pairs, 300))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    fix = lambda lo, hi: Arc(F.when((lo == -PI) & (hi != PI), PI).otherwise(lo), F.when((hi == -PI) & (lo != PI), PI).otherwise(hi))
    one, two = fix(F.col("a"), F.col("b")), fix(F.col("c"), F.col("d"))
    u, n = one.union(two), one.intersection(two)
    got = df.select("id", *[x.alias(k) for k, x in (("lo", one.lo), ("hi", one.hi), ("lo2", two.lo), ("hi2", two.hi), ("ulo", u.lo), ("uhi", u.hi), ("nlo", n.lo), ("nhi", n.hi), ("meets", one.intersects(two)), ("has", one.contains(two)))]).collect()

    def inside(lo, hi, t):
        return lo <= t <= hi if lo <= hi else not (lo == PI and hi == -PI) and (t >= lo or t <= hi)

    for g in got:
        grid = [(-PI) + (k + 0.37) * 2 * PI / 500 for k in range(500)]
        a, b = [inside(g.lo, g.hi, t) for t in grid], [inside(g.lo2, g.hi2, t) for t in grid]
        assert all(inside(g.ulo, g.uhi, t) for t, x, y in zip(grid, a, b, strict=True) if x or y)
        assert all(inside(g.nlo, g.nhi, t) for t, x, y in zip(grid, a, b, strict=True) if x and y)
        if any(x and y for x, y in zip(a, b, strict=True)):
            assert g.meets
        if g.has:
            assert all(x for x, y in zip(a, b, strict=True) if y)


def test_line_intervals(spark):
    one, two = Line(F.lit(1.0), F.lit(3.0)), Line(F.lit(2.0), F.lit(5.0))
    none = Line(F.lit(1.0), F.lit(0.0))
    row = spark.range(1).select(one.intersects(two), one.contains(none), none.intersects(one), one.union(none).hi, none.add_point(F.lit(4.0)).lo, one.directed_hausdorff(two), one.expanded(1.0).lo).first()
    assert list(row) == [True, True, False, 3.0, 4.0, 1.0, 0.0]


def test_caps_and_rectangles(spark):
    df = points(spark, 200, 7)
    cap = Cap.from_angle(Vec.lit(1, 0, 0), F.lit(0.7))
    lat, lng = F.radians(p.latitude(Vec.named())), F.radians(p.longitude(Vec.named()))
    bound = cap.rect_bound()
    df = df.withColumns({"la": lat, "ln": lng, "b1": bound.lat.lo, "b2": bound.lat.hi, "b3": bound.lng.lo, "b4": bound.lng.hi})
    # in a projection of its own: compiled together with the other tests, Spark 4.1 shares parts of the two caps that differ
    df = df.withColumn("out", cap.complement().contains_point(Vec.named())).cache()
    bound, lat, lng = Rect(Line(F.col("b1"), F.col("b2")), Arc(F.col("b3"), F.col("b4"))), F.col("la"), F.col("ln")
    rows = df.select(cap.contains_point(Vec.named()).alias("in"), F.col("out"), bound.contains_point(lat, lng).alias("box"), p.angle(Vec.lit(1, 0, 0), Vec.named()).alias("a")).collect()
    for r in rows:
        assert r["in"] == (r.a <= 0.7) and r.out != r["in"] and (r.box or not r["in"])
    rect = Rect(Line(F.lit(-0.3), F.lit(0.6)), Arc(F.lit(2.8), F.lit(-2.9)))
    wide = rect.cap_bound()
    x, y, z, length2 = spark.range(1).select(*wide.center, wide.length2).first()
    assert df.where(rect.contains_point(lat, lng) & ~Cap(Vec.lit(x, y, z), F.lit(length2 + 1e-12)).contains_point(Vec.named())).count() == 0
    whole = Rect(Line(F.lit(-PI / 2), F.lit(PI / 2)), Arc(F.lit(-PI), F.lit(PI)))
    assert spark.range(1).select(whole.area()).first()[0] == pytest.approx(4 * PI)


def test_point_functions(spark):
    v, o = Vec.named(), Vec.of("o")
    df = c.fenced(points(spark, 100, 4), {"o": p.ortho(v).struct()})
    df = c.fenced(df, {"half": p.interpolate(v, o, 0.5).struct(), "turned": p.rotate(o, v, F.lit(PI / 2)).struct(), "minus": p.ortho(v.times(-1.0)).struct()})
    for r in df.select(o.dot(v), p.is_unit_length(o), p.angle(v, Vec.of("half")), Vec.of("turned").dot(o), o.plus(Vec.of("minus")).norm()).collect():
        assert abs(r[0]) < 1e-15 and r[1] and r[2] == pytest.approx(PI / 4) and abs(r[3]) < 1e-12 and r[4] < 1e-15


def covered(rows):
    out = set()
    for cell in rows:
        u = unsigned(cell)
        out.update(range((u - (cover.lsb(u) - 1)) >> 49, ((u + (cover.lsb(u) - 1)) >> 49) + 1))
    return out


def test_unions_agree_with_sets(spark):
    r = random.Random(3)

    def some(n):
        out = []
        for _ in range(n):
            f, at = r.randrange(6), r.randint(1, 6)
            cell = (f << 61) + (1 << 60)
            for _ in range(at):
                cell = cover.children(cell)[r.randrange(2)]
            out.append(cell)
        return out

    a = {k: some(30) for k in range(3)}
    b = {k: some(30) for k in range(3)}
    to = lambda d: spark.createDataFrame([(k, cover.signed(x)) for k, v in d.items() for x in v], "k long, cell long")
    for how, op in (("union", set.__or__), ("intersection", set.__and__), ("difference", set.__sub__)):
        got = unions.combine(to(a), to(b), ["k"], how).collect()
        for k in range(3):
            mine = [x.cell for x in got if x.k == k]
            assert covered(mine) == op(covered(a[k]), covered(b[k]))
            assert sorted(map(unsigned, mine)) == cover.canonical([unsigned(x) for x in mine])
    assert unions.measures(unions.normalize(unions.whole_sphere(spark).withColumn("k", F.lit(1)), ["k"]), ["k"]).first().leaf_count == 6 << 60


def test_nearest_agrees_with_all_pairs(spark):
    side = lambda s, n, seed: c.encode(points(spark, n, seed), Vec.named()).select(*[F.col(a).alias(f"{s}_{a}") for a in ("id", "x", "y", "z", "cell")])
    q, t = side("q", 40, 5), side("t", 150, 6)
    ql, tl = q.collect(), t.collect()
    d2 = lambda a, b: min(4.0, sum((a[f"q_{k}"] - b[f"t_{k}"]) ** 2 for k in "xyz"))
    got = {(r.q_id, r["rank"]): r.t_id for r in nearest.nearest(q, t, 4).collect()}
    far = {(r.q_id, r["rank"]): r.t_id for r in nearest.farthest(q, t, 2).collect()}
    for a in ql:
        order = sorted(tl, key=lambda b: (d2(a, b), b.t_id))
        assert [got[(a.q_id, k)] for k in (1, 2, 3, 4)] == [b.t_id for b in order[:4]]
        assert [far[(a.q_id, k)] for k in (1, 2)] == [b.t_id for b in order[::-1][:2]]
    for radius in (0.05, 0.4, 1.5, 3.2):
        limit = (2 * math.sin(min(math.pi, radius) / 2)) ** 2
        assert nearest.within(q, t, radius).count() == sum(d2(a, b) <= limit for a in ql for b in tl)


def test_terms_meet_where_coverings_do(spark):
    r = random.Random(8)
    caps = [shapes.from_degrees(r.uniform(-60, 60), r.uniform(-180, 180)) for _ in range(40)]
    for space in (False, True):
        o = terms.Options(2, 10, 2, optimize_for_space=space)
        sets = [cover.cover(cover.CapRegion(x, 0.15), 8, o.min_level, o.true_max, o.level_mod) for x in caps]
        df = spark.createDataFrame([(i, cover.signed(x)) for i, s in enumerate(sets) for x in s], "id long, cell long")
        index = terms.region_index_terms(df, "cell", ["id"], o)
        query = terms.region_query_terms(df, "cell", ["id"], o).withColumnRenamed("id", "q")
        got = {(x.id, x.q) for x in terms.candidates(index, query, "id", "q").collect()}
        meet = lambda a, b: any(x - (cover.lsb(x) - 1) <= y + (cover.lsb(y) - 1) and y - (cover.lsb(y) - 1) <= x + (cover.lsb(x) - 1) for x in a for y in b)
        assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if meet(a, b)}


def test_coverings(spark):
    r = random.Random(2)
    for _ in range(12):
        center, radius = shapes.from_degrees(r.uniform(-80, 80), r.uniform(-180, 180)), 10 ** r.uniform(-3, 0)
        region = cover.CapRegion(center, radius)
        found = cover.cover(region, 12)
        assert cover.is_canonical(found) and len(found) <= 12
        for _ in range(30):
            q = shapes.regular_loop(center, radius * r.random(), 5)[r.randrange(5)]
            assert any(shapes.contains(cover.vertices(x), q) for x in found)
        for x in cover.cover(region, 12, interior=True):
            assert all(shapes.angle(v, center) <= radius + 1e-15 for v in cover.vertices(x))


def test_density(spark):
    df = c.encode(points(spark, 500, 9), Vec.named()).withColumn("weight", F.lit(1.0))
    nodes = density.tree(df, 6, 20.0)
    assert density.leaves(nodes).agg(F.sum("weight")).first()[0] == 500
    parts = density.partition_by_weight(df, 6, 50.0).groupBy("part").agg(F.sum("weight").alias("w")).collect()
    assert sum(r.w for r in parts) == 500 and len(parts) == 10


def test_exact_signs():
    r = random.Random(1)
    line = [shapes.from_degrees(0, x) for x in (0, 10, 20, 35)]
    for a, b, d in itertools.permutations(line, 3):
        assert exact.sign(a, b, d) == exact.sign(b, d, a) == -exact.sign(d, b, a) != 0
    for _ in range(200):
        a, b, d = ([shapes.unit((r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1))) for _ in range(3)])
        assert exact.sign(a, b, d) == (1 if shapes.dot(shapes.cross(a, b), d) > 0 else -1)


def test_overlay_by_samples():
    r = random.Random(6)
    for _ in range(15):
        a = shapes.regular_loop(shapes.from_degrees(10, 10), 0.2, r.randint(3, 12))
        b = shapes.regular_loop(shapes.from_degrees(10 + r.uniform(-12, 12), 10 + r.uniform(-12, 12)), 0.15, r.randint(3, 12))
        made = {h: shapes.overlay([a], [b], h) for h in ("union", "intersection", "difference", "symmetric_difference")}
        for _ in range(60):
            q = shapes.from_degrees(10 + r.uniform(-25, 25), 10 + r.uniform(-25, 25))
            x, y = shapes.contains(a, q), shapes.contains(b, q)
            want = {"union": x or y, "intersection": x and y, "difference": x and not y, "symmetric_difference": x != y}
            assert {h: shapes.polygon_contains(m, q) for h, m in made.items()} == want


def test_shapes():
    loop = shapes.regular_loop((0.0, 0.0, 1.0), 0.3, 50)
    assert shapes.area(loop) + shapes.curvature(loop) == pytest.approx(2 * math.pi)
    assert shapes.area(loop[::-1]) == pytest.approx(4 * math.pi - shapes.area(loop))
    assert shapes.contains(loop, (0.0, 0.0, 1.0)) and not shapes.contains(loop, (0.0, 0.0, -1.0)) and shapes.contains(loop[::-1], (0.0, 0.0, -1.0))
    assert shapes.find_error(loop) is None and shapes.find_error(loop[:2]) and shapes.find_error([loop[0], loop[20], loop[10], loop[30]]) == "two edges cross"
    ring = shapes.hull([shapes.from_degrees(a, b) for a in range(0, 20, 3) for b in range(0, 20, 3)])
    assert all(shapes.contains(ring, shapes.from_degrees(a, b)) for a in range(3, 16, 3) for b in range(3, 16, 3))
    cost, path = shapes.align([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], [(1.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)])
    assert cost == 0 and path == [(0, 0), (0, 1), (1, 2)]


def test_chains():
    chain = [shapes.from_degrees(0, x) for x in range(0, 50, 10)]
    above, below = shapes.from_degrees(3, 17), shapes.from_degrees(-3, 17)
    foot, after = shapes.project_to_chain(chain, above)
    assert shapes.to_degrees(foot) == pytest.approx((0, 17), abs=1e-9) and after == 2
    assert shapes.uninterpolate(chain, above) == pytest.approx(17 / 40)
    assert shapes.is_on_right(chain, below) and not shapes.is_on_right(chain, above)
    assert shapes.nearly_covers(chain, chain[1:4], 1e-9) and not shapes.nearly_covers(chain, chain[::-1], 1e-3)
    same = shapes.consensus([chain, chain, [shapes.from_degrees(1, x) for x in range(0, 50, 10)]])
    assert len(same) == 5 and all(0 < shapes.to_degrees(p)[0] < 1 for p in same)
    flat = shapes.tessellate(shapes.from_degrees(50, 0), shapes.from_degrees(50, 80), lambda p: shapes.to_degrees(p)[::-1], lambda x, y: shapes.from_degrees(y, x), 1e-4)
    assert len(flat) > 8 and max(y for _, y in flat) > 55


def test_edges(spark):
    df = points(spark, 30, 12).crossJoin(points(spark, 10, 13).select(*[F.col(a).alias(f"b{a}") for a in "xyz"]))
    a, b, q = Vec.named(), Vec.named("b"), Vec.lit(0.6, 0.0, 0.8)
    foot = e.project(q, a, b)
    for r in df.select(e.distance(q, a, b), p.angle(q, foot), e.max_distance(q, a, b), e.area(a, b, q)).collect():
        assert r[0] == pytest.approx(r[1], abs=1e-7) and r[2] >= r[0] - 1e-9 and 0 <= r[3] <= 2 * math.pi


def test_text_and_coding(spark):
    df = spark.createDataFrame([("1:2, 3.5:-4",), ("",), ("x:1,5:6",)], "t string")
    got = [[None if v is None else (v.lat, v.lng) for v in r[0]] for r in df.select(textformat.parse_latlngs(F.col("t"))).collect()]
    assert got == [[(1.0, 2.0), (3.5, -4.0)], [], [None, (5.0, 6.0)]]
    r = random.Random(4)
    ids = sorted(cover.parent((r.randrange(6) << 61) + r.getrandbits(60) * 2 + 1, r.randint(0, 30)) for _ in range(50))
    assert coding.decode_cells(coding.encode_cells(ids)) == ids and coding.decode_cells(coding.encode_cells([])) == []
    numbers = [r.getrandbits(r.randint(0, 64)) for _ in range(80)]
    assert coding.decode_numbers(coding.encode_numbers(numbers)) == numbers
    chain = [shapes.from_degrees(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(20)]
    assert coding.decode_points(coding.encode_points(chain)) == chain
    assert [[math.isclose(a, b, abs_tol=1e-6) for a, b in zip(v, w, strict=True)] for v, w in zip(coding.decode_points(coding.encode_points(chain, 7)), chain, strict=True)] == [[True] * 3] * 20


def test_stream(spark, tmp_path):
    from sphera.streaming import tracks

    rows = [(i, f"2024-01-0{1 + i % 3} 10:00:00", i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long").select("event_id", F.to_timestamp("t").alias("ts"), "user_id")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = tracks.with_cells(spark.readStream.schema(df.schema).parquet(str(tmp_path / "events.parquet")))
    q = stream.writeStream.format("memory").queryName("tracks_test").start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: r.cell for r in spark.table("tracks_test").collect()}
    assert got == {r.event_id: r.cell for r in tracks.with_cells(df).collect()}


def test_crossing_edges_of_high_ids(spark, tmp_path):
    from sphera.plans import spatial
    from sphera.plans.base import points as positions

    spark.createDataFrame([(i,) for i in (*range(100), *range(10230, 10270), *range(14855, 14935))], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    rows = [(r.id, r.lat, r.lng) for r in positions(spark, str(tmp_path), "orders", "o_orderkey").collect() if abs(r.lat) < 85]

    def at(lat, lng):
        lat, lng = math.radians(lat), math.radians(lng)
        return (math.cos(lat) * math.cos(lng), math.cos(lat) * math.sin(lng), math.sin(lat))

    def side(a, b, p):
        return p[0] * (a[1] * b[2] - a[2] * b[1]) + p[1] * (a[2] * b[0] - a[0] * b[2]) + p[2] * (a[0] * b[1] - a[1] * b[0])

    ends = sorted((i, at(lat, lng), at(lat + 2, lng + 1 + (i + 1) % 5)) for i, lat, lng in rows)
    want = set()
    for (i, a, b), (j, p, q) in itertools.combinations(ends, 2):
        if sum((s - t) ** 2 for s, t in zip(a, p, strict=True)) < 0.1 and side(a, b, p) * side(a, b, q) < 0 and side(p, q, a) * side(p, q, b) < 0:
            want.add((i, j))
    assert any(j >= 3000 for _, j in want)
    assert {(r.a, r.b) for r in spatial.crossing_edges_join(spark, str(tmp_path)).collect()} == want


def test_tracks_hold_all_events(spark, tmp_path):
    from sphera.plans import shapes as plans

    spark.createDataFrame([(i, f"2026-01-01 00:{i:02d}:00", i % 2) for i in range(30)], "event_id long, ts string, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    tracks = {r.user_id: [tuple(p) for p in r.track] for r in plans._tracks(spark, str(tmp_path)).collect()}
    assert {k: len(t) for k, t in tracks.items()} == {0: 15, 1: 15}
    assert {r.user_id: r.n for r in plans.simplify(spark, str(tmp_path)).collect()} == {0: 15, 1: 15}
    assert shapes.align_cost(tracks[0], tracks[1]) == pytest.approx(shapes.align(tracks[0], tracks[1])[0])
    assert [round(shapes.align(tracks[0], tracks[1])[0], 6)] == [pytest.approx(r.cost) for r in plans.dtw_cost(spark, str(tmp_path)).collect()]


def test_ranges_and_denormalizing_of_all_rows(spark, tmp_path):
    from sphera.plans import spatial
    from sphera.plans.base import cell_points

    d = str(tmp_path)
    spark.createDataFrame([(i,) for i in range(200)], "c_custkey long").write.parquet(d + "/customer.parquet")
    spark.createDataFrame([(i, 1 + i % 50) for i in range(100)], "p_partkey long, p_size int").write.parquet(d + "/part.parquet")
    ids = {}
    for r in cell_points(spark, d, "customer", "c_custkey").collect():
        ids.setdefault(r.id % 10, []).append(unsigned(r.cell))
    assert max(max(v) for v in ids.values()) >= 1 << 63
    want = {k: str(max(v) // 2 + 1 - min(v) // 2) for k, v in ids.items()}
    assert {r.k: r.leaves for r in spatial.cells_from_range(spark, d).collect()} == want
    assert {r.id for r in spatial.union_denormalize(spark, d).collect()} == set(range(100))
