"""Small fixtures with known results."""

import math

import pytest
from pyspark.sql import functions as F

from citylattice.functions import dims, exprs, geometry
from citylattice.operators import importer, raster, rays, solar, vectors, voxels
from citylattice.sources import geodata, readers, sinks
from citylattice.streaming.weather import hourly

CELL = "i int, j int, bh double, bid long, segs array<struct<lo:double,hi:double>>, code int, z double, top double, bottom double"


def test_voxelise_small_model(spark):
    rows = [(i, j, 10.0 if (i, j) == (1, 1) else 0.0, int((i, j) == (1, 1)), [(0.0, 10.0)] if (i, j) == (1, 1) else [], 11, 0.0, 5.0 if (i, j) == (0, 0) else 0.0, 5.0 * dims.TRUNK_RATIO if (i, j) == (0, 0) else 0.0) for i in range(3) for j in range(3)]
    got = {(r.i, r.j, r.k): r.code for r in voxels.voxelise(spark.createDataFrame(rows, CELL)).collect()}
    assert got[1, 1, 0] == 11 and all(got[1, 1, k] == dims.BUILDING for k in range(1, 11))
    assert [got[0, 0, k] for k in range(1, 7)] == [0, 0, 0, -2, -2, 0]


def test_roofs_and_pilotis(spark):
    codes = [(2, 2, k, c) for k, c in enumerate([1, 0, 0, 0, -3, -3, -3, -3, 0, 0])] + [(0, 0, k, c) for k, c in enumerate([1] + [0] * 9)] + [(1, 1, k, c) for k, c in enumerate([1] + [-3] * 4 + [0] * 5)] + [(3, 3, k, c) for k, c in enumerate([9] + [0] * 9)]
    columns = voxels.packed(spark.createDataFrame(codes, "i int, j int, k int, code int"))
    assert {(r.i, r.k) for r in voxels.observers(columns).collect()} == {(2, 1), (0, 1), (1, None), (3, None)}
    assert {(r.i, r.k) for r in voxels.observers(columns, roofs=True).collect()} == {(2, 8), (0, 1), (1, 5), (3, None)}


BOX = "id long, i0 int, j0 int, i1 int, j1 int, height double"


def test_height_transfer(spark):
    need = spark.createDataFrame([(1, 0, 0, 4, 4, None)], BOX)
    weighted = spark.createDataFrame([(7, 0, 0, 2, 4, 10.0), (8, 3, 0, 4, 4, 40.0)], BOX)
    assert vectors.transfer_heights(need, weighted).first().height == pytest.approx(20.0)
    diluted = spark.createDataFrame([(7, 0, 0, 2, 4, 30.0), (8, 0, 0, 2, 4, 0.0)], BOX)
    assert vectors.transfer_heights(need, diluted).first().height == pytest.approx(15.0)
    assert vectors.transfer_heights(need, spark.createDataFrame([(7, 0, 0, 4, 4, 0.0)], BOX)).first().height is None


def test_axis_vectors(spark):
    rows = [(0.0, 0.0, 0.0), (90.0, 0.0, 0.0), (0.0, 90.0, 0.0), (30.0, 0.0, 30.0)]
    got = spark.createDataFrame(rows, "a double, e double, r double").select(*exprs.axis_vector(F.col("a"), F.col("e"), F.col("r"))).collect()
    for g, want in zip(got, [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0)]):
        assert tuple(g) == pytest.approx(want, abs=1e-12)


def test_sky(spark):
    p = solar.patches(spark)
    assert p.count() == 145 and p.agg(F.sum("solid")).first()[0] == pytest.approx(2 * math.pi)
    suns = spark.createDataFrame([(5.0, 5.0, 100.0), (6.0, 5.0, 200.0), (7.0, 5.0, 300.0), (7.0, -1.0, 900.0)], "az double, el double, dni double")
    assert [tuple(r) for r in solar.binned(suns).collect()] == [(0, 600.0, 3)]


def test_open_sky_is_one(spark):
    columns = spark.createDataFrame([(i, j, [1, 0, 0, 0]) for i in range(4) for j in range(4)], "i int, j int, codes array<int>")
    got = rays.view(voxels.observers(columns), rays.directions(spark, 8, 3, 0.0, 90.0), columns, (4, 4, 4)).collect()
    assert len(got) == 16 and all(r.value == pytest.approx(1.0) for r in got)


def test_ring_and_area(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 2), (0, 2)]])
    r = spark.range(1).select(exprs.inside_ring(F.lit(1.0), F.lit(1.0), ring), exprs.inside_ring(F.lit(5.0), F.lit(1.0), ring), exprs.shoelace(ring), exprs.inside_ring(F.lit(0.0), F.lit(0.0), F.slice(ring, 1, 2))).first()
    assert tuple(r) == (True, False, 8.0, False)


def test_weather_file(spark, tmp_path):
    head = "\n".join(["LOCATION"] * 8)
    line = lambda h, dni: ",".join(["2020", "1", "2", str(h), "60"] + ["0"] * 9 + [dni, "50"] + ["0"] * 19)
    (tmp_path / "x.epw").write_text(head + "\n" + line(1, "100") + "\n" + line(2, "bad") + "\n1,2\n")
    got = readers.read_epw(spark, str(tmp_path / "x.epw")).collect()
    assert [(r.ts.hour, r.dni, r.dhi) for r in got] == [(0, 100.0, 50.0), (1, None, 50.0)]


def test_groups_and_tiles(spark, tmp_path):
    (tmp_path / "m.obj").write_text("o a\nv 1 2 3\nf 1/1 2/2 3/3\no b\nv 4 5 6\n")
    got = readers.read_obj(spark, str(tmp_path / "m.obj")).where("kind <> 'o'").orderBy("line").collect()
    assert [(r.kind, r.grp, r.numbers) for r in got] == [("v", "a", [1.0, 2.0, 3.0]), ("f", "a", [1.0, 2.0, 3.0]), ("v", "b", [4.0, 5.0, 6.0])]
    assert spark.range(1).select(readers.dem_tile(F.lit("1.5,e,\n2,x,3\n"))).first()[0] == [[1.5, None, None], [2.0, None, 3.0]]


def test_features_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3.0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "id int, height double, ring array<struct<x:double,y:double>>")
    sinks.features(rows).write.text(str(tmp_path / "f"), compression="gzip")
    got = readers.read_features(spark, str(tmp_path / "f")).first()
    assert got.height == 3.0 and [tuple(p) for p in got.ring] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]


def test_tallest_wins_and_inner_clears(spark):
    cells = spark.createDataFrame([(0, j) for j in range(4)], "i int, j int")
    b = spark.createDataFrame([(1, 0, 0, 1, 2, 5.0, 0.0, False), (2, 0, 1, 1, 3, 9.0, 2.0, False), (3, 0, 2, 1, 3, 1.0, 0.0, True)], BOX + ", min_height double, inner boolean")
    got = {r.j: (r.bh, r.bid) for r in raster.tallest(cells, b).collect()}
    assert got == {0: (5.0, 1), 1: (9.0, 2), 2: (0.0, 0), 3: (0.0, 0)}
    assert {r.j: len(r.segs) for r in raster.segments(cells, b).collect()} == {0: 1, 1: 2, 2: 0, 3: 0}


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:{m}:00", 1.5) for h in (1, 2, 3) for m in (10, 40)], "t string, value double").select(F.to_timestamp("t").alias("ts"), "value")
    rows.write.parquet(str(tmp_path / "in"))
    q = hourly(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly(rows).collect()))
    finally:
        q.stop()


def test_nearest_of_all_reaches_far_and_straight_ahead(spark):
    cells = spark.createDataFrame([(0, 0), (40, 40)], "i int, j int")
    points = spark.createDataFrame([(6.5, 6.5, 1.0, 1), (7.5, 0.5, 2.0, 2), (0.5, 7.5, 3.0, 3)], "x double, y double, z double, ord long")
    assert {(r.i, r.j): r.z for r in raster.nearest_of_all(cells, points).collect()} == {(0, 0): 3.0, (40, 40): 1.0}


def test_obj_of_long_faces_and_names(spark, tmp_path):
    name, face = [f"n{i}" for i in range(150)], range(1, 251)
    (tmp_path / "long.obj").write_text("o " + " ".join(name) + "\nf " + " ".join(f"{i}/{i}" for i in face) + "\n")
    o, f = readers.read_obj(spark, str(tmp_path / "long.obj")).orderBy("line").collect()
    assert o.name == f.grp == " ".join(name) and f.numbers == [float(i) for i in face]


def plain_geodesic(lon1, lat1, lon2, lat2):
    """Vincenty's inverse formula in plain numbers."""
    f, a = 1 / 298.257223563, 6378137.0
    b = a * (1 - f)
    u1, u2, gap = math.atan((1 - f) * math.tan(math.radians(lat1))), math.atan((1 - f) * math.tan(math.radians(lat2))), math.radians(lon2 - lon1)
    lam = gap
    for _ in range(100):
        ss = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if ss == 0:
            return 0.0
        cs = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        s, sa = math.atan2(ss, cs), math.cos(u1) * math.cos(u2) * math.sin(lam) / ss
        c2 = 1 - sa * sa
        m = cs - 2 * math.sin(u1) * math.sin(u2) / c2 if c2 else 0.0
        c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
        lam = gap + (1 - c) * f * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1)))
    k = c2 * (a * a - b * b) / (b * b)
    big, small = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))), k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    return b * big * (s - small * ss * (m + small / 4 * (cs * (2 * m * m - 1) - small / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3))))


def test_distances_on_the_ellipsoid(spark):
    rows = [(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (139.7, 35.6, -74.0, 40.7), (5.0, 5.0, 5.0, 5.0), (-60.0, -50.0, 120.0, 30.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select(geometry.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).collect()
    assert [r.m for r in got] == pytest.approx([plain_geodesic(*r) for r in rows], abs=1e-3)
    assert got[0].m == pytest.approx(111319.4908, abs=1e-3) and got[1].m == pytest.approx(110574.3886, abs=1e-3)


RING = "array<struct<x:double,y:double>>"


def test_rectangles_in_order(spark):
    sw, nw, ne, se = (0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)
    rows = [(1, [sw, nw, ne, se]), (2, [ne, se, sw, nw]), (3, [sw, se, ne, nw]), (4, [sw, nw, ne, se, sw]), (5, [sw, nw, ne]), (6, [(500.0, 0.0), nw, ne, se])]
    got = {r.id: r.ring and [tuple(p) for p in r.ring] for r in geometry.canonical_rectangles(spark.createDataFrame(rows, f"id int, ring {RING}")).collect()}
    assert got == {1: [sw, nw, ne, se], 2: [sw, nw, ne, se], 3: [sw, nw, ne, se], 4: [sw, nw, ne, se], 5: None, 6: None}


def test_rings_from_ways(spark):
    ways = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0)]), (2, [(1.0, 1.0), (1.0, 0.0)]), (3, [(1.0, 1.0), (0.0, 0.0)]), (4, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]), (5, [(9.0, 9.0), (8.0, 8.0)])], f"way long, ring {RING}")
    members = spark.createDataFrame([(7, "outer", w) for w in (1, 2, 3, 4, 5)], "relation long, role string, way long")
    got = sorted([tuple(p) for p in r.ring] for r in geodata.rings_of_relations(members, ways).collect())
    assert got == [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]


def test_segments_there_and_back(spark):
    rows = [(i, j, [(float(n), n + 1.0) for n in range((i * j) % 3)]) for i in range(4) for j in range(5)]
    cells = spark.createDataFrame(rows, "i int, j int, segs array<struct<lo:double,hi:double>>")
    offsets = geodata.to_offsets(cells, ["i", "j"])
    flat, at = [], 0
    for _, _, segs in rows:
        for lo, hi in segs:
            flat.append((at, lo, hi))
            at += 1
    back = geodata.from_offsets(offsets, spark.createDataFrame(flat, "at long, lo double, hi double"), ["i", "j"]).collect()
    assert sorted((r.i, r.j, [tuple(s) for s in r.segs]) for r in back) == rows


def test_outside_air_leaves_pockets(spark):
    side = range(5)
    solid = {(i, j, k) for i in range(1, 4) for j in range(1, 4) for k in range(1, 4)} - {(2, 2, 2)}
    air = spark.createDataFrame([(i, j, k) for i in side for j in side for k in side if (i, j, k) not in solid], "i int, j int, k int")
    built = spark.createDataFrame(sorted(solid), "i int, j int, k int")
    outside = importer.outside_air(air, (5, 5, 5))
    assert outside.count() == 125 - 27 and outside.where("i = 2 and j = 2 and k = 2").count() == 0
    assert importer.hull(built, outside, (0, 1)).count() == 24 and importer.hull(built, outside, (2,)).count() == 18


def test_panes_and_meshes(spark):
    pane = [("flat", 3, j, k) for j in range(4) for k in range(3)] + [("line", 0, 0, k) for k in range(5)] + [("two", 0, 0, 0), ("two", 1, 1, 1)]
    assert {r.name: r.axis for r in importer.normal_axis(spark.createDataFrame(pane, "name string, i int, j int, k int")).collect()} == {"flat": 0, "line": None, "two": None}
    point = "struct<x:double,y:double,z:double>"
    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    faces = [("m", (*corners[0], z), (*corners[a], z), (*corners[a + 1], z)) for z in (1.0, 3.0) for a in (1, 2)]
    hits = importer.triangle_hits(spark.createDataFrame(faces, f"name string, a {point}, b {point}, c {point}"), (6, 6))
    assert sorted((r.i, r.j, r.k) for r in importer.filled(hits).collect()) == [(i, j, k) for i in range(4) for j in range(4) for k in (1, 2)]


def test_light_on_faces(spark):
    rows = [(0, 0, 1, 0.5, 0.8, False), (0, 0, -1, 0.5, 0.8, False), (1, 0, 0, None, 0.8, False), (1, 0, 0, 0.5, 0.8, True), (1, 0, 0, 0.5, None, False)]
    lit = solar.face_light(spark.createDataFrame(rows, "di int, dj int, dk int, svf double, through double, border boolean"), (0.6, 0.0, 0.8), 100.0, 10.0).collect()
    assert [(r.direct, r.diffuse) for r in lit] == [(pytest.approx(64.0), 5.0), (0.0, 5.0), (None, None), (None, None), (0.0, 5.0)]


def test_face_before_open_sky(spark):
    codes = [(i, j, [1, -3 if (i, j) == (2, 2) else 0, 0, 0, 0]) for i in range(5) for j in range(5)]
    columns = spark.createDataFrame(codes, "i int, j int, codes array<int>")
    faces = spark.createDataFrame([(2, 2, 1, 0, 0, 1), (2, 2, 1, 1, 0, 0)], "i int, j int, k int, di int, dj int, dk int")
    up = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.8, 0.0, 0.6)], "ray int, dx double, dy double, dz double")
    got = sorted((r.di, r.ray, round(r.angle, 6), r.through) for r in rays.face_transmissions(faces, up, columns, (5, 5, 5)).collect())
    assert got == [(0, 0, 1.0, 1.0), (0, 1, 0.6, 1.0), (1, 1, 0.8, 1.0)]


def covered_once(cells):
    """Greedy rectangles in plain Python."""
    left, out = set(cells), []
    for a, b in sorted(cells):
        if (a, b) in left:
            width = next(w for w in range(1, 100) if (a, b + w) not in left)
            height = next(h for h in range(1, 100) if any((a + h, b + x) not in left for x in range(width)))
            left -= {(a + y, b + x) for y in range(height) for x in range(width)}
            out.append((a, b, a + height, b + width))
    return sorted(out)


def test_greedy_rectangles(spark):
    planes = {"p": [(i, j) for i in range(8) for j in range(9) if (i * j) % 5 != 3], "q": [(0, 0), (0, 1), (1, 0), (2, 2)]}
    faces = spark.createDataFrame([(p, *c) for p, cells in planes.items() for c in cells], "plane string, a int, b int")
    got = voxels.rectangles(faces).collect()
    for p, cells in planes.items():
        assert sorted((r.a0, r.b0, r.a1, r.b1) for r in got if r.plane == p) == covered_once(cells)


def test_weather_location(spark, tmp_path):
    (tmp_path / "x.epw").write_text("LOCATION,Here, ,JPN,IWEC,476620,35.6,139.7,9.0,40.0\nother\n")
    assert tuple(geodata.read_epw_location(spark, str(tmp_path / "x.epw")).first()) == ("Here", "", "JPN", "476620", 35.6, 139.7, 9.0, 40.0)


def test_bases_and_unshared_corners(spark):
    row = spark.createDataFrame([(0.0, 3.0, 4.0), (0.0, 0.0, 2.0)], "a double, b double, c double")
    for r in row.select(*[F.array(*v) for v in rays.face_basis(F.col("a"), F.col("b"), F.col("c"))]).collect():
        for x in range(3):
            for y in range(3):
                assert sum(p * q for p, q in zip(r[x], r[y])) == pytest.approx(float(x == y))
    quads = spark.createDataFrame([(f, 1, [(float(x), float(f), 0.0) for x in range(4)]) for f in range(2)], "face long, material int, vertices array<struct<x:double,y:double,z:double>>")
    assert sinks.unshared(quads).select("vertex").distinct().count() == 8
    lines = [r.line for r in sinks.mesh_lines(quads).orderBy("ord").collect()]
    assert lines[0] == "v 0.000 0.000 0.000" and lines[-1] == "usemtl m1\nf 5 6 7 8" and len(lines) == 10
