"""Work that must grow no faster than its input: many rows at one place, within a time that pairs of all of them would exceed."""

import threading
from contextlib import contextmanager

from pyspark.sql import functions as F

from citylattice.functions import exprs, geometry
from citylattice.operators import importer, raster, selection, vectors
from citylattice.sources import geodata

COPIES = 60_000


@contextmanager
def limited(spark, seconds=60):
    """Jobs that still run after so many seconds are cancelled, which fails the test."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def stacked(spark, n=COPIES):
    """Footprints of ids from 1 at one place, the last one twice as wide."""
    return spark.range(1, n + 1).select("id", F.lit(2).alias("i0"), F.lit(2).alias("j0"), F.when(F.col("id") == n, 4).otherwise(3).alias("i1"), F.lit(3).alias("j1"), F.when(F.col("id") % 2 == 0, F.lit(8.0)).alias("height"))


def test_overlap_parents_of_many_equal_footprints(spark):
    with limited(spark):
        got = vectors.overlap_parents(stacked(spark)).groupBy("parent").agg(F.count(F.lit(1)).alias("n")).collect()
    assert [(r.parent, r.n) for r in got] == [(COPIES, COPIES - 1)]
    equal = vectors.overlap_parents(stacked(spark).where(F.col("id") < COPIES))
    with limited(spark):
        assert equal.agg(F.count(F.lit(1)), F.min("id"), F.max("parent")).first()[:] == (COPIES - 2, 2, 1)


def test_shapes_over_many_equal_rings(spark):
    box = lambda w, s, e, n: geometry.box_ring(F.struct(*[c.cast("double").alias(k) for c, k in zip((w, s, e, n), "wsen")]))
    homes = stacked(spark).select("id", box(F.col("i0"), F.col("j0"), F.col("i1"), F.col("j1")).alias("ring"))
    k = F.col("id")
    shapes = spark.range(100).select(box(k * 10 + 1, F.lit(1), k * 10 + 3.5, F.lit(4)).alias("ring"))
    with limited(spark):
        assert selection.drawn(homes, shapes, "within").agg(F.count(F.lit(1)), F.max("id")).first()[:] == (COPIES - 1, COPIES - 1)
        assert selection.drawn(homes, shapes, "intersect").count() == COPIES


def test_distances_on_the_ellipsoid_of_many_points(spark):
    k = F.col("id")
    rows = spark.range(400_000).select((k % 360 - 180.0).alias("x"), (k % 120 - 60.0).alias("y"))
    with limited(spark):
        got = rows.select(geometry.geodesic(F.col("x"), F.col("y"), F.col("x"), F.col("y") + 0.01).alias("m")).agg(F.count("m"), F.min("m"), F.max("m")).first()
    assert got[0] == 400_000 and 1105 < got[1] < got[2] < 1117
    assert spark.range(1).select(geometry.geodesic(F.lit(1.0), F.lit(None), F.lit(1.0), F.lit(2.0)).alias("m")).first().m is None


def test_heights_and_gaps_of_many_equal_footprints(spark):
    old, lone = stacked(spark), spark.createDataFrame([(COPIES + 7, 9, 9, 10, 10, 3.0), (COPIES + 5, 8, 8, 9, 9, 4.0)], "id long, i0 int, j0 int, i1 int, j1 int, height double")
    with limited(spark):
        got = vectors.transfer_heights(old, old).where("id % 2 = 1").groupBy(F.round("height", 3).alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()
        added = vectors.append_unmatched(old, old.unionByName(lone)).where(F.col("id") > COPIES).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(4.0, COPIES // 2)]
    assert [(r.id, r.height) for r in added] == [(COPIES + 1, 4.0), (COPIES + 2, 3.0)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_point_meets_all_stations_in_its_own_row(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 10.0)], "id long, lon double, lat double")
    stations = spark.createDataFrame([(7, 1.0, 0.0), (5, -1.0, 0.0), (9, 50.0, 11.0)], "station_id long, lon double, lat double")
    near = vectors.nearest_station(points, stations)
    assert "array_min" in plan(near) and "RepartitionByExpression [id" in plan(near)
    assert [(r.id, r.station_id) for r in near.orderBy("id").collect()] == [(1, 5), (2, 9)]
    assert vectors.nearest_station(points, stations.where("station_id > 9")).count() == 0


def test_hits_are_dealt_by_the_number_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(importer, "TASK_ROWS", 10)
    p = lambda x, y: F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (F.lit(1), "z"))])
    k, zero = F.col("id"), F.lit(0)
    hits = importer.triangle_hits(spark.range(35).select(F.concat(F.lit("m"), k % 5).alias("name"), p(zero, zero).alias("a"), p(F.lit(4), zero).alias("b"), p(zero, F.lit(4)).alias("c")), (6, 6))
    assert "RepartitionByExpression [name" in plan(hits) and plan(hits).count("], 4") >= 2
    assert hits.groupBy("name").count().select("count").distinct().collect() == [(10,)]


def test_points_of_a_place_and_equal_boxes_are_opened_once(spark):
    cells = spark.range(9).select((F.col("id") / 3).cast("int").alias("i"), (F.col("id") % 3).cast("int").alias("j"))
    points = spark.range(COPIES).select(F.lit(1.25).alias("x"), F.lit(1.5).alias("y"), F.col("id").cast("double").alias("z"), F.col("id").alias("ord"))
    boxes = spark.range(COPIES).select("id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.5).alias("x1"), F.lit(1.0).alias("y1"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 + 2.0).alias("height"))
    near, share = raster.nearest_sample(cells, points, 2), raster.covered_share(cells, boxes)
    for df in (near, share):
        # an aggregate stands below what opens rows
        assert plan(df).rindex("Aggregate") > plan(df).rindex("Generate")
    assert {r.z for r in near.collect()} == {COPIES - 1.0} == {r.z for r in raster.nearest_of_all(cells, points).collect()}
    got = {(r.i, r.j): (r.bh, r.bid) for r in share.collect()}
    assert got[0, 0] == got[1, 0] == (4.0, COPIES - 3) and got[2, 2] == (0.0, 0)


def test_a_clipped_ring_is_made_once_for_its_area(spark):
    box = geometry.box_ring(F.struct(*[c.cast("double").alias(k) for c, k in zip((F.col("id"), F.lit(1), F.col("id") + 2, F.lit(3)), "wsen")]))
    rings = spark.range(9).select("id", F.slice(box, 1, 4).alias("ring"))
    df = rings.withColumn("c", geodata.clipped(F.col("ring"), (2.5, 0.0, 6.0, 2.0))).select("id", exprs.shoelace(F.col("c")).alias("area")).where("area > 0")
    assert plan(df).count("flatten(") <= 2
    assert {r.id: r.area for r in df.collect()} == {1: 0.5, 2: 1.5, 3: 2.0, 4: 2.0, 5: 1.0}
