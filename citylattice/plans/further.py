"""Further registered queries: geometry, landed files, exports, selections, meshes, edits, sky and light."""

from __future__ import annotations

from pyspark.sql import functions as F

from citylattice.functions import dims, exprs
from citylattice.functions import geometry as G
from citylattice.operators import edits, importer, raster, rays, selection, solar, voxels
from citylattice.plans import adapters as A
from citylattice.plans.catalogue import FACES, OBSERVE, RAYS, SKY, SMALL, SMALL_SQL, TALL_SQL, THROUGH, _rays, _scene, _small_voxels, query, small_city
from citylattice.session import cut, spread
from citylattice.sources import geodata, sinks

N = A.N
ORIGIN, U, V = (100.0, 50.0), (1.0, -0.5), (0.5, 2.0)


def _customers(spark, d):
    return A.table(spark, d, "customer").withColumnRenamed("c_custkey", "k")


def _box_rings(spark, d):
    """Buildings as closed rings."""
    b = A.buildings(spark, d).where("i0 < i1 and j0 < j1")
    return b.withColumn("ring", G.box_ring(F.struct(F.col("i0").cast("double").alias("w"), F.col("j0").cast("double").alias("s"), F.col("i1").cast("double").alias("e"), F.col("j1").cast("double").alias("n"))))


REAL = "real AS (SELECT * FROM buildings WHERE i0 < i1 AND j0 < j1)"


# --- geometry ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, greatest(1, floor(p_retailprice / 5.0 + 0.5))::INT AS n, round(p_retailprice / greatest(1, floor(p_retailprice / 5.0 + 0.5)), 9) AS size FROM part", city=False)
def grid_sizes(spark, d):
    n, size = G.grid_size(F.col("p_retailprice"), 5.0)
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), n.alias("n"), F.round(size, 9).alias("size"))


@query("SELECT c_custkey AS id, round((c_custkey % 97 * 0.25 * 2.0 - c_custkey % 89 * 0.5 * 0.5) / 2.25, 9) + 0.0 AS a, round((c_custkey % 89 * 0.5 * 1.0 - c_custkey % 97 * 0.25 * -0.5) / 2.25, 9) + 0.0 AS b FROM customer", city=False)
def lonlat_to_metres(spark, d):
    k = F.col("k")
    a, b = G.to_metres(100.0 + k % 97 * 0.25, 50.0 + k % 89 * 0.5, ORIGIN, U, V)
    return _customers(spark, d).select(k.alias("id"), (F.round(a, 9) + 0.0).alias("a"), (F.round(b, 9) + 0.0).alias("b"))


@query("SELECT c_custkey AS id, round(100.0 + c_custkey % 31 * 1.0 + c_custkey % 17 * 0.5, 9) AS lon, round(50.0 + c_custkey % 31 * -0.5 + c_custkey % 17 * 2.0, 9) AS lat FROM customer", city=False)
def metres_to_lonlat(spark, d):
    k = F.col("k")
    lon, lat = G.from_metres(k % 31, k % 17, ORIGIN, U, V)
    return _customers(spark, d).select(k.alias("id"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("SELECT i, j, p::INT AS pos, round(100.0 + (i + a) * 2.0 * 1.0 + (j + b) * 3.0 * 0.5, 9) AS x, round(50.0 + (i + a) * 2.0 * -0.5 + (j + b) * 3.0 * 2.0, 9) AS y FROM cells, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) c(p, a, b)")
def cell_rings(spark, d):
    ring = G.cell_ring(F.col("i"), F.col("j"), ORIGIN, U, V, (2.0, 3.0))
    return A.cells(spark).select("i", "j", F.posexplode(ring).alias("pos", "p")).select("i", "j", "pos", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query("SELECT zone_id, zx - zr AS w, zy - zr AS s, zx + zr AS e, zy + zr AS n FROM zones")
def ring_bounds(spark, d):
    return A.zones(spark, d).select("zone_id", G.bounds(F.col("ring")).alias("b")).select("zone_id", "b.*")


@query("SELECT zone_id, 5 AS points, CASE WHEN diamond THEN zx - zr ELSE zx - zr END AS x4, CASE WHEN diamond THEN zy ELSE zy - zr END AS y4 FROM zones")
def closed_rings(spark, d):
    z = A.zones(spark, d).withColumn("c", G.closed(F.col("ring")))
    return z.select("zone_id", F.size("c").alias("points"), F.get("c", 4)["x"].alias("x4"), F.get("c", 4)["y"].alias("y4"))


@query("SELECT zone_id, CASE WHEN diamond THEN zy ELSE zy - zr END AS x0, zx - zr AS y0 FROM zones")
def swapped_rings(spark, d):
    return A.zones(spark, d).select("zone_id", F.get(G.swapped(F.col("ring")), 0).alias("p")).select("zone_id", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"))


DIGITS = "(c_custkey % 4)::VARCHAR || (c_custkey // 4 % 4)::VARCHAR || (c_custkey // 16 % 4)::VARCHAR || (c_custkey // 64 % 4)::VARCHAR"


@query(f"q AS (SELECT c_custkey AS id, {DIGITS} AS key, [c_custkey % 4, c_custkey // 4 % 4, c_custkey // 16 % 4, c_custkey // 64 % 4] AS v FROM customer) SELECT id, list_sum(list_transform(v, lambda a, i: (a % 2) * (1 << (4 - i)::INT)))::BIGINT AS x, list_sum(list_transform(v, lambda a, i: (a // 2) * (1 << (4 - i)::INT)))::BIGINT AS y, 4 AS level FROM q")
def quadkey_tiles(spark, d):
    k = F.col("k")
    key = F.concat(*[(F.floor(k / 4**e) % 4).cast("int").cast("string") for e in range(4)])
    return _customers(spark, d).select(k.alias("id"), G.tile_of_quadkey(key).alias("t")).select("id", "t.*")


@query("t AS (SELECT c_custkey AS id, c_custkey % 1024 AS x, c_custkey * 7 % 1024 AS y, 2 * pi() * 6378137.0 / 1024 AS z FROM customer) SELECT id, round(x * z - pi() * 6378137.0, 4) + 0.0 AS w, round(pi() * 6378137.0 - (y + 1) * z, 4) + 0.0 AS s, round((x + 1) * z - pi() * 6378137.0, 4) + 0.0 AS e, round(pi() * 6378137.0 - y * z, 4) + 0.0 AS n FROM t", city=False)
def tile_boxes(spark, d):
    k = F.col("k")
    return _customers(spark, d).select(k.alias("id"), G.tile_box(k % 1024, k * 7 % 1024, 10).alias("b")).select("id", *[(F.round(f"b.{c}", 4) + 0.0).alias(c) for c in "wsen"])


@query("b AS (SELECT c_custkey AS id, (c_custkey % 60 - 30) * 1.5 AS w, (c_custkey % 40 - 20) * 1.25 AS s FROM customer) SELECT id, x * 5.0::DOUBLE AS x, y * 5.0::DOUBLE AS y FROM b, range(-20, 30) p(x), range(-20, 30) q(y) WHERE x BETWEEN floor(w / 5) AND floor((w + 7) / 5) AND y BETWEEN floor(s / 5) AND floor((s + 4) / 5)", city=False)
def tiles_in_boxes(spark, d):
    w, s = (F.col("k") % 60 - 30) * 1.5, (F.col("k") % 40 - 20) * 1.25
    box = F.struct(w.alias("w"), s.alias("s"), (w + 7).alias("e"), (s + 4).alias("n"))
    return _customers(spark, d).select(F.col("k").alias("id"), F.explode(G.tiles_of(box, 5.0)).alias("t")).select("id", (F.col("t.x") + 0.0).alias("x"), (F.col("t.y") + 0.0).alias("y"))


MESH = "m AS (SELECT c_custkey AS id, 46 + c_custkey % 20 AS n1, 30 + c_custkey % 15 AS m1, c_custkey % 8 AS r, c_custkey // 8 % 8 AS c, c_custkey % 10 AS r2, c_custkey // 10 % 10 AS c2, c_custkey % 2 = 0 AS long FROM customer)"


@query(f"{MESH} SELECT id, round(100.0 + m1 + c / 8.0 + CASE WHEN long THEN c2 / 80.0 ELSE 0 END, 9) AS w, round(n1 * 40.0 / 60 + r / 12.0 + CASE WHEN long THEN r2 / 120.0 ELSE 0 END, 9) AS s, round(100.0 + m1 + c / 8.0 + CASE WHEN long THEN (c2 + 1) / 80.0 ELSE 1 / 8.0 END, 9) AS e, round(n1 * 40.0 / 60 + r / 12.0 + CASE WHEN long THEN (r2 + 1) / 120.0 ELSE 1 / 12.0 END, 9) AS n FROM m", city=False)
def mesh_codes(spark, d):
    k = F.col("k")
    digits = lambda *v: F.concat(*[x.cast("int").cast("string") for x in v])
    six = digits(46 + k % 20, 30 + k % 15, k % 8, F.floor(k / 8) % 8)
    code = F.when(k % 2 == 0, F.concat(six, digits(k % 10, F.floor(k / 10) % 10))).otherwise(six)
    return _customers(spark, d).select(k.alias("id"), G.mesh_box(code).alias("b")).select("id", *[F.round(f"b.{c}", 9).alias(c) for c in "wsen"])


@query("SELECT c_custkey AS id, round_even((c_custkey * 37 % 360 - 180) / 15.0, 0)::INT AS hours FROM customer", city=False)
def utc_hours(spark, d):
    return _customers(spark, d).select(F.col("k").alias("id"), G.utc_hours((F.col("k") * 37 % 360 - 180).cast("double")).cast("int").alias("hours"))


@query("SELECT n_nationkey AS id, CASE n_nationkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.01 WHEN 2 THEN 0.001 WHEN 3 THEN 0.3048 WHEN 4 THEN 0.0254 WHEN 5 THEN 1.0 END::DOUBLE AS scale FROM nation", city=False)
def unit_scales(spark, d):
    name = F.get(F.array(*map(F.lit, ("m", "cm", "MM", "ft", "in", "M", "yard"))), (F.col("n_nationkey") % 7).cast("int"))
    return A.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), G.unit_scale(name).alias("scale"))


@query("SELECT i, j, 47 - i AS flip, j AS ti, i AS tj, 47 - j AS ri, i AS rj, 47 - i AS row, j AS col FROM cells")
def layout_axes(spark, d):
    c = A.cells(spark).withColumns({"a": F.col("i"), "b": F.col("j")})
    flip = G.flipped(c, N).select("a", "b", F.col("i").alias("flip"))
    turn = G.transposed(c).select("a", "b", F.col("i").alias("ti"), F.col("j").alias("tj"))
    rot = G.rotated_raster(c, N).select("a", "b", F.col("i").alias("ri"), F.col("j").alias("rj"))
    up = G.north_up(c, N).select("a", "b", "row", "col")
    return flip.join(turn, ["a", "b"]).join(rot, ["a", "b"]).join(up, ["a", "b"]).withColumnsRenamed({"a": "i", "b": "j"})


@query(f"{SMALL_SQL} SELECT j AS a, nz - 1 - k AS b, i AS c, code, j * 1.0::DOUBLE AS x, i * 1.0::DOUBLE AS y FROM vox, nz WHERE code <> 0")
def editor_axes(spark, d):
    v = _small_voxels(spark, d)
    nk = v.agg(F.max("k") + 1).first()[0]
    s = G.scene(F.col("i").cast("double"), F.col("j").cast("double"), F.col("k").cast("double"))
    plain = v.where("code <> 0").withColumn("s", s)
    return G.editor_axes(plain, nk).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("k").alias("c"), "code", F.col("s.x").alias("x"), F.col("s.y").alias("y"))


PLACE = "p AS (SELECT c_custkey AS id, (c_custkey % 50 - 5) * 0.3048 AS a, (c_custkey % 40 - 4) * 0.3048 AS b, (c_custkey % 30 - 3) * 0.3048 AS c FROM customer), t AS (SELECT *, a * cos(radians(30)) - b * sin(radians(30)) + 2 AS east, a * sin(radians(30)) + b * cos(radians(30)) + 1 AS north FROM p)"


@query(f"{PLACE} SELECT id, round((10 + east * sin(radians(15)) + north * cos(radians(15))) / 2.0, 6) + 0.0 AS i, round((20 + east * cos(radians(15)) - north * sin(radians(15))) / 2.0, 6) + 0.0 AS j, round((5 + c + 0.5) / 2.0, 6) + 0.0 AS k FROM t", city=False)
def model_placement(spark, d):
    x, y, z = (F.col("k") % n for n in (50, 40, 30))
    at = G.placed(x, y, z, (5.0, 4.0, 3.0), (10.0, 20.0, 5.0), 30.0, 15.0, (2.0, 1.0, 0.5), G.UNITS["ft"], 2.0)
    return _customers(spark, d).select(F.col("k").alias("id"), *[(F.round(v, 6) + 0.0).alias(c) for v, c in zip(at, "ijk")])


@query("p AS (SELECT c_custkey AS id, (c_custkey * 37 % 360 - 180)::DOUBLE AS lon, (c_custkey * 17 % 140 - 70)::DOUBLE AS lat FROM customer) SELECT id, round(radians(lon) * 6378137.0, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) + 0.0 AS y FROM p", city=False)
def mercator_points(spark, d):
    x, y = G.mercator((F.col("k") * 37 % 360 - 180).cast("double"), (F.col("k") * 17 % 140 - 70).cast("double"))
    return _customers(spark, d).select(F.col("k").alias("id"), (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


@query()
def geodesic_grids(spark, d):
    """Grids of rectangles around points, by distances on the ellipsoid; tested against plain Python."""
    k = F.col("k")
    lon, lat = (k * 37 % 360 - 180).cast("double"), (k * 17 % 120 - 60).cast("double")
    ring = F.array(G.point(lon, lat), G.point(lon, lat + 0.01), G.point(lon + 0.02, lat + 0.01), G.point(lon + 0.02, lat))
    return G.with_geometry(_customers(spark, d).select(k.alias("id"), lon.alias("lon"), lat.alias("lat"), ring.alias("ring")), 25.0).select("id", "lon", "lat", "ni", "nj", F.round("di", 6).alias("di"), F.round("dj", 6).alias("dj"))


# --- landed files -----------------------------------------------------------------------------------------------------

TREES = "t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE WHEN p_partkey % 3 = 1 THEN p_size + 0.5 ELSE 10.0 END::DOUBLE AS h, CASE WHEN p_partkey % 4 = 0 THEN p_size / 4.0::DOUBLE END AS cr, CASE WHEN p_partkey % 5 = 0 THEN p_size / 10.0::DOUBLE END AS ci FROM part WHERE p_partkey % 7 <> 0)"


@query(f"{TREES} SELECT id AS node, h AS top_height, CASE WHEN 4.0 >= h THEN h * 0.4 ELSE 4.0 END::DOUBLE AS bottom_height, round(coalesce(cr, ci / 3.14159 * 15, h * 0.6), 9) AS crown_diameter FROM t", city=False)
def osm_trees(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    pairs = {"natural": F.when(p % 7 != 0, F.lit("tree")).otherwise(F.lit("wood")), "height": F.when(p % 3 == 0, F.concat(s.cast("string"), F.lit(" m"))).when(p % 3 == 2, F.lit("tall")), "est_height": F.when(p % 3 == 1, F.concat((s + 0.5).cast("string"), F.lit("M"))), "diameter_crown": F.when(p % 4 == 0, (s / 4).cast("string")), "circumference": F.when(p % 5 == 0, F.concat((s / 10).cast("string"), F.lit(" m")))}
    tags = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    nodes = A.table(spark, d, "part").select(p.alias("node"), tags.alias("tags"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    return geodata.trees_from_tags(nodes).select("node", "top_height", "bottom_height", F.round("crown_diameter", 9).alias("crown_diameter"))


@query("SELECT id, height, NULL::INT AS floors FROM buildings WHERE id % 2 = 0 UNION ALL SELECT id, NULL, i0 AS floors FROM buildings WHERE id % 2 = 1")
def stacked_footprints(spark, d):
    b = A.buildings(spark, d)
    return geodata.stacked(b.where("id % 2 = 0").select("id", "height"), b.where("id % 2 = 1").select("id", F.col("i0").alias("floors")))


@query("SELECT id, coalesce(CASE WHEN height > 0 THEN height END, CASE WHEN i0 % 9 > 0 THEN (i0 % 9) * 3.0 END, -1.0)::DOUBLE AS height FROM buildings")
def footprint_heights(spark, d):
    return A.buildings(spark, d).select("id", geodata.height_of(F.col("height"), F.col("i0") % 9, 3.0, -1.0).alias("height"))


@query(f"{REAL} SELECT id FROM real WHERE i0 <= 30.5 AND i1 >= 10.25 AND j0 <= 40 AND j1 >= 12")
def footprints_in_box(spark, d):
    return geodata.within_box(_box_rings(spark, d), (10.25, 12.0, 30.5, 40.0)).select("id")


@query(f"{REAL} SELECT id, round((least(i1, 30.5) - greatest(i0, 10.25)) * (least(j1, 40.0) - greatest(j0, 12.5)), 6)::DOUBLE AS area FROM real WHERE least(i1, 30.5) > greatest(i0, 10.25) AND least(j1, 40.0) > greatest(j0, 12.5)")
def clipped_footprints(spark, d):
    ring = geodata.clipped(F.expr("slice(ring, 1, 4)"), (10.25, 12.5, 30.5, 40.0))
    return spread(_box_rings(spark, d), "id").withColumn("c", ring).select("id", F.round(exprs.shoelace(F.col("c")), 6).alias("area")).where("area > 0")


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM buildings")
def numbered_footprints(spark, d):
    return geodata.numbered(A.buildings(spark, d).select("id"), "id", "n").select("id", "n")


@query("x AS (SELECT CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS id, id AS ord FROM buildings) SELECT ord, coalesce(id, (SELECT max(id) FROM x) + 1 + row_number() OVER (PARTITION BY id IS NULL ORDER BY ord) - 1) AS id FROM x")
def completed_ids(spark, d):
    b = A.buildings(spark, d).select(F.when(F.col("id") % 4 != 0, F.col("id")).alias("id"), F.col("id").alias("ord"))
    return geodata.with_ids(b).select("ord", "id")


@query("SELECT o_orderkey AS way FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)", city=False)
def ways_outside_relations(spark, d):
    members = A.table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("way"))
    return geodata.outside_relations(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("way")), members)


@query("SELECT month(ts)::INT AS month, hour(ts)::INT AS hour, round(avg(dni), 6) AS dni, round(avg(dhi), 6) AS dhi FROM suns GROUP BY 1, 2")
def typical_days(spark, d):
    return geodata.typical_days(A.suns(spark, d)).select("month", "hour", F.round("dni", 6).alias("dni"), F.round("dhi", 6).alias("dhi"))


@query("SELECT ts, dni FROM suns WHERE month(ts) * 100 + day(ts) >= 1220 OR month(ts) * 100 + day(ts) <= 115")
def weather_months(spark, d):
    return geodata.months_between(A.suns(spark, d), (12, 20), (1, 15)).select("ts", "dni")


@query("SELECT ts, round(cos(radians(el)) * cos(radians(az)), 9) + 0.0 AS north, round(cos(radians(el)) * sin(radians(az)), 9) + 0.0 AS east, round(sin(radians(el)), 9) AS up FROM suns WHERE el >= 5")
def daytime_suns(spark, d):
    s = geodata.daytime(A.suns(spark, d))
    return s.select("ts", (F.round("north", 9) + 0.0).alias("north"), (F.round("east", 9) + 0.0).alias("east"), F.round("up", 9).alias("up"))


@query("SELECT month(ts)::INT AS month, count(*) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2020-01-01 00:00:00', TIMESTAMP '2020-12-31 23:00:00', INTERVAL 1 HOUR)) AS ts) GROUP BY 1", city=False)
def year_hours(spark, d):
    return geodata.hours_of_year(spark, 2020).groupBy(F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (vec_id % 16) * 4 + p % 4 AS gx, (vec_id // 16) * 2 + p // 4 AS gy, embedding[p::INT + 1]::DOUBLE AS v FROM embeddings, range(8) t(p)", city=False)
def tile_mosaic(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = F.col("vec_id")
    tiles = A.table(spark, d, "embeddings").select((v % 16).alias("x"), F.floor(v / 16).alias("y"), F.array(F.slice(e, 1, 4), F.slice(e, 5, 4)).alias("rows"))
    return geodata.tile_pixels(tiles, 4, 2)


LAYERS = "r AS (SELECT l_orderkey % 48 AS gx, l_partkey % 48 AS gy, CASE WHEN l_linenumber % 3 <> 1 THEN l_quantity END AS v, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)"


def _layers(spark, d):
    return A.table(spark, d, "lineitem").select((F.col("l_orderkey") % 48).alias("gx"), (F.col("l_partkey") % 48).alias("gy"), F.when(F.col("l_linenumber") % 3 != 1, F.col("l_quantity")).alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query(f"{LAYERS} SELECT gx, gy, arg_min(v, (ord, v)) AS v FROM r WHERE v IS NOT NULL GROUP BY 1, 2", city=False)
def raster_mosaic(spark, d):
    return geodata.first_of(_layers(spark, d))


@query(f"{LAYERS}, a AS (SELECT gx, gy, max(v) AS v FROM r GROUP BY 1, 2), b AS (SELECT gx, gy, min(v) AS v FROM r WHERE ord % 2 = 0 GROUP BY 1, 2) SELECT gx, gy, a.v - b.v AS v FROM a JOIN b USING (gx, gy) WHERE a.v IS NOT NULL AND b.v IS NOT NULL", city=False)
def surface_heights(spark, d):
    r = _layers(spark, d)
    return geodata.difference(r.groupBy("gx", "gy").agg(F.max("v").alias("v")), r.where("ord % 2 = 0").groupBy("gx", "gy").agg(F.min("v").alias("v")))


@query("SELECT i, j, CASE WHEN (i + 2 * j) % 5 = 0 AND (i * j) % 3 = 1 THEN 9 ELSE (i * j) % 3 END::INT AS code FROM cells")
def sea_cells(spark, d):
    i, j = F.col("i"), F.col("j")
    return geodata.sea(A.cells(spark).withColumns({"code": (i * j % 3).cast("int"), "land": (i + 2 * j) % 5 != 0}), 1, 9).select("i", "j", "code")


@query(f"{TALL_SQL}, n AS (SELECT c.i, c.j, CASE WHEN coalesce(x.cleared, false) THEN 0 ELSE coalesce(x.n, 0) END::BIGINT AS n FROM cells c LEFT JOIN (SELECT i, j, count(*) FILTER (height > 0 AND NOT inner_) AS n, bool_or(inner_) AS cleared FROM cov GROUP BY 1, 2) x USING (i, j)) SELECT i, j, (coalesce(sum(n) OVER (ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\", n FROM n")
def segment_offsets(spark, d):
    s = raster.segments(A.cells(spark), A.buildings(spark, d))
    return geodata.to_offsets(s, ["i", "j"]).select("i", "j", F.col("offset").cast("long").alias("offset"), "n")


# --- exports ----------------------------------------------------------------------------------------------------------

CLASSES = [*dims.STANDARD[:5], "Moss and lichen", "Wet land", "Mangroves", *dims.STANDARD[8:]]
LANDUSE_CASE = "CASE lc - 1 " + " ".join(f"WHEN {i} THEN {sinks.LANDUSE.get(n, 4)}" for i, n in enumerate(CLASSES)) + " ELSE 4 END"


@query(f"{SMALL_SQL} SELECT i, j, (CASE WHEN bh > 0 THEN 10 WHEN tree THEN 9 ELSE {LANDUSE_CASE} END)::INT AS code FROM small")
def landuse_codes(spark, d):
    c = small_city(spark, d).withColumn("idx", F.col("code") - 1)
    return sinks.landuse_codes(c, CLASSES)


@query(f"{SMALL_SQL} SELECT 0::BIGINT AS ord, count(*) FILTER (tree)::VARCHAR AS line FROM small UNION ALL SELECT (j * 1000000 + i + 1)::BIGINT, (i + 1) || ' ' || (j + 1) || CASE WHEN tree THEN ' 2.0 4.0 1' ELSE ' 0.0 0.0 1' END FROM small")
def tree_lines(spark, d):
    return sinks.tree_lines(small_city(spark, d), 1)


@query("SELECT (j * 1000000 + i)::BIGINT AS ord, printf('%d %d %.7f %.8f', i + 1, j + 1, 139.5 + i * (0.94 / 47), 35.5 + j * (0.47 / 47)) AS line FROM cells")
def place_lines(spark, d):
    return sinks.place_lines(A.cells(spark), (139.5, 35.5, 140.44, 35.97), (N, N))


@query(f"{SMALL_SQL} SELECT i, j, CASE WHEN i IN (0, 47) OR j IN (0, 47) THEN 0 ELSE floor(bh / 2.0 + 0.5) * 2 END::DOUBLE AS bh, 0.0::DOUBLE AS z FROM small")
def model_grids(spark, d):
    return sinks.model_grids(small_city(spark, d), (N, N), 2.0).select("i", "j", "bh", "z")


@query("SELECT h::INT AS height, z::INT AS z, '     0,0,' || z || ',1.00000' AS line FROM range(1, 51) a(h), range(50) b(z) WHERE z < h AND z >= trunc(h * 0.5)", city=False)
def leaf_profiles(spark, d):
    return sinks.leaf_profile(spark.range(1, 51).select(F.col("id").cast("int").alias("height")), 0.5)


@query("SELECT h::INT AS height, printf('<PLANT3D><ID> H%02dW01 </ID><Description> H%02dW01 </Description><Height> %.5f </Height><Depth> %.5f </Depth></PLANT3D>', h, h, h::DOUBLE, h * 0.5::DOUBLE) AS line FROM range(1, 51) a(h)", city=False)
def plant_records(spark, d):
    return sinks.plant_records(spark.range(1, 51).select(F.col("id").cast("int").alias("height")), 0.5)


@query("p AS (SELECT p_partkey AS id, 1.0 + p_size % 3 AS a, 1.0 + p_size % 5 * 0.1 AS r, p_retailprice % 90 + 0.35 AS t FROM part) SELECT id, (SELECT min(n) FROM range(1, 200) q(n) WHERE CASE WHEN r = 1 THEN a * n ELSE a * (1 - pow(r, n)) / (1 - r) END > t)::BIGINT AS n FROM p", city=False)
def series_terms(spark, d):
    p = A.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), sinks.terms_beyond(1.0 + F.col("p_size") % 3, 1.0 + F.col("p_size") % 5 * 0.1, F.col("p_retailprice") % 90 + 0.35).alias("n"))


@query("SELECT i, array_to_string(list_transform(range(48), lambda x: '000000'), ',') AS line FROM (SELECT DISTINCT i FROM cells)")
def constant_matrix(spark, d):
    return sinks.constant_lines(A.cells(spark), "000000")


@query(f"{SMALL_SQL} SELECT code, (row_number() OVER (ORDER BY code) + 1)::INT AS n FROM (SELECT DISTINCT code FROM vox WHERE code <> 0)")
def palette_codes(spark, d):
    return sinks.dense_codes(_small_voxels(spark, d).where("code <> 0"), start=2)


@query(f"{SMALL_SQL} SELECT (i // 20)::INT AS bi, (j // 20)::INT AS bj, (k // 20)::INT AS bk, count(*) AS n, max(i % 20)::INT AS i1 FROM vox WHERE code <> 0 GROUP BY 1, 2, 3")
def voxel_blocks(spark, d):
    return sinks.blocks(_small_voxels(spark, d).where("code <> 0"), 20).groupBy("bi", "bj", "bk").agg(F.count(F.lit(1)).alias("n"), F.max("in_i").alias("i1"))


@query(f"{SMALL_SQL} SELECT code, sum(i * 2.0) AS y0, sum((j + 0.5) * 2.0) AS x1, sum((k + 0.5) * 2.0) AS z1 FROM vox WHERE code <> 0 GROUP BY 1")
def voxel_coordinates(spark, d):
    v = _small_voxels(spark, d).where("code <> 0")
    corner = sinks.coordinates(v, 2.0, False).groupBy("code").agg(F.sum("y").alias("y0"))
    return corner.join(sinks.coordinates(v, 2.0, True).groupBy("code").agg(F.sum("x").alias("x1"), F.sum("z").alias("z1")), "code")


@query("SELECT i, j, least(greatest(floor(((i * 7 + j * 3) % 50 - 5.0) / 40.0 * 10), 0), 9)::INT AS colour FROM cells")
def draped_colours(spark, d):
    g = A.cells(spark).withColumns({"value": (F.col("i") * 7 + F.col("j") * 3) % 50, "z": F.lit(0.0)})
    return sinks.draped(g, 5.0, 45.0, 10).select("i", "j", "colour")


# --- selections -------------------------------------------------------------------------------------------------------


@query(f"{REAL} SELECT id FROM real WHERE 20.5 > i0 AND 20.5 < i1 AND 17.5 > j0 AND 17.5 < j1")
def buildings_at_point(spark, d):
    return selection.containing(_box_rings(spark, d), 20.5, 17.5).select("id")


SHAPES = "shape AS (SELECT (n_nationkey * 17 % 48 + 0.25) AS w, (n_nationkey * 29 % 48 + 0.5) AS s, (n_nationkey * 17 % 48 + 6.75) AS e, (n_nationkey * 29 % 48 + 5.5) AS n FROM nation)"


def _shapes(spark, d):
    k = F.col("n_nationkey")
    w, s = (k * 17 % N + 0.25), (k * 29 % N + 0.5)
    return A.table(spark, d, "nation").select(G.box_ring(F.struct(w.alias("w"), s.alias("s"), (w + 6.5).alias("e"), (s + 5).alias("n"))).alias("ring"))


@query(f"{REAL}, {SHAPES} SELECT DISTINCT id FROM real, shape WHERE i0 > w AND i1 < e AND j0 > s AND j1 < n")
def buildings_within_shapes(spark, d):
    return selection.drawn(_box_rings(spark, d), _shapes(spark, d), "within")


@query(f"{REAL}, {SHAPES} SELECT DISTINCT id FROM real, shape WHERE i0 < e AND i1 > w AND j0 < n AND j1 > s")
def buildings_meeting_shapes(spark, d):
    return selection.drawn(_box_rings(spark, d), _shapes(spark, d), "intersect")


@query("m AS (SELECT i, j, i >= 12 AND i < 36 AND j >= 12 AND j < 36 AS a, i BETWEEN 5 AND 9 AS b, sqrt((i - 0.004 * 111320 * cos(radians(35.505)) / 20) ** 2 + (j - 0.003 * 110540 / 20) ** 2) <= 7.5 AS c FROM cells) SELECT 'middle' AS mask, count(*) AS cells, count(*) FILTER (a) AS chosen, min(i) FILTER (a) AS i0, max(j) FILTER (a) AS j1 FROM m UNION ALL SELECT 'range', count(*), count(*) FILTER (b), min(i) FILTER (b), max(j) FILTER (b) FROM m UNION ALL SELECT 'buffer', count(*), count(*) FILTER (c), min(i) FILTER (c), max(j) FILTER (c) FROM m")
def cell_masks(spark, d):
    masks = {"middle": selection.middle((N, N), 0.5), "range": selection.in_ranges((5, 9)), "buffer": selection.in_buffer((139.5, 35.5, 139.51, 35.51), (139.504, 35.503), 150.0, 20.0)}
    parts = [selection.mask_info(A.cells(spark).withColumn("mask", m)).select(F.lit(n).alias("mask"), "cells", "chosen", "i0", "j1") for n, m in masks.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT i, j, EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 61 - 5 = i AND o_custkey % 59 - 5 = j) AS mask FROM cells")
def listed_cells(spark, d):
    chosen = A.table(spark, d, "orders").select((F.col("o_orderkey") % 61 - 5).cast("int").alias("i"), (F.col("o_custkey") % 59 - 5).cast("int").alias("j"))
    return selection.from_list(A.cells(spark), chosen).select("i", "j", "mask")


@query(f"{SMALL_SQL}, {FACES} SELECT di, dj, count(*) AS n FROM face WHERE dk = 0 AND (abs(j + 0.5 + dj * 0.5 - 0) < 0.05 OR abs(j + 0.5 + dj * 0.5 - 48) < 0.05 OR abs(i + 0.5 + di * 0.5 - 0) < 0.05 OR abs(i + 0.5 + di * 0.5 - 48) < 0.05) GROUP BY 1, 2")
def border_faces(spark, d):
    x, y = F.col("j") + 0.5 + F.col("dj") * 0.5, F.col("i") + 0.5 + F.col("di") * 0.5
    f = voxels.faces(_small_voxels(spark, d)).where(selection.at_border(x, y, F.col("dk"), (0.0, 0.0, float(N), float(N)), 0.05))
    return f.groupBy("di", "dj").agg(F.count(F.lit(1)).alias("n"))


FACE_VALUES = "fv AS (SELECT i, j, k, di, dj, dk, bid, least(greatest(trunc(i + 0.5 + di * 0.5), 0), 47)::INT AS ci, least(greatest(trunc(j + 0.5 + dj * 0.5), 0), 47)::INT AS cj, (i * 3 + j + k)::DOUBLE AS value FROM face)"


def _face_values(spark, d):
    c = small_city(spark, d)
    f = voxels.faces(voxels.voxelise(c)).join(c.select("i", "j", "bid"), ["i", "j"])
    return f.withColumns({"x": F.col("j") + 0.5 + F.col("dj") * 0.5, "y": F.col("i") + 0.5 + F.col("di") * 0.5, "value": (F.col("i") * 3 + F.col("j") + F.col("k")).cast("double")})


@query(f"{SMALL_SQL}, {FACES}, {FACE_VALUES} SELECT bid, count(*) AS n, count(value) FILTER (ci % 2 = 0) AS kept FROM fv GROUP BY 1")
def masked_faces(spark, d):
    f = _face_values(spark, d).select("bid", "x", "y", "value")
    mask = A.cells(spark).withColumn("mask", F.col("i") % 2 == 0)
    return selection.masked_faces(f, mask, 1.0, (N, N)).groupBy("bid").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("kept"))


KINDS = "fk AS (SELECT *, CASE WHEN dk = 1 THEN 'roof' WHEN dk = -1 THEN 'bottom' ELSE 'wall' END AS kind, CASE WHEN dk = 0 THEN CASE WHEN di = 1 THEN 'N' WHEN di = -1 THEN 'S' WHEN dj = 1 THEN 'E' ELSE 'W' END END AS side FROM fv)"


@query(f"{SMALL_SQL}, {FACES}, {FACE_VALUES}, {KINDS} SELECT bid AS building, count(*) AS n FROM fk WHERE (kind = 'roof' OR bid = (SELECT max(bid) FROM small) OR side = 'N') AND NOT (kind = 'wall' AND side = 'S') GROUP BY 1")
def selected_faces(spark, d):
    f = _face_values(spark, d)
    n = [F.col(c).cast("double") for c in ("dj", "di", "dk")]
    faces = f.select(F.col("bid").alias("building"), exprs.surface_kind(*n).alias("kind"), exprs.wall_orientation(*n).alias("side"))
    top = small_city(spark, d).agg(F.max("bid")).first()[0]
    wanted = spark.createDataFrame([(None, "roof", None, False), (top, None, None, False), (None, None, "N", False), (None, "wall", "S", True)], "building long, kind string, side string, exclude boolean")
    return selection.selected_faces(faces, wanted).groupBy("building").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SMALL_SQL}, {FACES}, {FACE_VALUES}, w AS (SELECT bid AS zone_id, value, 1 + (k % 3) AS area FROM fv) SELECT zone_id, count(*) AS cell_count, count(*) AS valid_count, round(sum(value * area) / sum(area), 6) AS mean, min(value) AS min, max(value) AS max, round(sqrt(greatest(sum(value * value * area) / sum(area) - (sum(value * area) / sum(area)) ** 2, 0)), 4) AS std FROM w GROUP BY 1")
def face_zone_stats(spark, d):
    f = _face_values(spark, d).select(F.col("bid").alias("zone_id"), "value", (1 + F.col("k") % 3).alias("area"))
    return selection.weighted_stats(f).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 4)})


@query("s AS (SELECT l_linenumber % 3 AS axis, round(l_suppkey % 10 + 0.0, 6) AS a, 0.0::DOUBLE AS b, l_quantity AS s, l_quantity + l_discount * 10 AS e FROM lineitem WHERE l_discount > 0), o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY axis, a, b ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-6 THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY axis, a, b ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT axis, a, b, round(min(s), 6) AS start, round(max(e), 6) AS \"end\" FROM g GROUP BY axis, a, b, island", city=False)
def merged_edges(spark, d):
    s = A.table(spark, d, "lineitem").where("l_discount > 0").select((F.col("l_linenumber") % 3).alias("axis"), (F.col("l_suppkey") % 10 + 0.0).alias("a"), F.lit(0.0).alias("b"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_discount") * 10).alias("end"))
    return selection.merged_segments(s).withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'skip' WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'window' ELSE 'building' END AS role FROM part", city=False)
def group_roles(spark, d):
    p = F.col("p_partkey")
    name = F.when(p % 11 == 0, F.lit("roof")).when(p % 3 == 0, F.lit("North Window 1")).otherwise(F.lit("wall"))
    material = F.when(p % 5 == 0, F.lit("dark GLASS"))
    return A.table(spark, d, "part").select(p.alias("id"), selection.role(name, material, {"roof": "skip"}).alias("role"))


@query("SELECT n_nationkey AS id, ((dayofyear(make_date(2019, (n_nationkey % 12 + 1)::INT, 15)) - 1) * 24 + 7)::INT AS first, ((dayofyear(make_date(2019, (n_nationkey % 12 + 1)::INT, 20)) - 1) * 24 + 19)::INT AS last FROM nation", city=False)
def hour_windows(spark, d):
    month = F.format_string("%02d", (F.col("n_nationkey") % 12 + 1).cast("int"))
    a, b = selection.hour_window(F.concat(month, F.lit("-15 06:30:00")), F.concat(month, F.lit("-20 18:00:00")), 2019)
    return A.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), a.cast("int").alias("first"), b.cast("int").alias("last"))


# --- meshes -----------------------------------------------------------------------------------------------------------

TRI = "tri AS (SELECT p_partkey AS name, (p_partkey * 7 % 44)::DOUBLE + 0.125 AS ax, (p_partkey * 13 % 44)::DOUBLE + 0.25 AS ay, (p_size % 10)::DOUBLE AS az, (p_partkey * 7 % 44)::DOUBLE + 5.375 AS bx, (p_partkey * 13 % 44)::DOUBLE + 0.75 AS by_, (p_size % 7)::DOUBLE AS bz, (p_partkey * 7 % 44)::DOUBLE + 1.625 AS cx, (p_partkey * 13 % 44)::DOUBLE + 5.875 AS cy, (p_size % 5)::DOUBLE AS cz FROM part)"


@query(f"{TRI}, w AS (SELECT name, i, j, az, bz, cz, (bx - i - 0.5) * (cy - j - 0.5) - (cx - i - 0.5) * (by_ - j - 0.5) AS u, (cx - i - 0.5) * (ay - j - 0.5) - (ax - i - 0.5) * (cy - j - 0.5) AS v, (ax - i - 0.5) * (by_ - j - 0.5) - (bx - i - 0.5) * (ay - j - 0.5) AS w FROM tri JOIN cells ON i + 0.5 BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND j + 0.5 BETWEEN least(ay, by_, cy) AND greatest(ay, by_, cy)) SELECT DISTINCT name, i, j, round((u * az + v * bz + w * cz) / (u + v + w), 6) + 0.0 AS z FROM w WHERE u + v + w <> 0 AND (u >= 0 AND v >= 0 AND w >= 0 OR u <= 0 AND v <= 0 AND w <= 0)")
def mesh_columns(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    x, y = (p * 7 % 44).cast("double"), (p * 13 % 44).cast("double")
    at = lambda a, b, z: F.struct((x + a).alias("x"), (y + b).alias("y"), z.cast("double").alias("z"))
    t = A.table(spark, d, "part").select(p.alias("name"), at(0.125, 0.25, s % 10).alias("a"), at(5.375, 0.75, s % 7).alias("b"), at(1.625, 5.875, s % 5).alias("c"))
    return importer.triangle_hits(t, (N, N)).select("name", "i", "j", (F.round("z", 6) + 0.0).alias("z"))


BUILT = "sol AS (SELECT i, j, k FROM vox WHERE code = -3)"


@query(f"{SMALL_SQL}, {BUILT} SELECT s.i, s.j, s.k FROM sol s WHERE NOT EXISTS (SELECT 1 FROM sol t WHERE t.i = s.i + 1 AND t.j = s.j AND t.k = s.k) OR NOT EXISTS (SELECT 1 FROM sol t WHERE t.i = s.i - 1 AND t.j = s.j AND t.k = s.k)")
def exposed_walls(spark, d):
    return importer.exposed(_small_voxels(spark, d).where(F.col("code") == dims.BUILDING), 0)


@query(f"{SMALL_SQL}, {BUILT} SELECT DISTINCT s.i, s.j, s.k FROM sol s, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(di, dj) JOIN vox v ON v.i = s.i + di AND v.j = s.j + dj AND v.k = s.k WHERE v.code <> -3")
def outer_walls(spark, d):
    """Walls next to air that is joined with the outside; streets and roofs join all air here."""
    v = _small_voxels(spark, d)
    solid = v.where(F.col("code") == dims.BUILDING).select("i", "j", "k")
    air = importer.outside_air(v.where(F.col("code") != dims.BUILDING), (N, N, v.agg(F.max("k") + 1).first()[0]))
    return importer.hull(solid, air, (0, 1))


@query(f"{SMALL_SQL}, {BUILT}, pane AS (SELECT DISTINCT (p_partkey * 5 % 48)::INT AS pi, (p_partkey * 11 % 48)::INT AS pj, (1 + p_size % 4)::INT AS pk FROM part), met AS (SELECT pi, pj, pk, arg_min((i, j, k), ((i - pi) ** 2 + (j - pj) ** 2 + (k - pk) ** 2, i, j, k)) AS m FROM pane JOIN sol ON abs(i - pi) <= 1 AND abs(j - pj) <= 1 AND abs(k - pk) <= 1 GROUP BY 1, 2, 3) SELECT DISTINCT m[1] AS i, m[2] AS j, m[3] AS k, -16 AS code FROM met")
def snapped_windows(spark, d):
    p = F.col("p_partkey")
    panes = A.table(spark, d, "part").select((p * 5 % N).cast("int").alias("i"), (p * 11 % N).cast("int").alias("j"), (1 + F.col("p_size") % 4).cast("int").alias("k"))
    return importer.stamped_windows(panes, _small_voxels(spark, d).where(F.col("code") == dims.BUILDING))


@query(f"{SMALL_SQL}, occ AS (SELECT p_name AS name, (p_partkey * 5 % 48)::INT AS i, (p_partkey * 11 % 48)::INT AS j, (1 + p_size % 9)::INT AS k FROM part WHERE p_name IS NOT NULL), nm AS (SELECT name, row_number() OVER (ORDER BY name) AS n FROM (SELECT DISTINCT name FROM occ)), h AS (SELECT i, j, max(n) AS n, max(k) + 1 AS high FROM occ JOIN nm USING (name) GROUP BY 1, 2) SELECT s.i, s.j, CASE WHEN h.n IS NULL THEN s.bid ELSE (SELECT max(bid) FROM small) + h.n END AS bid, CASE WHEN h.n IS NULL THEN s.bh ELSE greatest(s.bh, high - 1) END::DOUBLE AS bh FROM small s LEFT JOIN h USING (i, j)")
def stamped_buildings(spark, d):
    p = F.col("p_partkey")
    occ = A.table(spark, d, "part").where("p_name is not null").select(F.col("p_name").alias("name"), (p * 5 % N).cast("int").alias("i"), (p * 11 % N).cast("int").alias("j"), (1 + F.col("p_size") % 9).cast("int").alias("k"))
    return importer.stamped(small_city(spark, d), occ).select("i", "j", "bid", "bh")


@query(f"{SMALL_SQL} SELECT 48 AS ni, 48 AS nj, (max(bh + CASE WHEN tree THEN 4 ELSE 0 END) + 1)::INT AS nk, (48 * 48 * (max(bh + CASE WHEN tree THEN 4 ELSE 0 END) + 1))::BIGINT AS bytes FROM small")
def model_size(spark, d):
    return importer.levels_needed(small_city(spark, d))


@query("SELECT (i2)::INT AS i, (j2)::INT AS j, (c.i * 100 + c.j)::INT AS v FROM range(20) a(i2), range(31) b(j2) JOIN cells c ON c.i = round_even(i2 * (47.0 / 19), 0) AND c.j = round_even(j2 * (47.0 / 30), 0)")
def resized_grid(spark, d):
    return importer.resized(A.cells(spark).withColumn("v", F.col("i") * 100 + F.col("j")), (N, N), (20, 31))


CANOPY = "g AS (SELECT i, j, bh, (i * 3 + j * 7) % 3 <> 0 AS t, ((i * 13 + j * 17) % 45)::DOUBLE AS v FROM small), u AS (SELECT *, CASE WHEN t THEN CASE WHEN v < 2 THEN 10.0 WHEN v > 35 THEN 35.0 ELSE v END END AS top FROM g), nb AS (SELECT a.i, a.j, max(b.bh) AS roof, count(b.top) AS n, quantile_cont(b.top, 0.5) AS mid FROM u a JOIN u b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2)"


@query(f"{SMALL_SQL}, {CANOPY} SELECT i, j, CASE WHEN t AND (roof > 0 AND abs(top - roof) <= 5 OR n >= 4 AND top > mid + 12 OR roof > 0 AND n <= 2 AND top >= 20) THEN 10.0 ELSE top END::DOUBLE AS top FROM u JOIN nb USING (i, j)")
def checked_canopy(spark, d):
    i, j = F.col("i"), F.col("j")
    g = small_city(spark, d).select("i", "j", "bh", F.when((i * 3 + j * 7) % 3 != 0, 5).otherwise(1).alias("code"), ((i * 13 + j * 17) % 45).cast("double").alias("v"))
    tops = importer.canopy_from_surface(g, 5).withColumnRenamed("top", "t")
    return importer.checked_canopy(g.join(tops, ["i", "j"]).select("i", "j", "bh", (F.col("code") == 5).alias("tree"), F.col("t").alias("top")))


PIXELS = "px AS (SELECT l_orderkey % 48 AS i, l_partkey % 48 AS j, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


@query(f"{PIXELS}, cov2 AS (SELECT id, i, unnest(range(j0, j1)) AS j FROM (SELECT *, unnest(range(i0, i1)) AS i FROM buildings WHERE i0 < i1 AND j0 < j1 AND (height IS NULL OR height <= 0))), m AS (SELECT id, avg(v) AS m FROM cov2 JOIN px USING (i, j) GROUP BY 1) SELECT b.id, round(CASE WHEN b.height > 0 THEN b.height ELSE m.m END, 6) AS height FROM buildings b LEFT JOIN m USING (id)")
def raster_heights(spark, d):
    px = A.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % N).cast("int").alias("i"), (F.col("l_partkey") % N).cast("int").alias("j")).agg(F.avg("l_quantity").alias("v"))
    return importer.mean_under(A.buildings(spark, d), px).select("id", F.round("height", 6).alias("height"))


# --- edits ------------------------------------------------------------------------------------------------------------


@query(f"{SMALL_SQL}, e AS (SELECT (o_orderkey % 50)::INT AS i, (o_custkey % 50)::INT AS j, arg_max(o_orderkey % 9, o_orderkey)::DOUBLE AS t FROM orders GROUP BY 1, 2) SELECT s.i, s.j, coalesce(e.t, CASE WHEN tree THEN 4 ELSE 0 END)::DOUBLE AS top, coalesce(e.t / 2, CASE WHEN tree THEN 2 ELSE 0 END)::DOUBLE AS bottom FROM small s LEFT JOIN e USING (i, j)")
def edited_trees(spark, d):
    o = F.col("o_orderkey")
    e = A.table(spark, d, "orders").select((o % 50).cast("int").alias("i"), (F.col("o_custkey") % 50).cast("int").alias("j"), (o % 9).cast("double").alias("top"), (o % 9 / 2).alias("bottom"), o.alias("ord"))
    return edits.set_trees(small_city(spark, d), e).select("i", "j", "top", "bottom")


ESRI = ["No Data", "Water", "Tree", "Rangeland", "Wet land", "Road"]
PAINTED = "CASE nc " + " ".join(f"WHEN {n} THEN {ESRI.index(name)}" for n, name in enumerate(dims.STANDARD, 1) if name in ESRI) + " ELSE nc END"


@query(f"{SMALL_SQL}, e AS (SELECT (o_orderkey % 50)::INT AS i, (o_custkey % 50)::INT AS j, arg_max(o_orderkey % 14 + 1, o_orderkey) AS nc FROM orders GROUP BY 1, 2) SELECT s.i, s.j, (CASE WHEN e.i IS NULL THEN lc ELSE {PAINTED} END)::INT AS code FROM small s LEFT JOIN e USING (i, j)")
def painted_classes(spark, d):
    o = F.col("o_orderkey")
    e = A.table(spark, d, "orders").select((o % 50).cast("int").alias("i"), (F.col("o_custkey") % 50).cast("int").alias("j"), (o % 14 + 1).cast("int").alias("code"), o.alias("ord"))
    return edits.paint_classes(small_city(spark, d), e, ESRI).select("i", "j", "code")


# --- sky and light ----------------------------------------------------------------------------------------------------

EDGES = [0.0, *[b[0] for b in dims.TREGENZA]]
HALVED = ", ".join(f"({EDGES[b] + s * (EDGES[b + 1] - EDGES[b]) / 2}, {EDGES[b] + (s + 1) * (EDGES[b + 1] - EDGES[b]) / 2}, {max(1, n * 2 * (s + 1) // 2) if b == 7 else n * 2})" for b, (_, n, _) in enumerate(dims.TREGENZA) for s in range(2))


def _rounded(df):
    return df.select("patch", F.round("az", 6).alias("az"), F.round("el", 6).alias("el"), F.round("solid", 9).alias("solid"))


@query(f"b AS (SELECT *, row_number() OVER (ORDER BY lo) AS o FROM (VALUES {HALVED}) t(lo, hi, n)), f AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM b) SELECT (first + p)::INT AS patch, round((p + 0.5) * 360.0 / n, 6) AS az, round((lo + hi) / 2.0, 6)::DOUBLE AS el, round(2 * pi() * (sin(radians(hi)) - sin(radians(lo))) / n, 9) AS solid FROM f, range(60) t(p) WHERE p < n", city=False)
def sky_reinhart(spark, d):
    return _rounded(solar.sky(spark, "reinhart", factor=2))


@query("SELECT (b * 36 + p)::INT AS patch, round((p + 0.5) * 10.0, 6)::DOUBLE AS az, (b * 10 + 5.0)::DOUBLE AS el, round(2 * pi() * (sin(radians(b * 10 + 10)) - sin(radians(b * 10))) / 36, 9) AS solid FROM range(9) q(b), range(36) t(p)", city=False)
def sky_uniform(spark, d):
    return _rounded(solar.sky(spark, "uniform"))


@query("SELECT p::INT AS patch, round(degrees(p * pi() * (3.0 - sqrt(5.0))) % 360.0, 6) AS az, round(degrees(asin((p + 0.5) / 145)), 6) AS el, round(2 * pi() / 145, 9) AS solid FROM range(145) t(p)", city=False)
def sky_fibonacci(spark, d):
    return _rounded(solar.sky(spark, "fibonacci"))


@query("SELECT (b * 8 + p)::INT AS ray, round(sin((b + 0.5) * pi() / 10) * sin((p + 0.5) * pi() / 4), 9) AS dx, round(sin((b + 0.5) * pi() / 10) * cos((p + 0.5) * pi() / 4), 9) AS dy, round(cos((b + 0.5) * pi() / 10), 9) AS dz, round(pi() / 4 * (cos(b * pi() / 10) - cos((b + 1) * pi() / 10)), 9) AS solid FROM range(5) q(b), range(8) t(p)", city=False)
def hemisphere_grid(spark, d):
    return solar.hemisphere(spark, 8, 10).select("ray", *[F.round(c, 9).alias(c) for c in ("dx", "dy", "dz", "solid")])


@query("SELECT ts, round(cos(radians(el)) * cos(radians(az - 12.5)), 9) + 0.0 AS dx, round(cos(radians(el)) * sin(radians(az - 12.5)), 9) + 0.0 AS dy, round(sin(radians(el)), 9) AS cos_zenith FROM suns")
def sun_vectors(spark, d):
    x, y, _, z = solar.sun_vector(F.col("az"), F.col("el"), 12.5)
    return A.suns(spark, d).select("ts", (F.round(x, 9) + 0.0).alias("dx"), (F.round(y, 9) + 0.0).alias("dy"), F.round(z, 9).alias("cos_zenith"))


@query("b AS (SELECT (least(floor(el / 10), 8) * 36 + floor(az / 10))::INT AS patch, sum(dni) AS dni FROM suns WHERE el > 0 GROUP BY 1) SELECT (q.b * 36 + t.p)::INT AS patch, coalesce(b.dni, 0.0)::DOUBLE AS direct, round(1000.0 * (sin(radians(q.b * 10 + 10)) - sin(radians(q.b * 10))) / 36, 6) AS diffuse FROM range(9) q(b), range(36) t(p) LEFT JOIN b ON b.patch = q.b * 36 + t.p")
def patch_weights(spark, d):
    bins = A.suns(spark, d).where("el > 0").groupBy((F.least(F.floor(F.col("el") / 10), F.lit(8)) * 36 + F.floor(F.col("az") / 10)).cast("int").alias("patch")).agg(F.sum("dni").alias("dni"))
    return solar.patch_weights(bins, solar.sky(spark, "uniform"), 1000.0).select("patch", "direct", F.round("diffuse", 6).alias("diffuse"))


def _light(spark, d):
    columns, standing, shape = _scene(spark, d)
    r = _rays(spark, 5.0, 35.0)
    return rays.transmissions(standing, r, columns, shape), r


SVF = "svf AS (SELECT i, j, avg(t) AS value FROM tr GROUP BY 1, 2)"


@query(f"{SMALL_SQL}, {OBSERVE}, {SKY}, {THROUGH}, {SVF} SELECT i, j, round(value * 120, 6) AS diffuse FROM svf")
def diffuse_map(spark, d):
    hits, _ = _light(spark, d)
    svf = hits.groupBy("i", "j").agg(F.avg("through").alias("value"))
    return solar.diffuse(svf, 120.0).withColumn("diffuse", F.round("diffuse", 6))


@query(f"{SMALL_SQL}, {OBSERVE}, {SKY}, {THROUGH}, {SVF} SELECT i, j, round(value * 120 + max(t) FILTER (ray = 5) * 800.0 * sin(radians(75.0)), 6) AS total FROM svf JOIN tr USING (i, j) GROUP BY i, j, value")
def global_map(spark, d):
    """Direct light of one sun position and diffuse light of the sky."""
    hits, r = _light(spark, d)
    svf = hits.groupBy("i", "j").agg(F.avg("through").alias("value"))
    direct = hits.join(r.where("ray = 5"), "ray").select("i", "j", (F.col("through") * 800.0 * F.col("dz")).alias("direct"))
    return solar.both(direct, solar.diffuse(svf, 120.0)).withColumn("total", F.round("total", 6))


@query(f"{SMALL_SQL}, {OBSERVE}, {SKY}, {THROUGH}, {SVF} SELECT i, j, round(value * 500 + sum(t * (ray % 4 + 1) * sin(radians(5.0 + ray % 3 * 35.0))), 6) AS energy FROM svf JOIN tr USING (i, j) GROUP BY i, j, value")
def cumulative_global(spark, d):
    hits, r = _light(spark, d)
    bins = r.select(F.col("ray").alias("patch"), (F.col("ray") % 4 + 1).cast("double").alias("dni"), "dz")
    svf = hits.groupBy("i", "j").agg(F.avg("through").alias("value"))
    return solar.cumulative_both(hits.withColumnRenamed("ray", "patch"), bins, svf, 500.0).withColumn("energy", F.round("energy", 6))


@query(f"{SMALL_SQL}, {OBSERVE}, {SKY}, {THROUGH} SELECT i, j, coalesce(sum(ray % 4 + 1) FILTER (t > 0.0), 0)::BIGINT AS hours FROM tr GROUP BY 1, 2")
def sunlight_map(spark, d):
    hits, r = _light(spark, d)
    hours = r.select(F.col("ray").alias("patch"), (F.col("ray") % 4 + 1).cast("long").alias("hours"))
    return solar.hours_seen(hits.withColumnRenamed("ray", "patch"), hours)


TREES_SEEN = RAYS.format(lo=-24.0, ne=3, st=20.0, sa=51.0, n=21, m=SMALL)


@query(f"{SMALL_SQL}, {OBSERVE}, {TREES_SEEN}, w AS (SELECT i, j, ray, min(t) FILTER (code IN (-2, 2, 5, 6, 7, 8)) AS hit, min(t) FILTER (code <> 0 AND code NOT IN (-2, 2, 5, 6, 7, 8)) AS stop FROM step GROUP BY 1, 2, 3), x AS (SELECT w.*, s.code, exp(-0.6 * s.len) AS th FROM w LEFT JOIN step s ON s.i = w.i AND s.j = w.j AND s.ray = w.ray AND s.t = w.hit) SELECT i, j, round(avg(CASE WHEN hit IS NOT NULL AND (stop IS NULL OR hit < stop) AND code = -2 AND th >= 0.01 THEN 1.0 - th ELSE 0.0 END), 6) AS value FROM x GROUP BY 1, 2")
def view_index_trees(spark, d):
    """Green view with trees as targets: a ray counts by what the first tree voxel takes of it."""
    columns, standing, shape = _scene(spark, d)
    return rays.view(standing, _rays(spark, -24.0, 20.0), columns, shape, targets=(-2, 2, 5, 6, 7, 8), inclusion=True).withColumn("value", F.round("value", 6))


@query(f"{SMALL_SQL}, {OBSERVE}, {TREES_SEEN}, f AS (SELECT i, j, ray, arg_min(code, t) FILTER (code NOT IN (0, -2)) AS code FROM step GROUP BY 1, 2, 3) SELECT code, count(*) AS n FROM f GROUP BY 1")
def first_hits(spark, d):
    columns, standing, shape = _scene(spark, d)
    return rays.first_hit(standing, _rays(spark, -24.0, 20.0), columns, shape).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


PAIRS = "pr AS (SELECT s_suppkey AS pair, (s_suppkey * 7 % 48)::INT AS i, (s_suppkey * 5 % 48)::INT AS j, 6 AS k, (s_suppkey * 11 % 48)::INT AS ti, (s_suppkey * 13 % 48)::INT AS tj, 2 AS tk FROM supplier), pl AS (SELECT *, greatest(abs(ti - i), abs(tj - j), abs(tk - k)) AS n, sqrt((ti - i) ** 2 + (tj - j) ** 2 + (tk - k) ** 2) AS d FROM pr), sp AS (SELECT pair, d / n AS step, floor(i + 0.5 + (ti - i) * s / n::DOUBLE) AS vi, floor(j + 0.5 + (tj - j) * s / n::DOUBLE) AS vj, floor(k + 0.5 + (tk - k) * s / n::DOUBLE) AS vk FROM pl, range(1, 64) q(s) WHERE s < n), got AS (SELECT pair, bool_or(coalesce(code, 0) NOT IN (0, -2)) AS stop, sum(CASE WHEN code = -2 THEN step ELSE 0 END) AS depth FROM sp JOIN small c ON c.i = vi AND c.j = vj LEFT JOIN vox v ON v.i = vi AND v.j = vj AND v.k = vk GROUP BY 1)"


@query(f"{SMALL_SQL}, {PAIRS} SELECT pr.pair, round(CASE WHEN coalesce(stop, false) THEN 0.0 ELSE exp(-0.6 * coalesce(depth, 0)) END, 6) AS through FROM pr LEFT JOIN got USING (pair)")
def pair_transmission(spark, d):
    s = F.col("s_suppkey")
    at = {"i": s * 7 % N, "j": s * 5 % N, "k": F.lit(6), "ti": s * 11 % N, "tj": s * 13 % N, "tk": F.lit(2)}
    pairs = A.table(spark, d, "supplier").select(s.alias("pair"), *[v.cast("int").alias(c) for c, v in at.items()])
    return rays.between(pairs, voxels.packed(_small_voxels(spark, d))).withColumn("through", F.round("through", 6))


@query(f"{SMALL_SQL}, {FACES}, lm AS (SELECT i AS ti, j AS tj, k AS tk FROM vox WHERE code = -3 AND bid = (SELECT max(bid) FROM small)), pr AS (SELECT f.*, f.i + di AS oi, f.j + dj AS oj, f.k + dk AS ok, ti, tj, tk, greatest(abs(ti - f.i - di), abs(tj - f.j - dj), abs(tk - f.k - dk)) AS n FROM face f, lm WHERE (ti - f.i - di) * di + (tj - f.j - dj) * dj + (tk - f.k - dk) * dk + 0.5 > 0), sp AS (SELECT i, j, k, di, dj, dk, ti, tj, tk, floor(oi + 0.5 + (ti - oi) * s / n::DOUBLE) AS vi, floor(oj + 0.5 + (tj - oj) * s / n::DOUBLE) AS vj, floor(ok + 0.5 + (tk - ok) * s / n::DOUBLE) AS vk FROM pr, range(1, 64) q(s) WHERE s < n), bl AS (SELECT DISTINCT sp.i, sp.j, sp.k, di, dj, dk, ti, tj, tk FROM sp JOIN vox v ON v.i = vi AND v.j = vj AND v.k = vk AND v.code <> 0), se AS (SELECT DISTINCT i, j, k, di, dj, dk FROM (SELECT i, j, k, di, dj, dk, ti, tj, tk FROM pr EXCEPT SELECT * FROM bl)) SELECT dk, count(*) AS faces, count(se.i) AS seen FROM face LEFT JOIN se USING (i, j, k, di, dj, dk) GROUP BY 1")
def surface_landmarks(spark, d):
    c = small_city(spark, d)
    v = voxels.voxelise(c)
    marked = voxels.mark(v, c.agg(F.max("bid").alias("bid")), c).where(F.col("code") == dims.LANDMARK)
    seen = rays.face_landmarks(voxels.faces(v), marked, voxels.packed(v))
    return seen.groupBy("dk").agg(F.count(F.lit(1)).alias("faces"), F.sum("visible").cast("long").alias("seen"))


@query()
def building_irradiance(spark, d):
    """Direct and diffuse light on building faces, by building; tested on a small scene against plain numbers."""
    c = small_city(spark, d)
    v = cut(voxels.voxelise(c))
    columns, faces = voxels.packed(v), voxels.faces(v)
    shape = (N, N, v.agg(F.max("k") + 1).first()[0])
    r = _rays(spark, 5.0, 35.0)
    key = ["i", "j", "k", "di", "dj", "dk"]
    seen = cut(rays.face_transmissions(faces, r, columns, shape))
    svf = seen.groupBy(*key).agg((F.sum(F.col("through") * F.col("angle")) / F.sum("angle")).alias("svf"))
    sun = seen.where("ray = 5").select(*key, "through")
    border = selection.at_border(F.col("j") + 0.5 + F.col("dj") * 0.5, F.col("i") + 0.5 + F.col("di") * 0.5, F.col("dk"), (0.0, 0.0, float(N), float(N)), 0.05)
    s = r.where("ray = 5").first()
    lit = solar.face_light(faces.join(svf, key, "left").join(sun, key, "left").withColumn("border", border), (s.dx, s.dy, s.dz), 800.0, 120.0)
    return lit.join(c.select("i", "j", "bid"), ["i", "j"]).groupBy("bid").agg(*[F.round(F.avg(n), 6).alias(n) for n in ("direct", "diffuse", "total")])


BOX = "b AS (SELECT c_custkey AS id, (c_custkey % 9 - 4) * 1.0::DOUBLE AS ox, (c_custkey % 7 - 3) * 1.0::DOUBLE AS oy, (c_custkey % 5 - 1) * 0.6 AS dx, (c_custkey % 3 - 1) * 0.8 AS dy FROM customer), s AS (SELECT id, CASE WHEN abs(dx) >= 1e-10 THEN (0.5 - ox) / dx END AS x1, CASE WHEN abs(dx) >= 1e-10 THEN (2.25 - ox) / dx END AS x2, CASE WHEN abs(dy) >= 1e-10 THEN (-1.5 - oy) / dy END AS y1, CASE WHEN abs(dy) >= 1e-10 THEN (1.75 - oy) / dy END AS y2, (abs(dx) >= 1e-10 OR ox BETWEEN 0.5 AND 2.25) AND (abs(dy) >= 1e-10 OR oy BETWEEN -1.5 AND 1.75) AS ok FROM b)"


@query(f"{BOX}, t AS (SELECT id, ok, greatest(0.0, coalesce(least(x1, x2), 0.0), coalesce(least(y1, y2), 0.0)) AS enter, least(100.0, coalesce(greatest(x1, x2), 100.0), coalesce(greatest(y1, y2), 100.0)) AS leave FROM s) SELECT id, ok AND enter <= leave AS hit, round(enter, 6) + 0.0 AS enter FROM t", city=False)
def box_hits(spark, d):
    k, zero = F.col("k"), F.lit(0.0)
    o = ((k % 9 - 4) * 1.0, (k % 7 - 3) * 1.0, zero)
    hit = rays.box_hit(o, ((k % 5 - 1) * 0.6, (k % 3 - 1) * 0.8, zero), (F.lit(0.5), F.lit(-1.5), F.lit(-1.0)), (F.lit(2.25), F.lit(1.75), F.lit(1.0)), 0.0, 100.0)
    return _customers(spark, d).select(k.alias("id"), hit.alias("h")).select("id", "h.hit", (F.round("h.enter", 6) + 0.0).alias("enter"))


@query("SELECT c_custkey AS id, round(cos(radians(c_custkey % 360)) * 1.0 - sin(radians(c_custkey % 360)) * 2.0, 9) + 0.0 AS x, round(cos(radians(c_custkey % 360)) * 2.0 + sin(radians(c_custkey % 360)) * 1.0, 9) + 0.0 AS y, 3.0::DOUBLE AS z FROM customer", city=False)
def turned_vectors(spark, d):
    v = rays.rotated((F.lit(1.0), F.lit(2.0), F.lit(3.0)), (F.lit(0.0), F.lit(0.0), F.lit(5.0)), F.radians(F.col("k") % 360))
    return _customers(spark, d).select(F.col("k").alias("id"), *[(F.round(c, 9) + 0.0).alias(n) for c, n in zip(v, "xyz")])


# --- idioms -----------------------------------------------------------------------------------------------------------


@query("p AS (SELECT c_custkey AS id, (c_custkey * 37 % 360 - 180)::DOUBLE AS lon, (c_custkey * 17 % 140 - 70)::DOUBLE AS lat FROM customer), s AS (SELECT n_nationkey AS sid, (n_nationkey * 53 % 360 - 180)::DOUBLE AS slon, (n_nationkey * 29 % 140 - 70)::DOUBLE AS slat FROM nation), k AS (SELECT id, sid, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))) AS km FROM p, s) SELECT id, n::INT AS n, sid AS station_id FROM (SELECT id, sid, row_number() OVER (PARTITION BY id ORDER BY km, sid) AS n FROM k) WHERE n <= 3", city=False)
def three_nearest_stations(spark, d):
    """The three nearest stations of each point; 25 stations go out."""
    k, n = F.col("k"), F.col("n_nationkey")
    p = _customers(spark, d).select(k.alias("id"), (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 140 - 70).cast("double").alias("lat"))
    s = A.table(spark, d, "nation").select(n.alias("sid"), (n * 53 % 360 - 180).cast("double").alias("slon"), (n * 29 % 140 - 70).cast("double").alias("slat"))
    all_ = s.agg(F.collect_list(F.struct("sid", "slon", "slat")).alias("s"))
    near = p.crossJoin(F.broadcast(all_)).select("id", F.slice(F.array_sort(F.transform("s", lambda x: F.struct(exprs.haversine_km(F.col("lon"), F.col("lat"), x["slon"], x["slat"]).alias("km"), x["sid"].alias("sid")))), 1, 3).alias("t"))
    return near.select("id", F.posexplode("t").alias("n", "x")).select("id", (F.col("n") + 1).alias("n"), F.col("x.sid").alias("station_id"))


@query("SELECT id, (row_number() OVER (ORDER BY height NULLS FIRST, id))::BIGINT AS n FROM buildings")
def buildings_by_height(spark, d):
    b = A.buildings(spark, d).select("id", F.struct(F.coalesce("height", F.lit(-1.0)).alias("h"), "id").alias("o"))
    return geodata.numbered(b, "o", "n", 1).select("id", "n")


@query("a AS (SELECT id FROM buildings WHERE height > 20), b AS (SELECT id FROM buildings WHERE i0 < 24) SELECT 'both' AS kind, id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'first', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)")
def combined_selections(spark, d):
    b = A.buildings(spark, d)
    high, west = b.where("height > 20").select("id"), b.where("i0 < 24").select("id")
    return high.intersect(west).select(F.lit("both").alias("kind"), "id").union(high.exceptAll(west).select(F.lit("first").alias("kind"), "id"))
