"""Registered queries over the driver's tables, each with the SQL it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citylattice.functions import dims, exprs
from citylattice.operators import edits, landcover, raster, rays, solar, vectors, voxels
from citylattice.plans import adapters as A
from citylattice.sources import readers, sinks

N, SQL = A.N, A.CITY_SQL
QUERIES: dict = {}
ORACLES: dict = {}
#: Side of the low city of the queries that march rays.
SMALL = N


def query(sql: str | None = None, city: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            own = sql.strip()
            # without the city, a text that begins with a named part still needs its WITH
            ORACLES[f.__name__] = f"WITH {SQL.strip()},\n{own}" if city else own if own.startswith("SELECT") else f"WITH {own}"
        return f

    return register


# --- the city ---------------------------------------------------------------------------------------------------------


def city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cell columns of the model: heights, segments, ids, classes, terrain and canopy."""
    cells, b = A.cells(spark), A.buildings(spark, sf_dir)
    heights = raster.tallest(cells, b)
    segs = raster.segments(cells, b)
    codes = raster.paint(cells, A.paints(spark, sf_dir), dims.priorities(spark)).select("i", "j", (F.col("idx") + 1).alias("code"))
    terrain = cells.join(A.dem(spark, sf_dir), ["i", "j"], "left").select("i", "j", F.coalesce("z", F.lit(0.0)).alias("z"))
    crowns = raster.crowns(cells, A.trees(spark, sf_dir))
    whole = heights.join(segs, ["i", "j"]).join(codes, ["i", "j"]).join(terrain, ["i", "j"]).join(crowns, ["i", "j"])
    return raster.level_buildings(whole)


def small_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buildings, low and in whole metres, with streets between them: (i, j, bh, bid, segs, code, z, top, bottom)."""
    c = A.cells(spark)
    at = raster.covered(A.buildings(spark, sf_dir)).where("not (i % 4 = 1 or j % 5 = 2)").groupBy("i", "j").agg((F.max("id") % 5 + 1).cast("double").alias("bh"), F.max("id").alias("bid"))
    g = c.join(at, ["i", "j"], "left").select("i", "j", F.coalesce("bh", F.lit(0.0)).alias("bh"), F.coalesce("bid", F.lit(0)).alias("bid"))
    tree = (F.col("bid") == 0) & ((F.col("i") * 5 + F.col("j") * 3) % 11 == 0)
    return g.select("i", "j", "bh", "bid", F.when(F.col("bh") > 0, F.array(F.struct(F.lit(0.0).alias("lo"), F.col("bh").alias("hi")))).otherwise(F.array().cast("array<struct<lo:double,hi:double>>")).alias("segs"), ((F.col("i") + F.col("j")) % 12 + 1).cast("int").alias("code"), F.lit(0.0).alias("z"), F.when(tree, 4.0).otherwise(0.0).alias("top"), F.when(tree, 2.0).otherwise(0.0).alias("bottom"))


SMALL_SQL = f"""
stamp AS (SELECT i, j, max(id) AS bid FROM (SELECT id, i, unnest(range(j0, j1)) AS j FROM (SELECT *, unnest(range(i0, i1)) AS i FROM buildings WHERE i0 < i1 AND j0 < j1)) WHERE NOT (i % 4 = 1 OR j % 5 = 2) GROUP BY 1, 2),
small AS (SELECT c.i, c.j, coalesce(stamp.bid, 0) AS bid, CASE WHEN stamp.bid IS NULL THEN 0 ELSE stamp.bid % 5 + 1 END::INT AS bh, (stamp.bid IS NULL AND (c.i * 5 + c.j * 3) % 11 = 0) AS tree, ((c.i + c.j) % 12 + 1)::INT AS lc
  FROM cells c LEFT JOIN stamp USING (i, j)),
nz AS (SELECT max(greatest(bh, CASE WHEN tree THEN 4 ELSE 0 END)) + 1 AS nz FROM small),
vox AS (SELECT i, j, k::INT AS k, bid, CASE WHEN k >= 1 AND k < 1 + bh THEN -3 WHEN tree AND k >= 3 AND k < 5 THEN -2 WHEN k = 0 THEN lc ELSE 0 END::INT AS code FROM small, nz, range(nz) r(k))
"""
TALL_SQL = """
cov AS (SELECT id, i, unnest(range(j0, j1))::INT AS j, height, min_height, inner_ FROM (SELECT *, unnest(range(i0, i1))::INT AS i FROM buildings WHERE i0 < i1 AND j0 < j1)),
best AS (SELECT i, j, arg_max(id, (height, id)) FILTER (height IS NOT NULL) AS kid, max(height) AS kh, max(id) FILTER (height IS NULL) AS uid, bool_or(inner_) AS cleared, arg_max(min_height, (height, id)) FILTER (height IS NOT NULL) AS kmin, arg_max(min_height, id) FILTER (height IS NULL) AS umin FROM cov GROUP BY 1, 2),
tall AS (SELECT c.i, c.j, CASE WHEN b.i IS NULL OR cleared THEN 0.0 ELSE kh END::DOUBLE AS bh, CASE WHEN b.i IS NULL OR cleared THEN 0 ELSE coalesce(kid, uid) END::BIGINT AS bid, coalesce(CASE WHEN kid IS NOT NULL THEN kmin ELSE umin END, 0.0)::DOUBLE AS min_h FROM cells c LEFT JOIN best b USING (i, j))
"""
CODE_SQL = "codes AS (SELECT c.i, c.j, coalesce(p.idx, 10) + 1 AS code FROM cells c LEFT JOIN (SELECT i, j, arg_min(idx, pr) AS idx FROM paints JOIN priority USING (idx) GROUP BY 1, 2) p USING (i, j))"
CROWN_SQL = """
near AS (SELECT c.i, c.j, t.*, sqrt((c.i + 0.5::DOUBLE - ci) * (c.i + 0.5::DOUBLE - ci) + (c.j + 0.5::DOUBLE - cj) * (c.j + 0.5::DOUBLE - cj)) AS r FROM cells c JOIN trees t ON abs(c.i + 0.5 - ci) <= crown / 2 AND abs(c.j + 0.5 - cj) <= crown / 2),
part AS (SELECT i, j, (top + bottom) / 2 + (top - bottom) / 2 * sqrt(1.0::DOUBLE - least(r / (crown / 2), 1.0) * least(r / (crown / 2), 1.0)) AS t, (top + bottom) / 2 - (top - bottom) / 2 * sqrt(1.0::DOUBLE - least(r / (crown / 2), 1.0) * least(r / (crown / 2), 1.0)) AS b FROM near WHERE r <= crown / 2),
crowns AS (SELECT c.i, c.j, coalesce(p.t, 0.0)::DOUBLE AS top, coalesce(least(p.t, p.b), 0.0)::DOUBLE AS bottom FROM cells c LEFT JOIN (SELECT i, j, max(t) AS t, max(b) AS b FROM part GROUP BY 1, 2) p USING (i, j))
"""
LEVEL_SQL = """
low AS (SELECT c.i, c.j, coalesce(d.z, 0.0) - min(coalesce(d.z, 0.0)) OVER () AS z FROM cells c LEFT JOIN dem d USING (i, j)),
flat AS (SELECT l.i, l.j, t.bid, CASE WHEN t.bid <> 0 THEN avg(z) OVER (PARTITION BY t.bid) ELSE z END AS z FROM low l JOIN tall t USING (i, j)),
lev AS (SELECT i, j, bid, z - min(z) OVER () AS z FROM flat)
"""
VOXEL_SQL = f"""{TALL_SQL.strip()},
segs AS (SELECT i, j, list({{'lo': min_height, 'hi': height}}) AS segs FROM cov WHERE height > 0 AND NOT inner_ GROUP BY 1, 2),
clr AS (SELECT i, j FROM cov WHERE inner_ GROUP BY 1, 2),
{CODE_SQL},
{CROWN_SQL.strip()},
{LEVEL_SQL.strip()},
whole AS (SELECT t.i, t.j, t.bh, CASE WHEN k.i IS NULL THEN s.segs END AS segs, c.code, v.z, w.top, w.bottom FROM tall t LEFT JOIN segs s USING (i, j) LEFT JOIN clr k USING (i, j) JOIN codes c USING (i, j) JOIN lev v USING (i, j) JOIN crowns w USING (i, j)),
lv AS (SELECT *, floor(z + 0.5)::INT + 1 AS g, floor(bottom + 0.5)::INT AS b0, floor(top + 0.5)::INT AS t0, (SELECT ceil(max(coalesce(bh, 10.0) + z + top))::INT + 1 FROM whole) AS nz FROM whole),
vox AS (SELECT i, j, k::INT AS k, CASE
    WHEN len(list_filter(coalesce(segs, []), lambda s: k >= g + floor(s.lo + 0.5) AND k < g + floor(s.hi + 0.5))) > 0 THEN -3
    WHEN top > 0 AND k >= g + b0 - CASE WHEN b0 = t0 AND b0 > 0 THEN 1 ELSE 0 END AND k < g + t0 THEN -2
    WHEN k = g - 1 THEN code WHEN k < g - 1 THEN -1 ELSE 0 END::INT AS code
  FROM (SELECT *, unnest(range(nz)) AS k FROM lv))
"""


@query(f"{VOXEL_SQL} SELECT code, count(*) AS n FROM vox GROUP BY code")
def voxel_code_counts(spark, d):
    """The whole model: rasterise, level, voxelise, count voxels of each class."""
    return voxels.voxelise(city(spark, d)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"{VOXEL_SQL} SELECT i, j, count(*) FILTER (code = -3) AS buildings, count(*) FILTER (code = -2) AS trees, max(k) FILTER (code <> 0)::INT AS top FROM vox GROUP BY i, j")
def voxel_columns(spark, d):
    v = voxels.voxelise(city(spark, d))
    return v.groupBy("i", "j").agg(F.count_if(F.col("code") == dims.BUILDING).alias("buildings"), F.count_if(F.col("code") == dims.TREE).alias("trees"), F.max(F.when(F.col("code") != 0, F.col("k"))).alias("top"))


@query(f"{VOXEL_SQL}, r AS (SELECT i, j, k, k - row_number() OVER (PARTITION BY i, j ORDER BY k) AS run FROM vox WHERE code = -3) SELECT i, j, min(k) AS k0, max(k) + 1 AS k1 FROM r GROUP BY i, j, run")
def k_spans(spark, d):
    return voxels.spans(voxels.voxelise(city(spark, d)))


@query(f"{TALL_SQL} SELECT i, j, bh, bid, min_h FROM tall")
def bld_raster_tallest(spark, d):
    return raster.tallest(A.cells(spark), A.buildings(spark, d))


@query(f"{TALL_SQL} SELECT c.i, c.j, CASE WHEN coalesce(x.cleared, false) THEN 0 ELSE coalesce(x.n, 0) END::INT AS n_segs, CASE WHEN coalesce(x.cleared, false) THEN 0.0 ELSE coalesce(x.hi, 0.0) END::DOUBLE AS hi FROM cells c LEFT JOIN (SELECT i, j, count(*) FILTER (height > 0 AND NOT inner_) AS n, max(height) FILTER (height > 0 AND NOT inner_) AS hi, bool_or(inner_) AS cleared FROM cov GROUP BY 1, 2) x USING (i, j)")
def bld_segments(spark, d):
    s = raster.segments(A.cells(spark), A.buildings(spark, d))
    return s.select("i", "j", F.size("segs").alias("n_segs"), F.coalesce(F.array_max(F.transform("segs", lambda x: x["hi"])), F.lit(0.0)).alias("hi"))


@query(f"{CODE_SQL} SELECT i, j, code FROM codes")
def lc_paint_priority(spark, d):
    return raster.paint(A.cells(spark), A.paints(spark, d), dims.priorities(spark)).select("i", "j", (F.col("idx") + 1).cast("int").alias("code"))


@query(f"{CROWN_SQL} SELECT i, j, round(top, 6) AS top, round(bottom, 6) AS bottom FROM crowns")
def canopy_crowns(spark, d):
    return raster.crowns(A.cells(spark), A.trees(spark, d)).select("i", "j", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query(f"{CODE_SQL} SELECT i, j, CASE WHEN code = 6 THEN 10.0 ELSE 0.0 END::DOUBLE AS top FROM codes")
def canopy_static(spark, d):
    return raster.canopy_from_classes(lc_paint_priority(spark, d), tree_codes=(6,)).select("i", "j", "top")


@query(f"{TALL_SQL}, {LEVEL_SQL} SELECT i, j, round(z, 6) AS z FROM lev")
def dem_per_building_mean(spark, d):
    terrain = A.cells(spark).join(A.dem(spark, d), ["i", "j"], "left").select("i", "j", F.coalesce("z", F.lit(0.0)).alias("z"))
    return raster.level_buildings(raster.tallest(A.cells(spark), A.buildings(spark, d)).join(terrain, ["i", "j"])).select("i", "j", F.round("z", 6).alias("z"))


MAPS = " UNION ALL ".join(f"SELECT '{s}' AS source, {i} AS idx, {c} AS code" for s, codes in dims.TO_STANDARD.items() for i, c in enumerate(codes))


@query(f"""maps AS ({MAPS}), src AS (SELECT * FROM (VALUES (0, 'Urbanwatch'), (1, 'ESA WorldCover'), (2, 'ESRI 10m Annual Land Cover'), (3, 'Dynamic World V1'), (4, 'OpenEarthMapJapan'), (5, 'Standard'), (6, 'OpenStreetMap')) s(n, source)),
x AS (SELECT o_orderkey, source, (o_custkey % 13 - 1)::INT AS idx FROM orders JOIN src ON o_orderkey % 7 = n)
SELECT x.source, x.idx, (CASE WHEN x.source = 'Standard' THEN x.idx WHEN x.source = 'OpenStreetMap' THEN x.idx + 1 WHEN x.idx < 0 THEN 14 ELSE coalesce(m.code, x.idx) END)::INT AS code, count(*) AS n FROM x LEFT JOIN maps m ON m.source = x.source AND m.idx = x.idx GROUP BY 1, 2, 3""")
def lc_convert_all_sources(spark, d):
    names = F.array(*[F.lit(s) for s in [*dims.TO_STANDARD, "Standard", "OpenStreetMap"]])
    o = A.table(spark, d, "orders").select(F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("source"), (F.col("o_custkey") % 13 - 1).cast("int").alias("idx"))
    return landcover.to_standard(o, dims.class_map(spark)).groupBy("source", "idx", "code").agg(F.count(F.lit(1)).alias("n"))


PALETTE = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b, _) in enumerate(dims.PALETTE))
PIXEL = "px AS (SELECT vec_id, least(greatest(floor((embedding[1]::DOUBLE + 0.5) * 255), 0), 255) AS r, least(greatest(floor((embedding[2]::DOUBLE + 0.5) * 255), 0), 255) AS g, least(greatest(floor((embedding[3]::DOUBLE + 0.5) * 255), 0), 255) AS b FROM embeddings), pal AS (SELECT * FROM (VALUES " + PALETTE + ") p(idx, pr, pg, pb)), cls AS (SELECT vec_id, arg_min(idx, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), idx)) AS idx FROM px, pal GROUP BY 1)"


def _pixels(spark, d):
    c = lambda k: F.least(F.greatest(F.floor((F.get("embedding", k).cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("double")
    return A.table(spark, d, "embeddings").select("vec_id", landcover.nearest_class(c(0), c(1), c(2)).alias("idx"))


@query(f"{PIXEL} SELECT vec_id, idx FROM cls")
def lc_nearest_rgb(spark, d):
    return _pixels(spark, d)


@query(f"{PIXEL}, n AS (SELECT vec_id % 48 AS cell, idx, count(*) AS n, min(vec_id) AS seen FROM cls GROUP BY 1, 2) SELECT cell, arg_max(idx, (n, -seen)) AS idx FROM n GROUP BY 1")
def lc_majority(spark, d):
    return landcover.majority(_pixels(spark, d).withColumn("cell", F.col("vec_id") % 48), ["cell"], order="vec_id")


@query("SELECT n_nationkey, name FROM (SELECT n_nationkey, n_nationkey % 18 - 3 AS code FROM nation) JOIN (VALUES " + ", ".join(f"({c}, '{n}')" for c, n in [(-3, "Building"), (-2, "Tree"), (-1, "Ground"), (0, "Air"), *enumerate(dims.STANDARD, 1)]) + ") v(code, name) USING (code)")
def voxel_names(spark, d):
    return A.table(spark, d, "nation").select("n_nationkey", exprs.voxel_name(F.col("n_nationkey") % 18 - 3).alias("name"))


# --- joins ------------------------------------------------------------------------------------------------------------

OVERLAP = "ov AS (SELECT a.*, b.id AS b_id, b.height AS b_height, (least(a.i1, b.i1) - greatest(a.i0, b.i0)) * (least(a.j1, b.j1) - greatest(a.j0, b.j0)) AS area, (b.i1 - b.i0) * (b.j1 - b.j0) AS b_size, (a.i1 - a.i0) * (a.j1 - a.j0) AS a_size FROM {a} a JOIN {b} b ON a.i0 < b.i1 AND b.i0 < a.i1 AND a.j0 < b.j1 AND b.j0 < a.j1)"
HALVES = "pri AS (SELECT * FROM buildings WHERE id % 4 <> 0), ref AS (SELECT * FROM buildings WHERE id % 4 = 0)"


def _halves(spark, d):
    b = A.buildings(spark, d)
    return b.where("id % 4 <> 0"), b.where("id % 4 = 0")


@query(f"{HALVES}, {OVERLAP.format(a='pri', b='ref')} SELECT p.id, round(CASE WHEN p.height > 0 THEN p.height ELSE (SELECT CASE WHEN sum(coalesce(b_height, 0.0) * area) > 0 THEN sum(coalesce(b_height, 0.0) * area) / sum(area) END FROM ov WHERE ov.id = p.id) END, 6) AS height FROM pri p")
def bld_height_from_ref(spark, d):
    p, r = _halves(spark, d)
    return vectors.transfer_heights(p, r).select("id", F.round("height", 6).alias("height"))


@query("few AS (SELECT * FROM buildings WHERE id % 5 = 0), ref AS (SELECT * FROM buildings WHERE id % 5 <> 0), lone AS (SELECT * FROM ref r WHERE NOT EXISTS (SELECT 1 FROM few p WHERE p.i0 < r.i1 AND r.i0 < p.i1 AND p.j0 < r.j1 AND r.j0 < p.j1)) SELECT id, height FROM few UNION ALL SELECT (SELECT max(id) FROM few) + row_number() OVER (ORDER BY id) AS id, height FROM lone")
def bld_height_complement_append(spark, d):
    b = A.buildings(spark, d)
    return vectors.append_unmatched(b.where("id % 5 = 0"), b.where("id % 5 <> 0")).select("id", "height")


@query("f AS (SELECT id, height FROM buildings WHERE id % 2 = 0), s AS (SELECT CASE WHEN id % 3 = 0 THEN id + 1 ELSE id END AS id, height FROM buildings WHERE id % 2 = 1), t AS (SELECT DISTINCT id FROM s WHERE id IN (SELECT id FROM f)), top AS (SELECT max(id) AS m FROM (SELECT id FROM f UNION ALL SELECT id FROM s)), n AS (SELECT id, m + row_number() OVER (ORDER BY id) AS fresh FROM t, top) SELECT id, height FROM f UNION ALL SELECT coalesce(n.fresh, s.id) AS id, height FROM s LEFT JOIN n USING (id)")
def bld_merge_id_conflict(spark, d):
    b = A.buildings(spark, d)
    second = b.where("id % 2 = 1").select(F.when(F.col("id") % 3 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("id"), "height")
    return vectors.merge_ids(b.where("id % 2 = 0").select("id", "height"), second)


@query(f"x AS (SELECT * FROM buildings WHERE i0 < i1 AND j0 < j1), {OVERLAP.format(a='x', b='x')} SELECT id, arg_max(b_id, (b_size, -b_id)) AS parent FROM ov WHERE (b_size > a_size OR b_size = a_size AND b_id < id) AND area > 0.5 * a_size GROUP BY 1")
def bld_overlap_ids(spark, d):
    return vectors.overlap_parents(A.buildings(spark, d))


@query("SELECT id, CASE WHEN height IS NULL OR height = 0 THEN 10.0 ELSE height END::DOUBLE AS height, height IS NULL OR height = 0 AS estimated FROM buildings")
def bld_patch_heights(spark, d):
    height, flag = vectors.completed(F.col("height"))
    return A.buildings(spark, d).select("id", height.alias("height"), flag.alias("estimated"))


INSIDE = "mem AS (SELECT z.zone_id, c.i, c.j FROM zones z JOIN cells c ON CASE WHEN diamond THEN abs(c.i + 0.5 - zx) + abs(c.j + 0.5 - zy) < zr ELSE abs(c.i + 0.5 - zx) < zr AND abs(c.j + 0.5 - zy) < zr END)"


@query(f"{INSIDE} SELECT zone_id, count(*) AS n FROM mem GROUP BY 1")
def pip_zone_cells(spark, d):
    return vectors.zone_cells(A.cells(spark), A.zones(spark, d)).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{TALL_SQL}, {INSIDE} SELECT zone_id, count(*) AS cell_count, count(bh) AS valid_count, round(avg(bh), 6) AS mean, min(bh) AS min, max(bh) AS max, round(stddev_pop(bh), 6) AS std FROM mem JOIN tall USING (i, j) GROUP BY 1")
def zone_stats_ground(spark, d):
    members = vectors.zone_cells(A.cells(spark), A.zones(spark, d))
    s = vectors.zone_stats(members, raster.tallest(A.cells(spark), A.buildings(spark, d)), "bh")
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"{TALL_SQL}, {INSIDE} SELECT DISTINCT zone_id, bid FROM mem JOIN tall USING (i, j) WHERE bid <> 0")
def building_ids_in_zone(spark, d):
    grid = raster.tallest(A.cells(spark), A.buildings(spark, d)).where("bid <> 0")
    return vectors.zone_cells(A.cells(spark), A.zones(spark, d)).join(grid, ["i", "j"]).select("zone_id", "bid").distinct()


@query("p AS (SELECT c_custkey AS id, (c_custkey * 37 % 360 - 180)::DOUBLE AS lon, (c_custkey * 17 % 140 - 70)::DOUBLE AS lat FROM customer), s AS (SELECT n_nationkey AS sid, (n_nationkey * 53 % 360 - 180)::DOUBLE AS slon, (n_nationkey * 29 % 140 - 70)::DOUBLE AS slat FROM nation), k AS (SELECT id, sid, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))) AS km FROM p, s) SELECT id, arg_min(sid, (km, sid)) AS station_id, round(min(km), 4) AS km FROM k GROUP BY 1")
def haversine_nearest_station(spark, d):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    p = A.table(spark, d, "customer").select(k.alias("id"), (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 140 - 70).cast("double").alias("lat"))
    s = A.table(spark, d, "nation").select(n.alias("station_id"), (n * 53 % 360 - 180).cast("double").alias("lon"), (n * 29 % 140 - 70).cast("double").alias("lat"))
    return vectors.nearest_station(p, s).withColumn("km", F.round("km", 4))


@query("x AS (SELECT l_orderkey AS e, l_linenumber AS n, (l_linenumber * 5)::DOUBLE AS dist, max(l_quantity) AS z FROM lineitem GROUP BY 1, 2), s AS (SELECT e, dist - lag(dist) OVER w AS run, abs(z - lag(z) OVER w) AS rise FROM x WINDOW w AS (PARTITION BY e ORDER BY n)) SELECT e AS edge_id, round(avg(CASE WHEN run > 0 THEN rise / run * 100 END), 6) AS slope FROM s GROUP BY 1")
def edge_slope(spark, d):
    x = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("edge_id"), F.col("l_linenumber").alias("idx")).agg(F.max("l_quantity").alias("z")).withColumn("dist", (F.col("idx") * 5).cast("double"))
    return vectors.edge_slopes(x).withColumn("slope", F.round("slope", 6))


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_quantity) FILTER (l_returnflag <> 'R') / sum(l_quantity) FILTER (l_returnflag <> 'R'), 4) AS mean FROM lineitem GROUP BY 1")
def edge_weighted_value(spark, d):
    x = A.table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")))
    return vectors.weighted_mean(x, "l_orderkey", "v", "l_quantity").withColumn("mean", F.round("mean", 4))


@query("x AS (SELECT p_partkey AS edge_id, (p_size * 1.5)::DOUBLE AS len FROM part), n AS (SELECT *, floor(len / 10)::INT AS n FROM x), m AS (SELECT edge_id, CASE WHEN len <= 10 THEN [0.0::DOUBLE, len] WHEN n * 10 < len THEN list_append(list_transform(range(n + 1), lambda s: s * 10.0::DOUBLE), len) ELSE list_transform(range(n + 1), lambda s: s * 10.0::DOUBLE) END AS m FROM n) SELECT edge_id, (unnest(range(len(m))))::INT AS idx, unnest(m)::DOUBLE AS dist FROM m")
def interpolate_points(spark, d):
    x = A.table(spark, d, "part").select(F.col("p_partkey").alias("edge_id"), (F.col("p_size") * 1.5).cast("double").alias("length"))
    return vectors.points_along(x, 10.0)


# --- faces, observers, rays -------------------------------------------------------------------------------------------

FACES = "dirs AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) d(di, dj, dk)), face AS (SELECT v.i, v.j, v.k, v.bid, di, dj, dk FROM vox v, dirs LEFT JOIN vox w ON w.i = v.i + di AND w.j = v.j + dj AND w.k = v.k + dk WHERE v.code = -3 AND (w.code IS NULL OR w.code IN (0, -2)))"


def _small_voxels(spark, d):
    return voxels.voxelise(small_city(spark, d))


@query(f"{SMALL_SQL}, {FACES} SELECT i, j, k, di, dj, dk FROM face")
def faces_open_air(spark, d):
    return voxels.faces(_small_voxels(spark, d))


@query(f"{SMALL_SQL}, {FACES} SELECT CASE WHEN dk = 1 THEN 'roof' WHEN dk = -1 THEN 'bottom' ELSE 'wall' END AS kind, CASE WHEN dk = 0 THEN CASE WHEN di = 1 THEN 'N' WHEN di = -1 THEN 'S' WHEN dj = 1 THEN 'E' ELSE 'W' END END AS side, count(*) AS n FROM face GROUP BY 1, 2")
def face_kind_orientation(spark, d):
    n = [F.col(c).cast("double") for c in ("dj", "di", "dk")]
    return voxels.faces(_small_voxels(spark, d)).select(exprs.surface_kind(*n).alias("kind"), exprs.wall_orientation(*n).alias("side")).groupBy("kind", "side").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SMALL_SQL}, {FACES} SELECT bid, count(*)::DOUBLE AS area FROM face GROUP BY 1")
def face_area_by_building(spark, d):
    c = small_city(spark, d)
    return voxels.faces(voxels.voxelise(c)).join(c.select("i", "j", "bid"), ["i", "j"]).groupBy("bid").agg(F.count(F.lit(1)).cast("double").alias("area"))


@query(f"{SMALL_SQL}, {FACES}, roof AS (SELECT i, j FROM face WHERE dk = 1), e AS (SELECT i AS a, j AS b, 'h' AS o FROM roof UNION ALL SELECT i + 1, j, 'h' FROM roof UNION ALL SELECT i, j, 'v' FROM roof UNION ALL SELECT i, j + 1, 'v' FROM roof) SELECT a, b, o FROM e GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1")
def boundary_edges(spark, d):
    roof = voxels.faces(_small_voxels(spark, d)).where("dk = 1")
    edge = lambda a, b, o: F.struct((F.col("i") + a).alias("a"), (F.col("j") + b).alias("b"), F.lit(o).alias("o"))
    e = roof.select(F.explode(F.array(edge(0, 0, "h"), edge(1, 0, "h"), edge(0, 0, "v"), edge(0, 1, "v"))).alias("e")).select("e.*")
    return e.groupBy("a", "b", "o").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")


OBSERVE = "st AS (SELECT v.i, v.j, v.k, b.code AS below FROM vox v JOIN vox b ON b.i = v.i AND b.j = v.j AND b.k = v.k - 1 WHERE v.code IN (0, -2) AND b.code NOT IN (0, -2)), base AS (SELECT i, j, CASE WHEN arg_min(below, k) IN (7, 8, 9) OR arg_min(below, k) < 0 THEN NULL ELSE min(k) END::INT AS k FROM st GROUP BY 1, 2)"


@query(f"{SMALL_SQL}, {OBSERVE} SELECT s.i, s.j, base.k FROM small s LEFT JOIN base USING (i, j)")
def observers_base(spark, d):
    return voxels.observers(voxels.packed(_small_voxels(spark, d)))


@query(f"{SMALL_SQL}, {OBSERVE} SELECT s.i, s.j, t.k FROM small s LEFT JOIN (SELECT i, j, max(k)::INT AS k FROM st WHERE below NOT IN (7, 8, 9) AND NOT (below < 0 AND below <> -3) GROUP BY 1, 2) t USING (i, j)")
def observers_top(spark, d):
    return voxels.observers(voxels.packed(_small_voxels(spark, d)), roofs=True)


@query("SELECT r::INT AS ray, round(cos(radians(-30.0 + r % 5 * 15.0)) * cos(radians(r // 5 * 45.0)), 9) + 0.0 AS dx, round(cos(radians(-30.0 + r % 5 * 15.0)) * sin(radians(r // 5 * 45.0)), 9) + 0.0 AS dy, round(sin(radians(-30.0 + r % 5 * 15.0)), 9) + 0.0 AS dz FROM range(40) t(r)", city=False)
def ray_dirs_grid(spark, d):
    return rays.directions(spark, 8, 5, -30.0, 30.0).select("ray", *[(F.round(c, 9) + 0.0).alias(c) for c in ("dx", "dy", "dz")])


@query("z AS (SELECT r, (r + 0.5::DOUBLE) / 50 AS z FROM range(50) t(r)) SELECT r::INT AS ray, round(sqrt(greatest(0.0, 1.0 - z * z)) * cos(r * (pi() * (3.0 - sqrt(5.0)))), 9) AS dx, round(sqrt(greatest(0.0, 1.0 - z * z)) * sin(r * (pi() * (3.0 - sqrt(5.0)))), 9) AS dy, round(z, 9) AS dz FROM z")
def ray_dirs_fibonacci(spark, d):
    return rays.fibonacci(spark, 50, 0.0, 90.0).select("ray", *[F.round(c, 9).alias(c) for c in ("dx", "dy", "dz")])


def _scene(spark, d):
    v = _small_voxels(spark, d)
    columns = voxels.packed(v)
    nz = columns.agg(F.max(F.size("codes"))).first()[0]
    return columns, voxels.observers(columns), (SMALL, SMALL, nz)


RAYS = """rays AS (SELECT r AS ray, cos(radians({lo} + r % {ne} * {st})) * cos(radians(r // {ne} * {sa})) AS dx, cos(radians({lo} + r % {ne} * {st})) * sin(radians(r // {ne} * {sa})) AS dy, sin(radians({lo} + r % {ne} * {st})) AS dz FROM range({n}) t(r)),
obs AS (SELECT i, j, k, ray, dx, dy, dz, nz, least(CASE WHEN dx > 1e-9 THEN ({m} - 0.5 - i) / dx WHEN dx < -1e-9 THEN (i + 0.5) / -dx ELSE 1e18 END, CASE WHEN dy > 1e-9 THEN ({m} - 0.5 - j) / dy WHEN dy < -1e-9 THEN (j + 0.5) / -dy ELSE 1e18 END, CASE WHEN dz > 1e-9 THEN (nz - 0.5 - k) / dz WHEN dz < -1e-9 THEN (k + 0.5) / -dz ELSE 1e18 END) AS far FROM base, rays, nz WHERE k IS NOT NULL),
cut AS (SELECT i, j, ray, 0.0::DOUBLE AS t FROM obs UNION SELECT i, j, ray, (s + 0.5::DOUBLE) / abs(dx) AS t FROM obs, range({m}) q(s) WHERE abs(dx) > 1e-9 AND (s + 0.5::DOUBLE) / abs(dx) <= far + 1e-9
  UNION SELECT i, j, ray, (s + 0.5::DOUBLE) / abs(dy) FROM obs, range({m}) q(s) WHERE abs(dy) > 1e-9 AND (s + 0.5::DOUBLE) / abs(dy) <= far + 1e-9 UNION SELECT i, j, ray, (s + 0.5::DOUBLE) / abs(dz) FROM obs, range({m}) q(s) WHERE abs(dz) > 1e-9 AND (s + 0.5::DOUBLE) / abs(dz) <= far + 1e-9),
piece AS (SELECT i, j, ray, t, lead(t) OVER (PARTITION BY i, j, ray ORDER BY t) AS t2 FROM cut),
step AS (SELECT p.i, p.j, p.ray, p.t, p.t2 - p.t AS len, coalesce(v.code, 0) AS code FROM piece p JOIN obs o USING (i, j, ray) JOIN small c ON c.i = floor(o.i + 0.5 + dx * (t + t2) / 2) AND c.j = floor(o.j + 0.5 + dy * (t + t2) / 2) LEFT JOIN vox v ON v.i = c.i AND v.j = c.j AND v.k = floor(o.k + 0.5 + dz * (t + t2) / 2) WHERE t2 IS NOT NULL)"""
SKY = RAYS.format(lo=5.0, ne=3, st=35.0, sa=51.0, n=21, m=SMALL)
GREEN = RAYS.format(lo=-24.0, ne=3, st=20.0, sa=51.0, n=21, m=SMALL)


def _rays(spark, low, step):
    a, e = F.radians(F.floor(F.col("id") / 3) * 51.0), F.radians(F.lit(low) + F.col("id") % 3 * step)
    return spark.range(21).select(F.col("id").cast("int").alias("ray"), (F.cos(e) * F.cos(a)).alias("dx"), (F.cos(e) * F.sin(a)).alias("dy"), F.sin(e).alias("dz"))


@query(f"{SMALL_SQL}, {OBSERVE}, {SKY}, w AS (SELECT s.i, s.j, s.ray, bool_or(code NOT IN (0, -2)) AS stop, exp(-0.6 * coalesce(sum(len) FILTER (code = -2), 0.0)) AS t FROM step s GROUP BY 1, 2, 3) SELECT i, j, round(avg(CASE WHEN stop OR t < 0.01 THEN 0.0 ELSE t END), 6) AS value FROM w GROUP BY 1, 2")
def svf_map(spark, d):
    """Sky view factor of every standing place, 21 rays."""
    columns, standing, shape = _scene(spark, d)
    return rays.view(standing, _rays(spark, 5.0, 35.0), columns, shape).withColumn("value", F.round("value", 6))


@query(f"{SMALL_SQL}, {OBSERVE}, {GREEN}, w AS (SELECT i, j, ray, min(t) FILTER (code IN (2, 5, 6)) AS hit, min(t) FILTER (code <> 0 AND code <> -2 AND code NOT IN (2, 5, 6)) AS stop FROM step GROUP BY 1, 2, 3), x AS (SELECT w.*, exp(-0.6 * coalesce((SELECT sum(len) FROM step s WHERE s.i = w.i AND s.j = w.j AND s.ray = w.ray AND s.code = -2 AND s.t < w.hit), 0.0)) AS t FROM w) SELECT i, j, round(avg(CASE WHEN hit IS NOT NULL AND (stop IS NULL OR hit < stop) AND t >= 0.01 THEN 1.0 ELSE 0.0 END), 6) AS value FROM x GROUP BY 1, 2")
def view_index_green(spark, d):
    columns, standing, shape = _scene(spark, d)
    return rays.view(standing, _rays(spark, -24.0, 20.0), columns, shape, targets=(2, 5, 6), inclusion=True).withColumn("value", F.round("value", 6))


@query(f"{SMALL_SQL}, {OBSERVE}, lm AS (SELECT i AS ti, j AS tj, k AS tk FROM vox WHERE code = -3 AND bid = (SELECT max(bid) FROM small)), pr AS (SELECT *, greatest(abs(ti - i), abs(tj - j), abs(tk - k)) AS n FROM base, lm WHERE k IS NOT NULL AND (i <> ti OR j <> tj OR k <> tk)), sp AS (SELECT i, j, ti, tj, tk, floor(i + 0.5::DOUBLE + (ti - i) * s / n::DOUBLE) AS vi, floor(j + 0.5::DOUBLE + (tj - j) * s / n::DOUBLE) AS vj, floor(k + 0.5::DOUBLE + (tk - k) * s / n::DOUBLE) AS vk FROM pr, range(1, 64) q(s) WHERE s < n), bl AS (SELECT DISTINCT sp.i, sp.j, ti, tj, tk FROM sp JOIN vox v ON v.i = vi AND v.j = vj AND v.k = vk AND v.code <> 0), se AS (SELECT DISTINCT i, j FROM (SELECT i, j, ti, tj, tk FROM pr EXCEPT SELECT * FROM bl)) SELECT s.i, s.j, CASE WHEN base.k IS NOT NULL THEN CASE WHEN se.i IS NULL THEN 0 ELSE 1 END END::INT AS visible FROM small s LEFT JOIN base USING (i, j) LEFT JOIN se USING (i, j)")
def landmark_map(spark, d):
    c = small_city(spark, d)
    columns = voxels.packed(voxels.voxelise(c))
    best = c.agg(F.max("bid").alias("bid"))
    marked = voxels.mark(voxels.voxelise(c), best, c).where(F.col("code") == dims.LANDMARK)
    return rays.landmark_visible(voxels.observers(columns), marked, columns)


# --- sky and sun ------------------------------------------------------------------------------------------------------

BANDS = "band AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {lo}, {hi}, {c}, {off})" for n, lo, hi, c, off in zip(range(8), [0.0, *[b[0] for b in dims.TREGENZA[:-1]]], [b[0] for b in dims.TREGENZA], [b[1] for b in dims.TREGENZA], [sum(b[1] for b in dims.TREGENZA[:n]) for n in range(8)])) + ") b(n, lo, hi, c, off))"
BINS = f"{BANDS}, bin AS (SELECT s.*, (off + least(floor(az / (360.0::DOUBLE / c)), c - 1))::INT AS patch FROM suns s JOIN band ON el >= lo AND (el < hi OR n = 7))"


@query(f"{BANDS} SELECT (off + p)::INT AS patch, round(CASE WHEN c > 1 THEN (p + 0.5) * 360.0 / c ELSE 0.0 END, 6) AS az, round(2 * pi() * (sin(radians(hi)) - sin(radians(lo))) / c, 9) AS solid FROM band, range(30) t(p) WHERE p < c")
def tregenza_patches(spark, d):
    return solar.patches(spark).select("patch", F.round("az", 6).alias("az"), F.round("solid", 9).alias("solid"))


@query(f"{BINS} SELECT patch, sum(dni) AS dni, count(*) AS hours FROM bin WHERE el > 0 AND dni > 0 GROUP BY 1")
def sun_patch_bins(spark, d):
    return solar.binned(A.suns(spark, d))


@query(f"{BINS} SELECT patch, count(*) AS hours FROM bin WHERE dni >= 120 AND el > 0 GROUP BY 1")
def sunlight_hours_psh(spark, d):
    return solar.sunlight_hours(A.suns(spark, d))


@query(f"{BINS} SELECT patch, count(*) AS hours FROM bin WHERE el > 0 GROUP BY 1")
def sunlight_hours_dsh(spark, d):
    return solar.sunlight_hours(A.suns(spark, d), threshold=0.0)


@query("SELECT ts, dni FROM suns WHERE ((dayofyear(ts) - 1) * 24 + hour(ts) >= 19 * 24 + 6 OR (dayofyear(ts) - 1) * 24 + hour(ts) <= 4 * 24 + 18) AND (hour(ts) >= 20 OR hour(ts) <= 5)")
def hour_window_wraparound(spark, d):
    return A.suns(spark, d).where(solar.in_period(F.col("ts"), (20, 6), (5, 18), (20, 5))).select("ts", "dni")


@query("SELECT sum(dni) / 1000 AS dni_kwh, sum(dhi) / 1000 AS dhi_kwh, max(dni) AS peak_dni, count(*) FILTER (dni > 120) AS bright_hours FROM suns")
def annual_irradiance(spark, d):
    return solar.annual(A.suns(spark, d))


@query("x AS (SELECT ts, asin(sin(radians(23.45)) * sin(2 * pi() * (dayofyear(ts) + 284.0) / 365.0)) AS de, radians((hour(ts) + 139.7 / 15.0 - 12.0) * 15.0) AS ho FROM suns) SELECT ts, round(greatest(sin(radians(35.6)) * sin(de) + cos(radians(35.6)) * cos(de) * cos(ho), 0.0), 9) AS cos_zenith FROM x")
def sun_zenith(spark, d):
    _, _, cos_z = solar.position(F.dayofyear("ts").cast("double"), F.hour("ts") * 3600.0, 35.6, 139.7)
    return A.suns(spark, d).select("ts", F.round(cos_z, 9).alias("cos_zenith"))


# --- materials, edits, stencils ---------------------------------------------------------------------------------------


@query(f"{SMALL_SQL}, t AS (SELECT *, max(k) FILTER (code = -3) OVER (PARTITION BY i, j) AS top FROM vox), m AS (SELECT CASE WHEN code = -3 THEN CASE WHEN i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0 AND k < top THEN -16 ELSE -13 END ELSE code END AS code FROM t) SELECT code, count(*) AS n FROM m GROUP BY 1")
def material_windows(spark, d):
    return voxels.windows(_small_voxels(spark, d)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"{TALL_SQL}, e AS (SELECT (o_orderkey % 48)::INT AS i, (o_custkey % 48)::INT AS j, arg_max(o_orderkey % 40, o_orderkey)::DOUBLE AS nh, max(o_orderkey) + 100000000 AS nid FROM orders GROUP BY 1, 2) SELECT t.i, t.j, CASE WHEN e.i IS NULL THEN bh ELSE nh END AS bh, CASE WHEN e.i IS NULL THEN bid ELSE nid END AS bid FROM tall t LEFT JOIN e USING (i, j)")
def edit_batch(spark, d):
    o = F.col("o_orderkey")
    e = A.table(spark, d, "orders").select((o % N).cast("int").alias("i"), (F.col("o_custkey") % N).cast("int").alias("j"), (o % 40).cast("double").alias("bh"), (o + 100000000).alias("bid"), o.alias("ord"))
    grid = raster.tallest(A.cells(spark), A.buildings(spark, d)).withColumn("bh", F.col("bh"))
    return edits.add_buildings(grid, e).select("i", "j", "bh", "bid")


@query(f"{TALL_SQL} SELECT i, j, CASE WHEN bid % 3 = 0 THEN 0.0 ELSE bh END::DOUBLE AS bh, CASE WHEN bid % 3 = 0 THEN 0 ELSE bid END::BIGINT AS bid FROM tall")
def edit_delete(spark, d):
    ids = A.buildings(spark, d).where("id % 3 = 0").select(F.col("id").alias("bid")).union(A.cells(spark).select(F.lit(0).cast("long").alias("bid")).limit(1))
    return edits.delete_buildings(raster.tallest(A.cells(spark), A.buildings(spark, d)), ids).select("i", "j", "bh", "bid")


@query(f"{SMALL_SQL}, g AS (SELECT *, i < 2 OR j < 2 OR i >= {SMALL - 2} OR j >= {SMALL - 2} AS band FROM small) SELECT i, j, bid, CASE WHEN bid <> 0 AND bid IN (SELECT bid FROM g WHERE band AND bid <> 0) THEN 0.0 ELSE bh END::DOUBLE AS bh, CASE WHEN band OR NOT tree THEN 0.0 ELSE 4.0 END::DOUBLE AS top, CASE WHEN band THEN 11 ELSE lc END::INT AS code FROM g")
def perimeter_cleanup(spark, d):
    return edits.clear_border(small_city(spark, d), (SMALL, SMALL), 2).select("i", "j", "bid", "bh", "top", "code")


@query(f"{SMALL_SQL} SELECT c.i, c.j, coalesce(s.bid, -1) AS bid FROM (SELECT (x // {SMALL + 4})::INT AS i, (x % {SMALL + 4})::INT AS j FROM range({(SMALL + 4) ** 2}) t(x)) c LEFT JOIN small s ON s.i = c.i - 2 AND s.j = c.j - 2")
def pad_crop(spark, d):
    side = SMALL + 4
    spine = spark.range(side * side).select((F.col("id") / side).cast("int").alias("i"), (F.col("id") % side).cast("int").alias("j"))
    return raster.pad_crop(small_city(spark, d), spine, (side, side), "bid", -1)


@query(f"{SMALL_SQL} SELECT a.i, a.j, max(b.bh)::DOUBLE AS out FROM small a JOIN small b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2")
def max_filter(spark, d):
    return voxels.neighbourhood(small_city(spark, d), 1, F.col("bh"), F.max)


@query(f"{SMALL_SQL}, l AS (SELECT bid, row_number() OVER (ORDER BY bid) AS n FROM (SELECT DISTINCT bid FROM small WHERE bid <> 0)) SELECT s.i, s.j, coalesce(l.n, 0)::INT AS label FROM small s LEFT JOIN l USING (bid)")
def label_groups(spark, d):
    return raster.label_groups(small_city(spark, d), "bid").select("i", "j", "label")


# --- tags, tiles and text ---------------------------------------------------------------------------------------------

TAGS = "tags AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR WHEN p_partkey % 3 = 1 THEN p_size || ' m' END AS height, CASE WHEN p_partkey % 4 = 0 THEN (p_size % 9)::VARCHAR END AS levels, CASE WHEN p_partkey % 5 = 0 THEN '-' || (p_size % 5) || ';1' END AS layer, CASE WHEN p_partkey % 7 = 0 THEN '-1' END AS lvl, CASE WHEN p_partkey % 6 = 0 THEN 'yes' END AS tunnel, CASE WHEN p_partkey % 31 = 0 THEN 'underground' END AS loc FROM part)"


def _tags(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    pairs = {"height": F.when(p % 3 == 0, s.cast("string")).when(p % 3 == 1, F.concat(s.cast("string"), F.lit(" m"))), "building:levels": F.when(p % 4 == 0, (s % 9).cast("string")), "layer": F.when(p % 5 == 0, F.concat(F.lit("-"), (s % 5).cast("string"), F.lit(";1"))), "level": F.when(p % 7 == 0, F.lit("-1")), "tunnel": F.when(p % 6 == 0, F.lit("yes")), "location": F.when(p % 31 == 0, F.lit("underground"))}
    made = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return A.table(spark, d, "part").select(p.alias("id"), made.alias("tags"))


@query(f"{TAGS} SELECT id, coalesce(try_cast(height AS DOUBLE), try_cast(levels AS DOUBLE) * 3.0, 0.0)::DOUBLE AS height FROM tags")
def osm_height_rules(spark, d):
    return _tags(spark, d).select("id", readers.height_from_tags(F.col("tags")).alias("height"))


@query(f"{TAGS}, n AS (SELECT *, try_cast(split_part(layer, ';', 1) AS DOUBLE) AS la, try_cast(lvl AS DOUBLE) AS le FROM tags) SELECT id, coalesce(loc = 'underground', false) OR coalesce(tunnel IS NOT NULL AND (la < 0 OR le < 0), false) OR coalesce(la < -1 AND le < 0 OR la <= -3 AND le IS NULL, false) AS below FROM n")
def osm_underground(spark, d):
    return _tags(spark, d).select("id", readers.underground(F.col("tags")).alias("below"))


@query("p AS (SELECT c_custkey AS id, (c_custkey * 37 % 360 - 180)::DOUBLE AS lon, (c_custkey * 17 % 140 - 70)::DOUBLE AS lat FROM customer) SELECT id, floor((lon + 180.0) / 360.0 * 4096)::INT AS x, floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096)::INT AS y FROM p")
def tile_index(spark, d):
    k = F.col("c_custkey")
    x, y = exprs.web_tile((k * 37 % 360 - 180).cast("double"), (k * 17 % 140 - 70).cast("double"), 12)
    return A.table(spark, d, "customer").select(k.alias("id"), x.alias("x"), y.alias("y"))


@query("px AS (SELECT vec_id, (vec_id % 32)::INT AS gx, (vec_id // 32)::INT AS gy, CASE WHEN label % 3 = 0 THEN NULL ELSE label END::INT AS v FROM embeddings), co AS (SELECT (gx // 4)::INT AS cx, (gy // 4)::INT AS cy, max(vec_id)::INT AS cv FROM px GROUP BY 1, 2) SELECT gx, gy, coalesce(v, cv) AS v FROM px JOIN co ON gx // 4 = cx AND gy // 4 = cy")
def dem_backfill_pyramid(spark, d):
    v = F.col("vec_id")
    px = A.table(spark, d, "embeddings").select("vec_id", (v % 32).cast("int").alias("gx"), F.floor(v / 32).cast("int").alias("gy"), F.when(F.col("label") % 3 != 0, F.col("label")).alias("v"))
    coarse = px.groupBy(F.shiftright("gx", 2).alias("gx"), F.shiftright("gy", 2).alias("gy")).agg(F.max("vec_id").cast("int").alias("v"))
    return readers.backfill(px.select("gx", "gy", "v"), coarse, 2)


@query(f"{SMALL_SQL} SELECT 0::BIGINT AS ord, count(*) FILTER (bh > 0)::VARCHAR AS line FROM small UNION ALL SELECT (j * 1000000 + i + 1)::BIGINT, (i + 1) || ' ' || (j + 1) || ' ' || bh || '.0 100 0.0 0.0 102' FROM small WHERE bh > 0")
def cityles_topog(spark, d):
    return sinks.topog_lines(small_city(spark, d), material=100)


@query(f"{SMALL_SQL} SELECT i, string_agg(bh::VARCHAR, ',' ORDER BY j) AS line FROM small GROUP BY 1")
def envimet_matrix(spark, d):
    return sinks.matrix_lines(small_city(spark, d), "bh")


@query(f"{CODE_SQL} SELECT code, count(*) AS n, round(count(*) * 100.0 / 2304, 6)::DOUBLE AS share FROM codes GROUP BY 1")
def landuse_hist(spark, d):
    h = lc_paint_priority(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return h.select("code", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("SELECT (o_orderkey % 16 - 2)::INT AS code, count(*) AS n, min(CASE (o_orderkey % 16 - 2)::INT WHEN 0 THEN 0.20 WHEN 1 THEN 0.25 WHEN 2 THEN 0.20 WHEN 3 THEN 0.20 WHEN 4 THEN 0.15 WHEN 5 THEN 0.12 WHEN 6 THEN 0.12 WHEN 7 THEN 0.06 WHEN 8 THEN 0.80 WHEN 9 THEN 0.20 WHEN 10 THEN 0.12 WHEN 11 THEN 0.20 ELSE 0.20 END)::DOUBLE AS albedo FROM orders GROUP BY 1")
def land_cover_albedo(spark, d):
    c = (F.col("o_orderkey") % 16 - 2).cast("int")
    return A.table(spark, d, "orders").select(c.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("albedo", exprs.albedo(F.col("code")))


# --- further grids ----------------------------------------------------------------------------------------------------


@query(f"{SMALL_SQL}, b AS (SELECT i, j, 0 AS k, 0 AS band, lc AS value FROM small UNION ALL SELECT i, j, 5, 1, bh FROM small UNION ALL SELECT i, j, 10, 2, CASE WHEN tree THEN 4 ELSE 0 END FROM small) SELECT band, k, count(*) AS n, sum(value)::BIGINT AS total FROM b WHERE value <> 0 GROUP BY 1, 2")
def voxel_components(spark, d):
    return raster.layers(small_city(spark, d)).groupBy("band", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total"))


BOXES = "box AS (SELECT id, height, i0 + (id % 4) / 4.0::DOUBLE AS x0, j0 + (id % 3) / 4.0::DOUBLE AS y0, least(i1 + (id % 5) / 8.0::DOUBLE, 48.0) AS x1, least(j1 + (id % 7) / 8.0::DOUBLE, 48.0) AS y1 FROM buildings WHERE i0 < i1 AND j0 < j1)"


def _boxes(spark, d):
    i = F.col("id")
    return A.buildings(spark, d).where("i0 < i1 and j0 < j1").select("id", "height", (F.col("i0") + i % 4 / 4.0).alias("x0"), (F.col("j0") + i % 3 / 4.0).alias("y0"), F.least(F.col("i1") + i % 5 / 8.0, F.lit(48.0)).alias("x1"), F.least(F.col("j1") + i % 7 / 8.0, F.lit(48.0)).alias("y1"))


@query(f"{BOXES}, hit AS (SELECT c.i, c.j, b.id, b.height FROM cells c JOIN box b ON b.x0 < b.x1 AND b.y0 < b.y1 AND x0 < c.i + 1 AND x1 > c.i AND y0 < c.j + 1 AND y1 > c.j AND (least(x1, c.i + 1.0) - greatest(x0, c.i)) * (least(y1, c.j + 1.0) - greatest(y0, c.j)) > 0.3) SELECT c.i, c.j, coalesce(h.bh, 0.0)::DOUBLE AS bh, coalesce(h.bid, 0)::BIGINT AS bid FROM cells c LEFT JOIN (SELECT i, j, max(height) AS bh, arg_max(id, (-coalesce(height, -1.0), id)) AS bid FROM hit GROUP BY 1, 2) h USING (i, j)")
def bld_raster_overlap30(spark, d):
    return raster.covered_share(A.cells(spark), _boxes(spark, d))


@query(f"{BOXES} SELECT c.i, c.j, coalesce(max(b.height), 0.0)::DOUBLE AS v FROM cells c LEFT JOIN box b ON c.i + 0.5 BETWEEN x0 AND x1 AND c.j + 0.5 BETWEEN y0 AND y1 GROUP BY 1, 2")
def veg_max_join(spark, d):
    return raster.highest_cover(A.cells(spark), _boxes(spark, d), "height")


def _samples(spark, d):
    s = F.col("s_suppkey")
    return A.table(spark, d, "supplier").select(s.alias("ord"), (s * 11 % N + 0.25).cast("double").alias("x"), (s * 5 % N + 0.75).cast("double").alias("y"), F.col("s_nationkey").cast("double").alias("z"))


@query("pt AS (SELECT s_suppkey AS ord, (s_suppkey * 11 % 48 + 0.25)::DOUBLE AS x, (s_suppkey * 5 % 48 + 0.75)::DOUBLE AS y, s_nationkey::DOUBLE AS z FROM supplier), near AS (SELECT c.i, c.j, p.*, (c.i + 0.5 - x) * (c.i + 0.5 - x) + (c.j + 0.5 - y) * (c.j + 0.5 - y) AS dd FROM cells c JOIN pt p ON abs(c.i - floor(x)) <= 6 AND abs(c.j - floor(y)) <= 6) SELECT c.i, c.j, n.z FROM cells c LEFT JOIN (SELECT i, j, arg_min(z, (dd, -ord)) AS z FROM near GROUP BY 1, 2) n USING (i, j)")
def dem_nearest(spark, d):
    return raster.nearest_sample(A.cells(spark), _samples(spark, d), 6)


@query("pt AS (SELECT s_suppkey AS ord, (s_suppkey * 11 % 48 + 0.25)::DOUBLE AS x, (s_suppkey * 5 % 48 + 0.75)::DOUBLE AS y, s_nationkey::DOUBLE AS z FROM supplier), near AS (SELECT c.i, c.j, p.*, (c.i + 0.5 - x) * (c.i + 0.5 - x) + (c.j + 0.5 - y) * (c.j + 0.5 - y) AS dd FROM cells c CROSS JOIN pt p) SELECT c.i, c.j, n.z FROM cells c LEFT JOIN (SELECT i, j, arg_min(z, (dd, -ord)) AS z FROM near GROUP BY 1, 2) n USING (i, j)")
def dem_nearest_whole(spark, d):
    """Every cell's nearest sample at any distance; ``dem_nearest`` looks 6 cells far."""
    return raster.nearest_of_all(A.cells(spark), _samples(spark, d))


WET = "wet AS (SELECT i, j, CASE WHEN (i // 3 + j // 4) % 3 = 0 THEN 9 ELSE 1 END AS code, ((i * 7 + j * 5) % 23)::DOUBLE AS z FROM cells)"


@query(f"{WET}, w AS (SELECT i, j, z FROM wet WHERE code = 9), r AS (WITH RECURSIVE reach(si, sj, i, j) AS (SELECT i, j, i, j FROM w UNION SELECT r.si, r.sj, w.i, w.j FROM reach r JOIN w ON abs(w.i - r.i) <= 1 AND abs(w.j - r.j) <= 1) SELECT * FROM reach), low AS (SELECT si AS i, sj AS j, min(w.z) AS z FROM r JOIN w ON w.i = r.i AND w.j = r.j GROUP BY 1, 2) SELECT wet.i, wet.j, coalesce(low.z, wet.z) AS z FROM wet LEFT JOIN low USING (i, j)")
def dem_water_flatten(spark, d):
    g = A.cells(spark).select("i", "j", F.when((F.floor(F.col("i") / 3) + F.floor(F.col("j") / 4)) % 3 == 0, 9).otherwise(1).alias("code"), ((F.col("i") * 7 + F.col("j") * 5) % 23).cast("double").alias("z"))
    return raster.flatten_water(g).select("i", "j", "z")


@query(f"{SMALL_SQL}, g AS (SELECT i, j, bh, (i * 3 + j * 7) % 5 = 0 AS t, ((i * 13 + j * 17) % 45)::DOUBLE AS top FROM small), r AS (SELECT a.i, a.j, max(b.bh) AS roof FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2), c AS (SELECT *, CASE WHEN top < 2 THEN 10.0 WHEN top > 35 THEN 35.0 ELSE top END AS u FROM g JOIN r USING (i, j)) SELECT i, j, CASE WHEN t THEN CASE WHEN roof > 0 AND abs(u - roof) <= 1 THEN 10.0 ELSE u END ELSE 0.0 END::DOUBLE AS top FROM c")
def canopy_sanitize(spark, d):
    i, j = F.col("i"), F.col("j")
    g = small_city(spark, d).select("i", "j", "bh", ((i * 3 + j * 7) % 5 == 0).alias("tree"), ((i * 13 + j * 17) % 45).cast("double").alias("top"))
    return raster.sanitise_canopy(g).select("i", "j", "top")


@query("SELECT i, j, round(139.5 + (i + 0.5) * 0.0001 + (j + 0.5) * 0.00002, 9) AS lon, round(35.5 + (i + 0.5) * -0.00001 + (j + 0.5) * 0.0002, 9) AS lat FROM cells")
def affine_cells(spark, d):
    lon, lat = exprs.affine(F.col("i"), F.col("j"), (139.5, 35.5), (0.0001, -0.00001), (0.00002, 0.0002))
    return A.cells(spark).select("i", "j", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("SELECT c_custkey, floor((c_custkey % 97 * 0.25 * 2.0 - c_custkey % 89 * 0.5 * 0.5) / 2.25 + 1e-12)::INT AS i, floor((c_custkey % 89 * 0.5 * 1.0 - c_custkey % 97 * 0.25 * -0.5) / 2.25 + 1e-12)::INT AS j FROM customer")
def lonlat_to_cell(spark, d):
    k = F.col("c_custkey")
    i, j = exprs.cell_of(100.0 + k % 97 * 0.25, 50.0 + k % 89 * 0.5, (100.0, 50.0), (1.0, -0.5), (0.5, 2.0))
    return A.table(spark, d, "customer").select("c_custkey", i.alias("i"), j.alias("j"))


@query("SELECT c_custkey, round(degrees(atan2(radians((c_custkey % 17 - 8) / 100.0), ln(tan(pi() / 4 + radians(35.0 + (c_custkey % 13 + 1) / 100.0) / 2)) - ln(tan(pi() / 4 + radians(35.0) / 2)))), 6) + 0.0 AS angle FROM customer")
def grid_rotation(spark, d):
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").select("c_custkey", (exprs.rotation_angle(F.lit(139.0), F.lit(35.0), 139.0 + (k % 17 - 8) / 100.0, 35.0 + (k % 13 + 1) / 100.0) + 0.0).alias("angle"))


@query("x AS (SELECT c_custkey AS id, (c_custkey * 37 % 1024)::INT AS x, (c_custkey * 91 % 1024)::INT AS y FROM customer) SELECT id, (SELECT string_agg((((x // (1 << b)::INT) % 2) + ((y // (1 << b)::INT) % 2) * 2)::INT::VARCHAR, '' ORDER BY b DESC) FROM range(10) t(b)) AS key FROM x")
def tile_quadkey(spark, d):
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").select(k.alias("id"), exprs.quadkey((k * 37 % 1024).cast("int"), (k * 91 % 1024).cast("int"), 10).alias("key"))


@query(f"{SMALL_SQL}, {FACES}, z AS (SELECT zone_id, c.i, c.j FROM zones JOIN cells c ON CASE WHEN diamond THEN abs(c.i + 0.5 - zx) + abs(c.j + 0.5 - zy) < zr ELSE abs(c.i + 0.5 - zx) < zr AND abs(c.j + 0.5 - zy) < zr END) SELECT zone_id, count(*) AS cell_count, count(*) AS valid_count, round(avg(k), 6) AS mean, min(k)::DOUBLE AS min, max(k)::DOUBLE AS max, round(stddev_pop(k), 6) AS std FROM z JOIN face USING (i, j) GROUP BY 1")
def zone_stats_faces(spark, d):
    f = voxels.faces(_small_voxels(spark, d)).withColumn("k", F.col("k").cast("double"))
    s = vectors.zone_stats(vectors.zone_cells(A.cells(spark), A.zones(spark, d)), f, "k")
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"{SMALL_SQL}, top AS (SELECT i // 2 AS i, j // 2 AS j, k // 2 AS k, coalesce(arg_max(code, k) FILTER (code <> 0), 0)::INT AS code FROM vox WHERE i % 2 = 0 AND j % 2 = 0 GROUP BY 1, 2, 3) SELECT code, count(*) AS n FROM top GROUP BY 1")
def surface_downsample(spark, d):
    return voxels.downsample(_small_voxels(spark, d), 2).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"{SMALL_SQL}, dirs AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) d(di, dj, dk)) SELECT v.code, count(*) AS n FROM vox v, dirs LEFT JOIN vox w ON w.i = v.i + di AND w.j = v.j + dj AND w.k = v.k + dk WHERE v.code <> 0 AND coalesce(w.code, 0) = 0 GROUP BY 1")
def occluded_faces(spark, d):
    return voxels.occluded_faces(_small_voxels(spark, d))


@query(f"{SMALL_SQL}, {OBSERVE} SELECT s.i, s.j, CASE WHEN v.code IN (0, -2) THEN (s.i * 100 + s.j * 10 + v.k)::DOUBLE END AS value FROM small s LEFT JOIN base USING (i, j) LEFT JOIN vox v ON v.i = s.i AND v.j = s.j AND v.k = base.k + 1")
def terrain_following_slice(spark, d):
    v = _small_voxels(spark, d)
    flux = v.select("i", "j", "k", (F.col("i") * 100 + F.col("j") * 10 + F.col("k")).cast("double").alias("value"))
    return voxels.follow_terrain(voxels.packed(v), flux, 1)


HITS = "h AS (SELECT l_orderkey % 48 AS i, l_partkey % 48 AS j, l_quantity * 0.7::DOUBLE AS z FROM lineitem GROUP BY 1, 2, 3)"


@query(f"{HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY z) AS rn, count(*) OVER (PARTITION BY i, j) AS n FROM h), p AS (SELECT i, j, (rn + 1) // 2 AS pair, min(z) AS a, max(z) AS b FROM n WHERE n % 2 = 0 GROUP BY 1, 2, 3 UNION ALL SELECT i, j, 0, min(z), max(z) FROM n WHERE n % 2 = 1 AND n > 1 GROUP BY 1, 2), q AS (SELECT i, j, floor(a + 0.5)::INT AS k0, floor(b + 0.5)::INT AS k1 FROM p) SELECT i::INT AS i, j::INT AS j, k0, k1 FROM q WHERE k0 < k1")
def mesh_hit_pairs(spark, d):
    h = A.table(spark, d, "lineitem").select((F.col("l_orderkey") % N).cast("int").alias("i"), (F.col("l_partkey") % N).cast("int").alias("j"), (F.col("l_quantity") * 0.7).alias("z")).distinct()
    return voxels.paired_hits(h)


@query()
def greedy_rectangles(spark, d):
    """Roof rectangles of each level of each building; an ordered greedy choice, checked by a test instead of SQL."""
    c = small_city(spark, d)
    roof = voxels.faces(voxels.voxelise(c)).where("dk = 1").join(c.select("i", "j", "bid"), ["i", "j"])
    roof = roof.select(F.concat_ws("_", "bid", "k").alias("plane"), F.col("i").alias("a"), F.col("j").alias("b"))
    return voxels.rectangles(roof)


@query("t AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'yes' END AS building, CASE p_partkey % 7 WHEN 1 THEN 'water' WHEN 2 THEN 'wood' WHEN 3 THEN 'scrub' END AS nat, CASE p_partkey % 5 WHEN 1 THEN 'forest' WHEN 2 THEN 'grass' WHEN 3 THEN 'other' END AS landuse, CASE WHEN p_partkey % 11 = 0 THEN 'footway' END AS ah FROM part) SELECT id, CASE WHEN building IS NOT NULL THEN 12 WHEN landuse = 'grass' THEN 1 WHEN nat = 'scrub' THEN 2 WHEN nat = 'wood' OR landuse = 'forest' THEN 4 WHEN nat = 'water' THEN 8 WHEN ah IS NOT NULL THEN 11 END::INT AS code FROM t")
def osm_classify(spark, d):
    p = F.col("p_partkey")
    pairs = {"building": F.when(p % 6 == 0, F.lit("yes")), "natural": F.when(p % 7 == 1, F.lit("water")).when(p % 7 == 2, F.lit("wood")).when(p % 7 == 3, F.lit("scrub")), "landuse": F.when(p % 5 == 1, F.lit("forest")).when(p % 5 == 2, F.lit("grass")).when(p % 5 == 3, F.lit("other")), "area:highway": F.when(p % 11 == 0, F.lit("footway"))}
    tags = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return A.table(spark, d, "part").select(p.alias("id"), readers.classify_tags(tags).alias("code"))


@query("w AS (SELECT o_orderkey AS way, unnest([o_custkey, o_custkey + 7, o_custkey + 30]) AS node, unnest([0, 1, 2]) AS pos FROM orders), j AS (SELECT w.*, c.c_custkey AS hit FROM w LEFT JOIN customer c ON c.c_custkey = w.node) SELECT way, (CASE WHEN count(*) = count(hit) THEN 3 ELSE 0 END)::INT AS points, CASE WHEN count(*) = count(hit) THEN arg_min(hit, pos)::DOUBLE END AS x0 FROM j GROUP BY 1")
def osm_way_points(spark, d):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    ways = A.table(spark, d, "orders").select(o.alias("way"), F.array(k, k + 7, k + 30).alias("nodes"))
    nodes = A.table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_custkey").cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    return readers.way_points(ways, nodes).select("way", F.size("ring").alias("points"), F.get("ring", 0)["x"].alias("x0"))


# --- radiation --------------------------------------------------------------------------------------------------------

THROUGH = "thr AS (SELECT i, j, ray, bool_or(code NOT IN (0, -2)) AS stop, exp(-0.6 * coalesce(sum(len) FILTER (code = -2), 0.0)) AS t FROM step GROUP BY 1, 2, 3), tr AS (SELECT i, j, ray, CASE WHEN stop OR t < 0.01 THEN 0.0 ELSE t END AS t FROM thr)"


@query(f"{SMALL_SQL}, {OBSERVE}, {SKY}, {THROUGH} SELECT i, j, round(sum(t * (ray % 4 + 1) * sin(radians(5.0 + ray % 3 * 35.0))), 6) AS energy FROM tr GROUP BY 1, 2")
def cumulative_ground(spark, d):
    columns, standing, shape = _scene(spark, d)
    r = _rays(spark, 5.0, 35.0)
    bins = r.select(F.col("ray").alias("patch"), (F.col("ray") % 4 + 1).cast("double").alias("dni"), "dz")
    hits = rays.transmissions(standing, r, columns, shape).withColumnRenamed("ray", "patch")
    return solar.cumulative(hits, bins).withColumn("energy", F.round("energy", 6))


@query(f"{SMALL_SQL}, {OBSERVE}, {SKY}, {THROUGH} SELECT i, j, round(t * 800.0 * sin(radians(75.0)), 6) AS direct FROM tr WHERE ray = 5")
def direct_map(spark, d):
    """Direct irradiance of one sun position."""
    columns, standing, shape = _scene(spark, d)
    sun = _rays(spark, 5.0, 35.0).where("ray = 5")
    t = rays.transmissions(standing, sun, columns, shape).join(sun, "ray")
    return t.select("i", "j", F.round(F.col("through") * 800.0 * F.col("dz"), 6).alias("direct"))


@query()
def face_view_factor(spark, d):
    """Cosine-weighted sky share of building faces; its rays are those of ``svf_map``, checked there against SQL."""
    columns, _, shape = _scene(spark, d)
    f = rays.face_openness(voxels.faces(_small_voxels(spark, d)), _rays(spark, 5.0, 35.0), columns, shape)
    return f.withColumn("value", F.round("value", 6))


LINKS = "s AS (SELECT s_suppkey AS surface, s_acctbal::DOUBLE AS flux, 0.1 + s_nationkey % 5 * 0.1 AS albedo FROM supplier), l AS (SELECT DISTINCT l_suppkey AS source, l_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS target FROM lineitem), lk AS (SELECT source, target, (source + target) % 7 * 0.02 AS share FROM l)"


@query(f"""{LINKS},
o0 AS (SELECT surface, flux AS total, flux * albedo AS leaving, albedo FROM s),
o1 AS (SELECT o.surface, total + coalesce(g, 0) AS total, coalesce(g, 0) * albedo AS leaving, albedo FROM o0 o LEFT JOIN (SELECT target, sum(leaving * share) AS g FROM o0 JOIN lk ON source = surface WHERE leaving > 0.01 AND share > 0.01 GROUP BY 1) x ON target = o.surface),
o2 AS (SELECT o.surface, total + coalesce(g, 0) AS total, coalesce(g, 0) * albedo AS leaving, albedo FROM o1 o LEFT JOIN (SELECT target, sum(leaving * share) AS g FROM o1 JOIN lk ON source = surface WHERE leaving > 0.01 AND share > 0.01 GROUP BY 1) x ON target = o.surface),
o3 AS (SELECT o.surface, total + coalesce(g, 0) AS total FROM o2 o LEFT JOIN (SELECT target, sum(leaving * share) AS g FROM o2 JOIN lk ON source = surface WHERE leaving > 0.01 AND share > 0.01 GROUP BY 1) x ON target = o.surface)
SELECT surface, round(total, 4) AS total FROM o3""")
def reflections_3(spark, d):
    """Three bounces over a sparse view-factor matrix."""
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("surface"), F.col("s_acctbal").alias("flux"), (0.1 + F.col("s_nationkey") % 5 * 0.1).alias("albedo"))
    top = s.agg(F.max("surface")).first()[0]
    l = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % top + 1).alias("target")).distinct()  # noqa: E741
    links = l.withColumn("share", (F.col("source") + F.col("target")) % 7 * 0.02)
    return rays.reflect(s, links).withColumn("total", F.round("total", 4))


@query(f"{SMALL_SQL}, {OBSERVE}, {SKY} SELECT i, j, round(avg(1.0 - exp(-0.5 * x)), 6) AS absorbed FROM (SELECT i, j, ray, coalesce(sum(len) FILTER (code = -2), 0.0) AS x FROM step GROUP BY 1, 2, 3) GROUP BY 1, 2")
def canopy_absorption(spark, d):
    """Share of each place's rays that leaves take, whatever stands behind."""
    columns, standing, shape = _scene(spark, d)
    side = columns.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "codes")
    steps = rays.pieces(standing, _rays(spark, 5.0, 35.0), shape).join(side, ["vi", "vj"])
    leaves = F.coalesce(F.sum(F.when(F.get("codes", F.col("vk")) == dims.TREE, F.col("length"))), F.lit(0.0))
    return steps.groupBy("i", "j", "ray").agg(leaves.alias("x")).groupBy("i", "j").agg(F.round(F.avg(1.0 - F.exp(-0.5 * F.col("x"))), 6).alias("absorbed"))


@query("w AS (SELECT date_trunc('hour', ts) AS start, sum(floor(value)) AS dni, count(*) AS n FROM events GROUP BY 1) SELECT start, dni, n FROM w")
def weather_hourly(spark, d):
    from citylattice.streaming.weather import hourly

    return hourly(A.table(spark, d, "events").select("ts", F.floor("value").cast("double").alias("value")))
