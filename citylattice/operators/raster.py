"""Rasterisation: geometries to one value for each cell, with deterministic winners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citylattice.functions import dims
from citylattice.session import parts, spread


def covered(footprints: DataFrame) -> DataFrame:
    """Footprints (i0, j0, i1, j1) with one row for each cell (i, j) they cover."""
    rows = footprints.where("i0 < i1 and j0 < j1").withColumn("i", F.explode(F.sequence("i0", F.col("i1") - 1)))
    return rows.withColumn("j", F.explode(F.sequence("j0", F.col("j1") - 1)))


def tallest(cells: DataFrame, footprints: DataFrame) -> DataFrame:
    """(i, j, bh, bid, min_h): painted in ascending height, unknown heights first and later rows over earlier ones; a cell
    of an inner footprint is cleared. Empty cells have bh 0 and bid 0."""
    at = covered(footprints)
    best = at.groupBy("i", "j").agg(F.max(F.struct(F.col("height").isNotNull().alias("known"), "height", "id", "min_height")).alias("b"), F.bool_or("inner").alias("cleared"))
    won = best.select("i", "j", F.when(F.col("cleared"), 0.0).otherwise(F.col("b.height")).alias("bh"), F.when(F.col("cleared"), 0).otherwise(F.col("b.id")).cast("long").alias("bid"), F.col("b.min_height").alias("min_h"), F.lit(True).alias("hit"))
    out = cells.join(won, ["i", "j"], "left")
    return out.select("i", "j", F.when(F.col("hit"), F.col("bh")).otherwise(0.0).alias("bh"), F.coalesce("bid", F.lit(0)).alias("bid"), F.coalesce("min_h", F.lit(0.0)).alias("min_h"))


def segments(cells: DataFrame, footprints: DataFrame) -> DataFrame:
    """(i, j, segs): every footprint's (lo, hi) on a cell, highest first; an inner footprint clears the cell."""
    at = covered(footprints).where("height is not null and height > 0 or inner")
    got = at.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.when(~F.col("inner"), F.struct(F.col("height").alias("hi"), F.col("min_height").alias("lo"), "id"))), asc=False).alias("segs"), F.bool_or("inner").alias("cleared"))
    segs = F.when(~F.coalesce("cleared", F.lit(False)), F.transform("segs", lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))
    return cells.join(got, ["i", "j"], "left").select("i", "j", F.coalesce(segs, F.array().cast("array<struct<lo:double,hi:double>>")).alias("segs"))


def paint(cells: DataFrame, paints: DataFrame, priorities: DataFrame, default: int = 10) -> DataFrame:
    """(i, j, idx): the class of least priority number on a cell, else the default."""
    best = paints.join(F.broadcast(priorities.select("idx", "priority")), "idx").groupBy("i", "j").agg(F.min_by("idx", "priority").alias("idx"))
    return cells.join(best, ["i", "j"], "left").select("i", "j", F.coalesce("idx", F.lit(default)).alias("idx"))


def crowns(cells: DataFrame, trees: DataFrame, mesh: float = 1.0) -> DataFrame:
    """(i, j, top, bottom): ellipsoid crowns of radius crown/2 around (ci, cj), maxima of both, bottom at most top."""
    rows, cols = cells.agg(F.max("i"), F.max("j")).first()
    radius = F.greatest(F.col("crown") / 2, F.lit(1e-9))
    reach = lambda c: (F.floor(F.col(c) - radius / mesh).cast("int"), F.floor(F.col(c) + radius / mesh).cast("int"))
    (i0, i1), (j0, j1) = reach("ci"), reach("cj")
    near = trees.withColumn("i", F.explode(F.sequence(F.greatest(i0, F.lit(0)), F.least(i1, F.lit(rows))))).withColumn("j", F.explode(F.sequence(F.greatest(j0, F.lit(0)), F.least(j1, F.lit(cols)))))
    r = F.sqrt(F.pow((F.col("i") + 0.5 - F.col("ci")) * mesh, 2) + F.pow((F.col("j") + 0.5 - F.col("cj")) * mesh, 2))
    half, middle = (F.col("top") - F.col("bottom")) / 2, (F.col("top") + F.col("bottom")) / 2
    ratio = F.least(r / radius, F.lit(1.0))
    part = near.where(r <= F.col("crown") / 2).select("i", "j", (middle + half * F.sqrt(1.0 - ratio * ratio)).alias("t"), (middle - half * F.sqrt(1.0 - ratio * ratio)).alias("b"))
    most = part.groupBy("i", "j").agg(F.max("t").alias("t"), F.max("b").alias("b"))
    return cells.join(most, ["i", "j"], "left").select("i", "j", F.coalesce("t", F.lit(0.0)).alias("top"), F.coalesce(F.least("t", "b"), F.lit(0.0)).alias("bottom"))


def level_buildings(grid: DataFrame) -> DataFrame:
    """DEM (z) less its least value, one mean for each building (bid <> 0), less the least value again. A model's grid is
    one partition of the windows for each ``city_id`` where that column is there."""
    city = [c for c in ("city_id",) if c in grid.columns]
    everywhere = Window.partitionBy(*city)
    low = grid.withColumn("z", F.col("z") - F.min("z").over(everywhere))
    flat = low.withColumn("z", F.when(F.col("bid") != 0, F.avg("z").over(Window.partitionBy(*city, "bid"))).otherwise(F.col("z")))
    return flat.withColumn("z", F.col("z") - F.min("z").over(everywhere))


def canopy_from_classes(classes: DataFrame, height: float = 10.0, tree_codes: tuple = (5,)) -> DataFrame:
    """Fixed canopy on tree classes; the crown begins at the usual trunk ratio."""
    tree = F.col("code").isin(*tree_codes)
    return classes.withColumns({"top": F.when(tree, height).otherwise(0.0), "bottom": F.when(tree, height * dims.TRUNK_RATIO).otherwise(0.0)})


def pad_crop(grid: DataFrame, spine: DataFrame, shape: tuple[int, int], value: str, pad, align: str = "center") -> DataFrame:
    """Centred or top-left pad or crop to the cells of ``spine``."""
    ni, nj = grid.agg(F.max("i") + 1, F.max("j") + 1).first()
    di, dj = ((shape[0] - ni) // 2, (shape[1] - nj) // 2) if align == "center" else (0, 0)
    moved = grid.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), value)
    return spine.join(moved, ["i", "j"], "left").select("i", "j", F.coalesce(value, F.lit(pad)).alias(value))


def label_groups(grid: DataFrame, value: str) -> DataFrame:
    """Dense numbers 1..n of the distinct non-zero values, by value; 0 stays."""
    found = grid.where(F.col(value) != 0).select(value).distinct().withColumn("label", F.row_number().over(Window.orderBy(value)))
    return grid.join(found, value, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def layers(grid: DataFrame, interval: int = 5, mesh: float = 1.0) -> DataFrame:
    """(i, j, k, band, value): land cover, buildings, trees and terrain as four layers ``interval`` levels apart; heights
    are rounded to levels and empty values are left out."""
    level = lambda c: F.floor(F.col(c) / mesh + 0.5).cast("int")
    bands = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(n * interval).alias("k"), v.cast("int").alias("value")) for n, v in enumerate([F.col("code"), level("bh"), level("top"), level("z")])])
    return grid.withColumn("b", F.explode(bands)).where("b.value <> 0").select("i", "j", "b.k", "b.band", "b.value")


def covered_share(cells: DataFrame, boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """(i, j, bh, bid): of boxes (x0, y0, x1, y1 in cell units) that cover more than ``least`` of a cell, the greatest
    height, and the id that is last when they are ordered by height, highest first. Of equal boxes of one height only the
    last id is opened into cells."""
    b = boxes.where("x0 < x1 and y0 < y1").groupBy("x0", "y0", "x1", "y1", "height").agg(F.max("id").alias("id"))
    b = b.withColumn("i", F.explode(F.sequence(F.floor("x0"), F.ceil("x1") - 1))).withColumn("j", F.explode(F.sequence(F.floor("y0"), F.ceil("y1") - 1)))
    side = lambda a, z, c: F.least(F.col(z), F.col(c) + 1.0) - F.greatest(F.col(a), F.col(c).cast("double"))
    hit = b.where(side("x0", "x1", "i") * side("y0", "y1", "j") > least)
    best = hit.groupBy("i", "j").agg(F.max("height").alias("bh"), F.max_by("id", F.struct(-F.coalesce("height", F.lit(-1.0)), "id")).alias("bid"))
    return cells.join(best, ["i", "j"], "left").select("i", "j", F.coalesce("bh", F.lit(0.0)).alias("bh"), F.coalesce("bid", F.lit(0)).alias("bid"))


def highest_cover(cells: DataFrame, boxes: DataFrame, value: str) -> DataFrame:
    """(i, j, v): greatest value of the boxes that hold a cell's centre, else 0."""
    b = boxes.withColumn("i", F.explode(F.sequence(F.floor("x0").cast("int"), F.ceil("x1").cast("int")))).withColumn("j", F.explode(F.sequence(F.floor("y0").cast("int"), F.ceil("y1").cast("int"))))
    inside = (F.col("i") + 0.5).between(F.col("x0"), F.col("x1")) & (F.col("j") + 0.5).between(F.col("y0"), F.col("y1"))
    most = b.where(inside).groupBy("i", "j").agg(F.max(value).alias("v"))
    return cells.join(most, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def _last_of_place(points: DataFrame) -> DataFrame:
    """Of points (x, y, z, ord) at one place the later one, which is the nearest of them to any cell."""
    return points.groupBy("x", "y").agg(F.min(F.struct((-F.col("ord")).alias("o"), "z", "ord")).alias("p")).select("x", "y", "p.z", "p.ord")


def nearest_sample(cells: DataFrame, points: DataFrame, reach: int) -> DataFrame:
    """(i, j, z): value of the nearest point (x, y, z, ord) within ``reach`` cells of a centre, the later one of equally
    near; points are sent to the cells around them, so the work is places times (2 reach + 1)^2, dealt into tasks of about
    600,000 rows."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    sent = spread(_last_of_place(points), "x", "y", rows=max(1, 600_000 // (2 * reach + 1) ** 2)).withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps)).select((F.floor("x") + F.col("di")).cast("int").alias("i"), (F.floor("y") + F.col("dj")).cast("int").alias("j"), "x", "y", "z", "ord")
    far = F.pow(F.col("i") + 0.5 - F.col("x"), 2) + F.pow(F.col("j") + 0.5 - F.col("y"), 2)
    best = sent.groupBy("i", "j").agg(F.min(F.struct(far.alias("d"), (-F.col("ord")).alias("o"), "z")).alias("b"))
    return cells.join(best, ["i", "j"], "left").select("i", "j", F.col("b.z").alias("z"))


def nearest_of_all(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(i, j, z): value of the nearest point (x, y, z, ord) of a centre at any distance, the later one of equally near.
    Places go out in slices of a checked size, each as one list that a cell is compared with in its own row; the work is
    cells times places."""
    far = lambda p: F.struct((F.pow(F.col("i") + 0.5 - p["x"], 2) + F.pow(F.col("j") + 0.5 - p["y"], 2)).alias("d"), (-p["ord"]).alias("o"), p["z"].alias("z"))
    found = []
    for part in parts(_last_of_place(points)):
        all_ = part.agg(F.collect_list(F.struct("x", "y", "z", "ord")).alias("__p"))
        found.append(cells.crossJoin(F.broadcast(all_)).select("i", "j", F.array_min(F.transform("__p", far)).alias("b")))
    best = reduce(DataFrame.union, found).groupBy("i", "j").agg(F.min("b").alias("b"))
    return cells.join(best, ["i", "j"], "left").select("i", "j", F.col("b.z").alias("z"))


def flatten_water(grid: DataFrame, water: int = 9, diagonal: bool = True) -> DataFrame:
    """DEM of each connected water body becomes its least value."""
    from citylattice.operators.components import components

    wet = grid.where(F.col("code") == water).select("i", "j")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    name = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    beside = wet.withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])))
    edges = beside.select(name(F.col("i"), F.col("j")).alias("u"), (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j")).join(wet, ["i", "j"], "left_semi").select("u", name(F.col("i"), F.col("j")).alias("v"))
    bodies = components(edges).select(F.col("node.i").alias("i"), F.col("node.j").alias("j"), "root")
    joined = grid.join(bodies, ["i", "j"], "left")
    low = joined.where("root is not null").groupBy("root").agg(F.min("z").alias("low"))
    return joined.join(low, "root", "left").withColumn("z", F.coalesce("low", "z")).drop("root", "low")


def sanitise_canopy(grid: DataFrame, replacement: float = 10.0, least: float = 2.0, most: float = 35.0, tolerance: float = 1.0) -> DataFrame:
    """Canopy (top) on tree cells: none below ``least`` becomes the replacement, what is above ``most`` is cut, and a crown
    as high as a building beside it is taken for the roof and replaced."""
    from citylattice.operators.voxels import neighbourhood

    roof = neighbourhood(grid, 1, F.col("bh"), F.max).withColumnRenamed("out", "roof")
    t = F.when(F.col("top") < least, replacement).when(F.col("top") > most, most).otherwise(F.col("top"))
    leak = (F.col("roof") > 0) & (F.abs(t - F.col("roof")) <= tolerance)
    return grid.join(roof, ["i", "j"]).withColumn("top", F.when(F.col("tree"), F.when(leak, replacement).otherwise(t)).otherwise(0.0)).drop("roof")
