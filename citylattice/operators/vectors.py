"""Joins of footprints, points and edges: overlap transfer, completion, id conflicts, zones, nearest rows, slopes.

Spatial joins of rectangles are equi-joins on the cells both cover (a bucket grid), with each pair taken once from the
bucket of its intersection's corner; no join here is a product of two tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylattice.functions.exprs import haversine_km, inside_ring
from citylattice.session import parts, spread
from citylattice.sources.geodata import numbered

BUCKET = 4
RECTANGLE = ["i0", "j0", "i1", "j1"]


def _bucketed(rows: DataFrame, prefix: str) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(a) / BUCKET), F.floor((F.col(b) - 1) / BUCKET))
    named = rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in rows.columns], F.explode(span("i0", "i1")).alias("bi"), "j0", "j1")
    return named.withColumn("bj", F.explode(span("j0", "j1"))).drop("j0", "j1")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rectangles that share cells, columns prefixed a_ and b_, with the shared area. Equal rectangles pair all with
    all: callers reduce them to one row first."""
    both = _bucketed(a.where("i0 < i1 and j0 < j1"), "a_").join(_bucketed(b.where("i0 < i1 and j0 < j1"), "b_"), ["bi", "bj"])
    low = {x: F.greatest(f"a_{x}0", f"b_{x}0") for x in "ij"}
    high = {x: F.least(f"a_{x}1", f"b_{x}1") for x in "ij"}
    once = (F.col("bi") == F.floor(low["i"] / BUCKET)) & (F.col("bj") == F.floor(low["j"] / BUCKET))
    return both.where((low["i"] < high["i"]) & (low["j"] < high["j"]) & once).withColumn("area", (high["i"] - low["i"]) * (high["j"] - low["j"])).drop("bi", "bj")


def transfer_heights(primary: DataFrame, reference: DataFrame) -> DataFrame:
    """primary with height: rows without a positive height get the area-weighted mean of references they overlap; zero
    heights dilute it, nothing or a sum of 0 gives null. Equal rectangles are summed before they are paired."""
    need = primary.where("height is null or height <= 0")
    sums = reference.groupBy(*RECTANGLE).agg(F.sum(F.coalesce("height", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("n"))
    pairs = overlaps(need.select(*RECTANGLE).distinct(), sums)
    places = pairs.groupBy(*[F.col(f"a_{c}").alias(c) for c in RECTANGLE]).agg(F.sum(F.col("b_total") * F.col("area")).alias("__t"), F.sum(F.col("b_n") * F.col("area")).alias("__n"))
    got = need.join(places, RECTANGLE).groupBy(F.col("id").alias("__id")).agg((F.sum("__t") / F.sum("__n")).alias("__h"))
    joined = primary.join(got, primary["id"] == got["__id"], "left")
    height = F.when(F.col("height") > 0, F.col("height")).otherwise(F.when(F.col("__h") > 0, F.col("__h")))
    return joined.withColumn("height", height).drop("__id", "__h")


def append_unmatched(primary: DataFrame, reference: DataFrame) -> DataFrame:
    """primary and the references that overlap none of it, with new ids after the largest one. Only different rectangles
    are paired."""
    pairs = overlaps(reference.select(*RECTANGLE).distinct(), primary.select(*RECTANGLE).distinct())
    hit = pairs.select(*[F.col(f"a_{c}").alias(c) for c in RECTANGLE]).distinct()
    alone = reference.join(hit, RECTANGLE, "left_anti")
    top = primary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = numbered(alone, "id", "__new", 1).join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("__new")).drop("__new", "top")
    return primary.unionByName(new, allowMissingColumns=True)


def merge_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """first and second; rows of second whose id is taken get new ids after the largest of both."""
    taken = second.join(first.select("id").distinct(), "id", "left_semi").select("id").distinct()
    top = first.select("id").union(second.select("id")).agg(F.max("id").alias("top"))
    renumbered = numbered(taken, "id", "__at", 1).join(F.broadcast(top)).select("id", (F.col("top") + F.col("__at")).alias("__new"))
    moved = second.join(renumbered, "id", "left").withColumn("id", F.coalesce("__new", "id")).drop("__new")
    return first.unionByName(moved, allowMissingColumns=True)


def overlap_parents(footprints: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, parent): the largest footprint that covers more than ``threshold`` of a smaller one, by area and then id. Only
    different rectangles are paired, each with its least id; that id also stands before all others of an equal area."""
    size = (F.col("i1") - F.col("i0")) * (F.col("j1") - F.col("j0"))
    kinds = footprints.groupBy(*RECTANGLE).agg(F.min("id").alias("id")).withColumn("size", size)
    pairs = overlaps(kinds, kinds).where("b_size >= a_size").where(F.col("area") > threshold * F.col("a_size"))
    larger = F.max(F.when(F.col("b_size") > F.col("a_size"), F.struct(F.col("b_size").alias("size"), (-F.col("b_id")).alias("o"), F.col("b_id").alias("id"))))
    equal = F.min(F.when(F.col("b_size") == F.col("a_size"), F.struct(F.col("b_size").alias("size"), F.col("b_id").alias("id"))))
    best = pairs.groupBy(*[F.col(f"a_{c}").alias(c) for c in RECTANGLE]).agg(larger.alias("larger"), equal.alias("equal"))
    parent = F.coalesce("larger.id", F.when(F.col("equal.id") < F.col("id"), F.col("equal.id")))
    found = footprints.select("id", *RECTANGLE).join(best, RECTANGLE).select("id", F.coalesce("larger.size", "equal.size").alias("size"), parent.alias("parent")).where("parent is not null")
    # dealt before the aggregate, which sorts
    return found.repartition("id").groupBy("id").agg(F.max_by("parent", F.struct("size", -F.col("parent"))).alias("parent"))


def zone_cells(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, i, j): cells whose centre lies in a zone's ring; candidates come from the ring's bounds."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = zones.where(F.size("ring") >= 3).select("zone_id", "ring", F.explode(F.sequence(F.floor(F.array_min(xs)), F.ceil(F.array_max(xs)))).alias("i"), F.floor(F.array_min(ys)).alias("y0"), F.ceil(F.array_max(ys)).alias("y1"))
    near = box.select("zone_id", "ring", F.col("i").cast("int").alias("i"), F.explode(F.sequence("y0", "y1")).alias("j")).withColumn("j", F.col("j").cast("int"))
    return near.join(cells.select("i", "j"), ["i", "j"], "left_semi").where(inside_ring(F.col("i") + 0.5, F.col("j") + 0.5, F.col("ring"))).select("zone_id", "i", "j")


def zone_stats(members: DataFrame, grid: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Per zone: cells, valid (finite) cells, weighted mean, least, most and population deviation."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    w = F.col(weight) if weight else F.lit(1.0)
    good = F.when(ok, v)
    return members.join(grid, ["i", "j"]).groupBy("zone_id").agg(F.count(F.lit(1)).alias("cell_count"), F.count_if(ok).alias("valid_count"), (F.sum(good * w) / F.sum(F.when(ok, w))).alias("mean"), F.min(good).alias("min"), F.max(good).alias("max"), F.stddev_pop(good).alias("std"))


def nearest_station(points: DataFrame, stations: DataFrame) -> DataFrame:
    """(id, station_id, km): nearest station of each point, ties to the smaller id, however far it is. Stations go out in
    slices of a checked size, each as one list that a point is compared with in its own row; the nearest of all is taken."""
    dealt = spread(points, "id")
    km = lambda s: F.struct(haversine_km(F.col("lon"), F.col("lat"), s["lon"], s["lat"]).alias("km"), s["station_id"].alias("station_id"))
    near = []
    for part in parts(stations.select("station_id", "lon", "lat")):
        all_ = part.agg(F.collect_list(F.struct("station_id", "lon", "lat")).alias("__s")).where(F.size("__s") > 0)
        near.append(dealt.crossJoin(F.broadcast(all_)).select("id", F.array_min(F.transform("__s", km)).alias("b")))
    return reduce(DataFrame.union, near).groupBy("id").agg(F.min("b").alias("b")).select("id", "b.station_id", "b.km")


def edge_slopes(points: DataFrame) -> DataFrame:
    """(edge_id, slope): plain mean of the percentages between consecutive points (edge_id, idx, dist, z)."""
    by = Window.partitionBy("edge_id").orderBy("idx")
    run, rise = F.col("dist") - F.lag("dist").over(by), F.abs(F.col("z") - F.lag("z").over(by))
    return points.select("edge_id", F.when(run > 0, rise / run * 100).alias("s")).groupBy("edge_id").agg(F.avg("s").alias("slope"))


def points_along(lines: DataFrame, interval: float) -> DataFrame:
    """(edge_id, idx, dist): a point every interval from 0, and the end; a line shorter than that has its two ends."""
    n = F.floor(F.col("length") / interval).cast("int")
    regular = F.transform(F.sequence(F.lit(0), n), lambda s: s * F.lit(float(interval)))
    marks = F.when(F.col("length") <= interval, F.array(F.lit(0.0), F.col("length"))).when(n * interval < F.col("length"), F.concat(regular, F.array(F.col("length")))).otherwise(regular)
    return lines.select("edge_id", F.posexplode(marks).alias("idx", "dist"))


def weighted_mean(pieces: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Length-weighted mean of a value by key; rows without a value take no part."""
    got = F.col(value).isNotNull()
    return pieces.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(got, F.col(weight)))).alias("mean"))


def completed(height: Column, default: float = 10.0) -> tuple[Column, Column]:
    """Height with the default for null and 0, and whether it is estimated."""
    missing = height.isNull() | (height == 0)
    return F.when(missing, default).otherwise(height), missing
