"""Footprints, trees, weather and rasters from landed files, brought to one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citylattice.functions import geometry as G

RING = "array<struct<x:double,y:double>>"


def numbered(rows: DataFrame, order: str, name: str = "id", start: int = 0) -> DataFrame:
    """``rows`` with a number without gaps in the order of a column: counts by range partition, then offsets; no task sees
    all rows."""
    from citylattice.session import cut

    sorted_ = cut(rows.orderBy(order).withColumn("__p", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id()))
    sizes = sorted_.groupBy("__p").agg(F.count(F.lit(1)).alias("__size"), F.min("__n").alias("__low"))
    # one row for each partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = sorted_.join(F.broadcast(before.select("__p", "__low", "__before")), "__p")
    return joined.withColumn(name, F.col("__before") + F.col("__n") - F.col("__low") + start).drop("__p", "__n", "__low", "__before")


# --- footprints -------------------------------------------------------------------------------------------------------


def stacked(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables one below the other; columns that one lacks are null there."""
    return first.unionByName(second, allowMissingColumns=True)


def height_of(height: Column, floors: Column, floor_height: float = 3.0, missing: float | None = None) -> Column:
    """A positive height, else a positive number of floors times their height, else ``missing``."""
    return F.coalesce(F.when(height > 0, height), F.when(floors > 0, floors * floor_height), F.lit(missing).cast("double")).cast("double")


def parts_of(features: DataFrame, polygons: str = "polygons", missing: float = -1.0) -> DataFrame:
    """One row for each part of features whose geometry is an array of rings, unknown heights as ``missing``; features
    without a part go."""
    rest = [c for c in features.columns if c not in (polygons, "height")]
    return features.select(*rest, F.coalesce("height", F.lit(missing)).alias("height"), F.explode(polygons).alias("ring"))


def within_box(features: DataFrame, box: tuple[float, float, float, float], ring: str = "ring") -> DataFrame:
    """Features whose bounds meet a box (w, s, e, n); those without a ring go."""
    area = F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(box, "wsen")])
    return features.where(F.col(ring).isNotNull() & (F.size(ring) > 0) & G.boxes_meet(G.bounds(F.col(ring)), area))


def clipped(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """The part of a convex or simple ring inside a box, by cutting along its four sides one after another; a ring wholly
    inside stays, one wholly beyond a side is gone."""
    sides = F.array(*[F.struct(F.lit(upright).alias("up"), F.lit(float(limit)).alias("limit"), F.lit(sign).alias("sign")) for upright, limit, sign in ((True, box[0], 1.0), (True, box[2], -1.0), (False, box[1], 1.0), (False, box[3], -1.0))])

    def cut_by(r: Column, s: Column) -> Column:
        n = F.size(r)
        place = lambda p: F.when(s["up"], p["x"]).otherwise(p["y"])
        inside = lambda p: (place(p) - s["limit"]) * s["sign"] >= 0

        def edge(e: Column) -> Column:
            p, q, t = e["p"], e["q"], (s["limit"] - place(e["p"])) / (place(e["q"]) - place(e["p"]))
            meet = G.point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
            kept = F.when(inside(p), F.array(p)).otherwise(F.array().cast(RING))
            return F.when(inside(p) != inside(q), F.concat(kept, F.array(meet))).otherwise(kept)

        return F.flatten(F.transform(F.transform(r, lambda p, i: F.struct(p.alias("p"), F.get(r, (i + 1) % n).alias("q"))), edge))

    def whole(r: Column) -> Column:
        b = G.bounds(r)
        within = (b["w"] >= box[0]) & (b["s"] >= box[1]) & (b["e"] <= box[2]) & (b["n"] <= box[3])
        beyond = (b["e"] < box[0]) | (b["n"] < box[1]) | (b["w"] > box[2]) | (b["s"] > box[3])
        return F.when(within, r).when(~beyond, F.aggregate(sides, r, cut_by))

    # a list of one names the ring, which is otherwise made anew wherever it stands
    return F.get(F.filter(F.transform(F.array(ring.cast(RING)), whole), lambda r: F.size(r) >= 3), 0)


def read_geojson(spark: SparkSession, path: str, id_column: str = "id") -> DataFrame:
    """(id, height, ring) of whole feature collections; features without an id take their place in the file."""
    schema = "struct<features:array<struct<id:long,properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>"
    each = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)["features"]).alias("n", "f"))
    own = F.coalesce(F.try_element_at("f.properties", F.lit(id_column)).try_cast("long"), F.col("f.id"), F.col("n").cast("long"))
    ring = F.transform(F.get("f.geometry.coordinates", 0), lambda p: G.point(F.get(p, 0), F.get(p, 1)))
    return each.select(own.alias("id"), F.try_element_at("f.properties", F.lit("height")).try_cast("double").alias("height"), ring.alias("ring"))


def with_ids(buildings: DataFrame, new_from: str = "ord") -> DataFrame:
    """Missing ids continue after the largest one, in the order of a column."""
    lost = numbered(buildings.where("id is null").drop("id"), new_from)
    top = F.broadcast(buildings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top")))
    return buildings.where("id is not null").unionByName(lost.crossJoin(top).withColumn("id", F.col("id") + F.col("__top") + 1).drop("__top").select(*buildings.columns))


# --- trees ------------------------------------------------------------------------------------------------------------


def _metres(tags: Column, key: str) -> Column:
    """A number that may carry the sign of metres."""
    return F.trim(F.regexp_replace(F.try_element_at(tags, F.lit(key)), "[mM]", "")).try_cast("double")


def trees_from_tags(nodes: DataFrame, top: float = 10.0, trunk: float = 4.0, crown: float | None = None, ratio: float = 0.6) -> DataFrame:
    """(node, top_height, bottom_height, crown_diameter, genus, species, leaf_type, leaf_cycle, lon, lat) of nodes (node, lon,
    lat, tags) that are trees and have a place. The crown comes from its own tag, else from the trunk's circumference, else
    from a default or the height; a trunk as high as the tree is cut to 0.4 of it."""
    tags = F.col("tags")
    height = F.coalesce(_metres(tags, "height"), _metres(tags, "est_height"), F.lit(top))
    wide = F.coalesce(_metres(tags, "diameter_crown"), _metres(tags, "circumference") / 3.14159 * 15, F.lit(crown).cast("double"), height * ratio)
    bottom = F.when(F.lit(trunk) >= height, height * 0.4).otherwise(F.lit(trunk))
    named = [F.try_element_at(tags, F.lit(k)).alias(k) for k in ("genus", "species", "leaf_type", "leaf_cycle")]
    here = nodes.where((F.try_element_at(tags, F.lit("natural")) == "tree") & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return here.select("node", height.alias("top_height"), bottom.alias("bottom_height"), wide.alias("crown_diameter"), *named, "lon", "lat")


def rings_of_relations(members: DataFrame, ways: DataFrame) -> DataFrame:
    """(relation, role, ring): rings that the ways (way, ring) of each relation (relation, role, way) form, joined at their
    ends in either direction, smallest way first; an open chain of three points or more is closed. The ways of one relation
    are a bounded group."""
    import pandas as pd

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {w: [(p["x"], p["y"]) for p in r] for w, r in sorted(zip(pdf.way, pdf.ring)) if r is not None and len(r) > 1}
        out = []
        while left:
            chain = left.pop(next(iter(left)))
            while chain[0] != chain[-1]:
                fits = next(((w, r if r[0] == chain[-1] else r[::-1]) for w, r in left.items() if chain[-1] in (r[0], r[-1])), None)
                if fits is None:
                    fits = next(((w, r if r[-1] == chain[0] else r[::-1]) for w, r in left.items() if chain[0] in (r[0], r[-1])), None)
                    if fits is None:
                        break
                    chain = fits[1][:-1] + chain
                else:
                    chain = chain + fits[1][1:]
                del left[fits[0]]
            if len(chain) >= 3:
                chain = chain if chain[0] == chain[-1] else [*chain, chain[0]]
                out.append((pdf.relation.iloc[0], pdf.role.iloc[0], [{"x": x, "y": y} for x, y in chain]))
        return pd.DataFrame(out, columns=["relation", "role", "ring"])

    return members.join(ways, "way").select("relation", "role", "way", "ring").groupBy("relation", "role").applyInPandas(stitch, f"relation long, role string, ring {RING}")


def outside_relations(ways: DataFrame, members: DataFrame) -> DataFrame:
    """Ways that are no member of any relation."""
    return ways.join(members.select("way").distinct(), "way", "left_anti")


# --- weather ----------------------------------------------------------------------------------------------------------


def read_epw_location(spark: SparkSession, path: str) -> DataFrame:
    """(city, state, country, station, lat, lon, tz, elevation) of each weather file's first line."""
    f = F.split("value", ",")
    number = lambda i: F.get(f, i).try_cast("double")
    names = [F.trim(F.get(f, i)).alias(n) for i, n in ((1, "city"), (2, "state"), (3, "country"), (5, "station"))]
    return spark.read.text(path).where(F.col("value").startswith("LOCATION") & (F.size(f) >= 10)).select(*names, number(6).alias("lat"), number(7).alias("lon"), number(8).alias("tz"), number(9).alias("elevation"))


def hours_of_year(spark: SparkSession, year: int) -> DataFrame:
    """(ts): every hour of a year."""
    return spark.sql(f"select explode(sequence(timestamp_ntz '{year}-01-01 00:00:00', timestamp_ntz '{year}-12-31 23:00:00', interval 1 hour)) ts").select(F.col("ts").cast("timestamp"))


def months_between(weather: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Samples from one (month, day) to another, ends included; the range may pass the turn of the year."""
    at = F.month("ts") * 100 + F.dayofmonth("ts")
    a, b = first[0] * 100 + first[1], last[0] * 100 + last[1]
    return weather.where(at.between(a, b) if a <= b else (at >= a) | (at <= b))


def typical_days(weather: DataFrame) -> DataFrame:
    """(month, hour, dni, dhi): means of each hour of the day by month."""
    return weather.groupBy(F.month("ts").alias("month"), F.hour("ts").alias("hour")).agg(F.avg("dni").alias("dni"), F.avg("dhi").alias("dhi"))


def daytime(weather: DataFrame, least: float = 5.0) -> DataFrame:
    """Samples whose sun (el) stands at ``least`` degrees or higher, with unit vectors north, east, up."""
    from citylattice.functions.exprs import axis_vector

    north, east, up = axis_vector(F.col("az"), F.col("el"))
    return weather.where(F.col("el") >= least).withColumns({"north": north, "east": east, "up": up})


# --- rasters ----------------------------------------------------------------------------------------------------------


def tile_pixels(tiles: DataFrame, size: int = 256, high: int | None = None) -> DataFrame:
    """(gx, gy, v) of tiles (x, y, rows array<array<double>>): the mosaic by place."""
    row = tiles.select("x", "y", F.posexplode("rows").alias("py", "row"))
    return row.select("x", "y", "py", F.posexplode("row").alias("px", "v")).select((F.col("x") * size + F.col("px")).alias("gx"), (F.col("y") * (high or size) + F.col("py")).alias("gy"), "v")


def first_of(pixels: DataFrame, order: str = "ord") -> DataFrame:
    """(gx, gy, v): of overlapping rasters the first that has a value; of several values of one, the least."""
    return pixels.where("v is not null").groupBy("gx", "gy").agg(F.min(F.struct(order, "v"))["v"].alias("v"))


def difference(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(gx, gy, v): heights above ground, where both rasters have a value."""
    return upper.join(lower.withColumnRenamed("v", "w"), ["gx", "gy"]).where("v is not null and w is not null").select("gx", "gy", (F.col("v") - F.col("w")).alias("v"))


def sea(grid: DataFrame, default: int, ocean: int) -> DataFrame:
    """Cells (code, land) that still hold a source's default class and are no land become ocean."""
    return grid.withColumn("code", F.when(~F.col("land") & (F.col("code") == default), ocean).otherwise(F.col("code")))


# --- lists of segments as offsets and values ---------------------------------------------------------------------------


def to_offsets(cells: DataFrame, order: list[str]) -> DataFrame:
    """(i, j, offset, n): places of the cells' segments in one flat list, an exclusive running total; rows of ``order[0]``
    are summed first, so that no task sees all cells."""
    n = cells.select(*order, F.size("segs").cast("long").alias("n"))
    lines = n.groupBy(order[0]).agg(F.sum("n").alias("t"))
    base = lines.select(order[0], F.coalesce(F.sum("t").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.sum("n").over(Window.partitionBy(order[0]).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return n.withColumn("own", inner).join(base, order[0]).select(*order, (F.col("base") + F.col("own")).alias("offset"), "n")


def from_offsets(offsets: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Segments again from (keys, offset, n) and the flat list (at, lo, hi)."""
    want = offsets.where("n > 0").select(*keys, F.explode(F.sequence("offset", F.col("offset") + F.col("n") - 1)).alias("at"))
    lists = want.join(values, "at").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lo", "hi"))), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("segs"))
    return offsets.select(*keys).join(lists, keys, "left").withColumn("segs", F.coalesce("segs", F.array().cast("array<struct<lo:double,hi:double>>")))
