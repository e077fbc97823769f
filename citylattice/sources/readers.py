"""Text sources: weather files, map tags, elevation tiles, wavefront groups. Files are landed first; Spark reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_epw(spark: SparkSession, path: str) -> DataFrame:
    """(ts, dni, dhi): weather lines after the 8 header lines. Hours count from 1 in the file and from 0 here; lines of
    fewer than 16 fields go, values that are no numbers are null."""
    f = F.split("value", ",")
    number = lambda i: F.get(f, i).try_cast("double")
    rows = spark.read.text(path).where(F.size(f) >= 16).where(F.get(f, 0).rlike("^[0-9]{4}$"))
    ts = F.make_timestamp(number(0).cast("int"), number(1).cast("int"), number(2).cast("int"), number(3).cast("int") - 1, F.lit(0), F.lit(0))
    return rows.select(ts.alias("ts"), number(14).alias("dni"), number(15).alias("dhi"))


def height_from_tags(tags: Column, floor_height: float = 3.0) -> Column:
    """height, else building:height, else levels times the floor height, else 0."""
    get = lambda k: F.try_element_at(tags, F.lit(k)).try_cast("double")
    levels = F.coalesce(get("building:levels"), get("levels"), get("num_floors"))
    return F.coalesce(get("height"), get("building:height"), levels * floor_height, F.lit(0.0))


def underground(tags: Column) -> Column:
    """Whether tags describe something below the ground."""
    get = lambda k: F.try_element_at(tags, F.lit(k))
    first = lambda k: F.get(F.split(get(k), "[;,]"), 0).try_cast("double")
    layer, level = first("layer"), first("level")
    tunnel = get("tunnel").isNotNull() & (get("tunnel") != "no")
    deep = (layer < -1) & (level < 0) | (layer <= -3) & level.isNull()
    return F.coalesce(get("location") == "underground", F.lit(False)) | F.coalesce(tunnel & ((layer < 0) | (level < 0)), F.lit(False)) | F.coalesce(deep, F.lit(False))


def dem_tile(text: Column, size: int = 256) -> Column:
    """Elevations of a comma-separated tile as array<array<double>>; e, blanks and faults are null."""
    lines = F.slice(F.split(F.regexp_replace(text, r"\s+$", ""), "\n"), 1, size)
    return F.transform(lines, lambda line: F.transform(F.split(line, ","), lambda v: F.trim(v).try_cast("double")))


def backfill(fine: DataFrame, coarse: DataFrame, levels: int) -> DataFrame:
    """Fine pixels (gx, gy, v) with gaps filled from a pyramid level that is ``levels`` coarser."""
    c = coarse.select(F.col("gx").alias("cx"), F.col("gy").alias("cy"), F.col("v").alias("cv"))
    on = (F.shiftright("gx", levels) == F.col("cx")) & (F.shiftright("gy", levels) == F.col("cy"))
    return fine.join(c, on, "left").select("gx", "gy", F.coalesce("v", "cv").alias("v"))


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, kind, name, numbers, grp): vertices and faces of wavefront files with the group each stands in."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    word = F.split(F.trim("text"), r"\s+")
    kind = F.get(word, 0)
    named = lines.where(kind.isin("v", "f", "o", "g")).withColumns({"kind": kind, "name": F.when(kind.isin("o", "g"), F.array_join(F.slice(word, F.lit(2), F.size(word)), " ")), "numbers": F.when(kind.isin("v", "f"), F.transform(F.slice(word, F.lit(2), F.size(word)), lambda x: F.get(F.split(x, "/"), 0).try_cast("double")))})
    return named.withColumn("grp", F.last("name", ignorenulls=True).over(Window.partitionBy("file").orderBy("line")))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited features, gzip included: (height, ring) with 0 for a missing height; broken lines go."""
    schema = "struct<properties:struct<height:double>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>"
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("f")).where("f.geometry.coordinates is not null")
    return parsed.select(F.coalesce("f.properties.height", F.lit(0.0)).alias("height"), F.transform(F.get("f.geometry.coordinates", 0), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))).alias("ring"))


# 0-based class of map tags, as (class, key, values); no values stand for any. The first rule that fits decides.
TAG_RULES = [
    (11, "highway", ()),
    (12, "building", ()),
    (10, "landuse", ("industrial", "retail", "commercial", "residential", "construction", "railway")),
    (10, "amenity", ("parking",)),
    (10, "place", ("islet", "island")),
    (0, "landuse", ("quarry", "brownfield", "landfill")),
    (0, "natural", ("bare_rock", "scree", "shingle", "rock", "sand", "desert", "beach")),
    (1, "landuse", ("grass", "meadow")),
    (1, "natural", ("grassland", "heath")),
    (1, "leisure", ("garden", "park")),
    (2, "natural", ("scrub",)),
    (3, "landuse", ("farmland", "orchard", "vineyard", "plant_nursery", "greenhouse_horticulture", "flowerbed", "allotments")),
    (4, "natural", ("wood", "tree", "tree_row", "tree_canopy")),
    (4, "landuse", ("forest",)),
    (5, "natural", ("fell",)),
    (6, "natural", ("wetland",)),
    (6, "wetland", ("marsh", "swamp", "bog", "fen")),
    (7, "wetland", ("mangrove",)),
    (8, "natural", ("water", "bay")),
    (8, "landuse", ("reservoir", "basin")),
    (8, "water", ("ocean", "sea", "lake")),
    (9, "natural", ("glacier",)),
    (13, "FIXME", ()),
    (13, "natural", ("cloud",)),
    (11, "area:highway", ()),
]


def classify_tags(tags: Column) -> Column:
    """0-based class of map tags, null where no rule fits."""
    out = None
    for code, key, values in TAG_RULES:
        value = F.try_element_at(tags, F.lit(key))
        fits = value.isin(*values) if values else value.isNotNull()
        out = F.when(fits, code) if out is None else out.when(fits, code)
    return out


def is_area(tags: Column, nodes: Column) -> Column:
    """Whether a closed way is a polygon."""
    has = lambda k: F.try_element_at(tags, F.lit(k)).isNotNull()
    closed = (F.size(nodes) > 2) & (F.get(nodes, 0) == F.element_at(nodes, -1))
    return closed & (has("building") | (F.coalesce(F.try_element_at(tags, F.lit("area")), F.lit("")) == "yes") | has("landuse") | has("natural") | has("water") | has("leisure") | has("amenity"))


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, ring): coordinates of ways (way, nodes array<long>) in order; a way that misses a node is empty."""
    each = ways.select("way", F.posexplode("nodes").alias("pos", "node"))
    joined = each.join(nodes.select("node", "lon", "lat"), "node", "left")
    got = joined.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"), F.count_if(F.col("lon").isNull()).alias("gaps"))
    return got.select("way", F.when(F.col("gaps") == 0, F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>")).alias("ring"))
