"""Text and table sinks. Lines are formatted in Spark; ordered files are range-partitioned, not collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylattice.functions.exprs import half_up

# Class codes of the terrain text format, by standard class 1..14.
TOPOG_MATERIAL, TOPOG_TAIL = 0, 102


def topog_lines(grid: DataFrame, material: int = TOPOG_MATERIAL) -> DataFrame:
    """(ord, line): a line with the number of cells with buildings, then `i j height material 0.0 0.0 102`."""
    body = grid.where("bh > 0").select((F.col("j") * 1_000_000 + F.col("i") + 1).alias("ord"), F.format_string(f"%d %d %.1f %d 0.0 0.0 {TOPOG_TAIL}", F.col("i") + 1, F.col("j") + 1, "bh", F.lit(material)).alias("line"))
    head = grid.agg(F.lit(0).cast("long").alias("ord"), F.count_if(F.col("bh") > 0).cast("string").alias("line"))
    return head.union(body.select(F.col("ord").cast("long"), "line"))


def dem_lines(grid: DataFrame) -> DataFrame:
    """(ord, line): `i j elevation`, none below 0."""
    return grid.select((F.col("j") * 1_000_000 + F.col("i")).cast("long").alias("ord"), F.format_string("%d %d %.1f", F.col("i") + 1, F.col("j") + 1, F.greatest(F.col("z"), F.lit(0.0))).alias("line"))


def matrix_lines(grid: DataFrame, value: str) -> DataFrame:
    """(i, line): comma-separated rows of whole numbers, north first."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("j", half_up(F.col(value)).alias("v")))), lambda x: x["v"].cast("string"))
    return grid.groupBy("i").agg(F.array_join(cells, ",").alias("line"))


def write_lines(lines: DataFrame, path: str, order: str = "ord") -> None:
    """One text file per range, in order."""
    lines.orderBy(order).select("line").write.mode("overwrite").text(path)


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """A model as a folder of Parquet tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def features(rows: DataFrame, ring: str = "ring") -> DataFrame:
    """(line): rows as GeoJSON features, rings closed."""
    closed = F.when(F.get(ring, 0) == F.element_at(ring, -1), F.col(ring)).otherwise(F.concat(F.col(ring), F.array(F.get(ring, 0))))
    points = F.transform(closed, lambda p: F.array(p["x"], p["y"]))
    props = F.struct(*[c for c in rows.columns if c != ring])
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("line"))


# Land-use codes of the terrain text format by class name, for the Standard and OpenStreetMap classes that
# differ from the default, and the default.
LANDUSE = {"Bareland": 9, "Rangeland": 4, "Shrub": 4, "Moss and lichen": 4, "Agriculture land": 3, "Tree": 5, "Wet land": 2, "Mangroves": 5, "Water": 1, "Snow and ice": 9, "Developed space": 10, "Road": 16, "Building": 10, "No Data": 4}
LANDUSE_OTHER, UNDER_TREES = 4, 9


def landuse_codes(grid: DataFrame, names: list[str], under: int | None = None) -> DataFrame:
    """(i, j, code) of cells (idx, top, bh): a class index's code, what stands under trees where there is canopy and no
    building, and the code of buildings where there is one."""
    table = F.array(*[F.lit(LANDUSE.get(n, LANDUSE_OTHER)) for n in names])
    own = F.coalesce(F.get(table, F.col("idx")), F.lit(LANDUSE_OTHER))
    code = F.when(F.col("bh") > 0, LANDUSE["Building"]).when(F.col("top") > 0, UNDER_TREES if under is None else under).otherwise(own)
    return grid.select("i", "j", code.cast("int").alias("code"))


def tree_lines(grid: DataFrame, kind: int, ratio: float | None = None) -> DataFrame:
    """(ord, line): the number of cells with trees, then `i j lower upper kind` for every cell; no trees under buildings.
    The lower height is the canopy's bottom within the tree, or a share of the height."""
    top = F.when(F.col("bh") > 0, 0.0).otherwise(F.col("top"))
    low = F.least(F.greatest(F.col("bottom"), F.lit(0.0)), top) if ratio is None else top * ratio
    body = grid.select((F.col("j") * 1_000_000 + F.col("i") + 1).cast("long").alias("ord"), F.format_string(f"%d %d %.1f %.1f {kind}", F.col("i") + 1, F.col("j") + 1, low, top).alias("line"))
    return grid.agg(F.lit(0).cast("long").alias("ord"), F.count_if(top > 0).cast("string").alias("line")).union(body)


def place_lines(grid: DataFrame, box: tuple[float, float, float, float], shape: tuple[int, int]) -> DataFrame:
    """(ord, line): `i j longitude latitude`, evenly from bound to bound with both ends included."""
    at = lambda c, a, b, n: F.lit(a) + F.col(c) * ((b - a) / max(n - 1, 1))
    lon, lat = at("i", box[0], box[2], shape[0]), at("j", box[1], box[3], shape[1])
    return grid.select((F.col("j") * 1_000_000 + F.col("i")).cast("long").alias("ord"), F.format_string("%d %d %.7f %.8f", F.col("i") + 1, F.col("j") + 1, lon, lat).alias("line"))


def model_grids(grid: DataFrame, shape: tuple[int, int], mesh: float) -> DataFrame:
    """Grids of a microclimate model: unknown heights are 10, border cells have none, heights are whole meshes, terrain
    begins at 0."""
    border = F.col("i").isin(0, shape[0] - 1) | F.col("j").isin(0, shape[1] - 1)
    low = F.broadcast(grid.agg(F.min("z").alias("__low")))
    height = F.floor(F.when(border, 0.0).otherwise(F.coalesce("bh", F.lit(10.0))) / mesh + 0.5) * mesh
    return grid.crossJoin(low).withColumns({"bh": height, "z": F.col("z") - F.col("__low")}).drop("__low")


def constant_lines(grid: DataFrame, value: str) -> DataFrame:
    """(i, line): comma-separated rows that hold one value everywhere."""
    return grid.groupBy("i").agg(F.array_join(F.array_repeat(F.lit(value), F.count(F.lit(1)).cast("int")), ",").alias("line"))


def leaf_profile(plants: DataFrame, ratio: float, density: str = "1.00000") -> DataFrame:
    """(height, z, line): a line for each metre of crown of plants (height), from the trunk's top on."""
    start = F.greatest((F.col("height") * ratio).cast("int"), F.lit(0))
    levels = F.when(start < F.col("height"), F.sequence(start, F.col("height") - 1))
    return plants.select("height", F.explode(levels).alias("z")).select("height", "z", F.concat(F.lit("     0,0,"), F.col("z").cast("string"), F.lit(f",{density}")).alias("line"))


def plant_records(plants: DataFrame, ratio: float) -> DataFrame:
    """(height, line): plant records of a plant database, whose crowns begin at a share of the height."""
    fields = [("ID", F.format_string("H%02dW01", "height")), ("Description", F.format_string("H%02dW01", "height")), ("Height", F.format_string("%.5f", F.col("height").cast("double"))), ("Depth", F.format_string("%.5f", F.col("height") * ratio))]
    return plants.select("height", F.concat(F.lit("<PLANT3D>"), *[F.concat(F.lit(f"<{n}> "), v, F.lit(f" </{n}>")) for n, v in fields], F.lit("</PLANT3D>")).alias("line"))


def terms_beyond(first: Column, ratio: Column, target: Column) -> Column:
    """Least number of terms of a geometric series whose sum passes a positive target; null where none does."""
    guess = F.when(ratio == 1, F.floor(target / first) + 1).otherwise(F.floor(F.log(1 - target * (1 - ratio) / first) / F.log(ratio)) + 1)
    total = lambda n: F.when(ratio == 1, first * n).otherwise(first * (1 - F.pow(ratio, n)) / (1 - ratio))
    near = F.filter(F.sequence(F.greatest(guess - 2, F.lit(1)), guess + 2), lambda n: total(n) > target)
    reachable = (first > 0) & ((ratio >= 1) | (first / (1 - ratio) > target))
    return F.when(reachable, F.array_min(near)).cast("long")


def dense_codes(cells: DataFrame, code: str = "code", start: int = 0) -> DataFrame:
    """(code, n): codes that occur, numbered in order; a handful of rows."""
    from pyspark.sql import Window

    return cells.select(code).distinct().withColumn("n", F.row_number().over(Window.orderBy(code)) - 1 + start)


def blocks(cells: DataFrame, most: int = 255) -> DataFrame:
    """Voxels with the block (bi, bj, bk) of at most ``most`` on a side that holds them, and their place in it."""
    cut_ = {f"b{c}": F.floor(F.col(c) / most).cast("int") for c in ("i", "j", "k")}
    return cells.withColumns(cut_ | {f"in_{c}": (F.col(c) % most).cast("int") for c in ("i", "j", "k")})


def coordinates(cells: DataFrame, mesh: float, middle: bool) -> DataFrame:
    """Voxels with metres along each axis, of their lower corner or their middle."""
    half = 0.5 if middle else 0.0
    return cells.withColumns({n: (F.col(c) + half) * mesh for n, c in (("y", "i"), ("x", "j"), ("z", "k")) if c in cells.columns})


def draped(grid: DataFrame, low: float, high: float, colours: int) -> DataFrame:
    """(i, j, z, colour): a value grid over terrain, in so many equal classes from 0; values beyond the ends take the last."""
    at = F.floor((F.col("value") - low) / (high - low) * colours).cast("int")
    return grid.select("i", "j", "z", F.when(F.col("value").isNotNull(), F.least(F.greatest(at, F.lit(0)), F.lit(colours - 1))).alias("colour"))


def unshared(faces: DataFrame) -> DataFrame:
    """(face, pos, vertex, p): a vertex of its own for each corner of each face (face, vertices array<struct>)."""
    each = faces.select("face", F.posexplode("vertices").alias("pos", "p"))
    return each.select("face", "pos", F.concat_ws("_", "face", "pos").alias("vertex"), "p")


def mesh_lines(faces: DataFrame) -> DataFrame:
    """(ord, line): a wavefront file of quads (face, material, vertices): their points, then faces by material. Numbers come
    from the faces' own numbers from 0, so that no file has to be counted first."""
    corner = F.posexplode("vertices").alias("pos", "p")
    points = faces.select("face", corner).select((F.col("face") * 4 + F.col("pos")).cast("long").alias("ord"), F.format_string("v %.3f %.3f %.3f", "p.x", "p.y", "p.z").alias("line"))
    n = F.col("face") * 4
    quads = faces.select((F.lit(1 << 50) + F.col("face")).cast("long").alias("ord"), F.concat(F.lit("usemtl m"), F.col("material").cast("string"), F.format_string("\nf %d %d %d %d", n + 1, n + 2, n + 3, n + 4)).alias("line"))
    return points.union(quads)
