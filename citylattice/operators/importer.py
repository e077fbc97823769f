"""Meshes into the voxel relation: columns that triangles cross, shells, windows, and stamping with new ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citylattice.functions import dims
from citylattice.operators.components import components
from citylattice.operators.voxels import paired_hits
from citylattice.session import TASK_ROWS

SIDES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def triangle_hits(triangles: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(name, i, j, z): heights at which triangles (name, a, b, c: points in cells) cross the middle line of each column,
    by barycentric weights; upright triangles cross none, and a hit on a shared edge counts once. Triangles and hits are dealt
    into tasks by the number of triangles."""
    p = {n: {c: F.col(n)[c] for c in "xyz"} for n in "abc"}
    cells = lambda c, n: F.sequence(F.greatest(F.ceil(F.least(*[p[k][c] for k in "abc"]) - 0.5), F.lit(0)).cast("int"), F.least(F.floor(F.greatest(*[p[k][c] for k in "abc"]) - 0.5), F.lit(n - 1)).cast("int"))
    some = lambda c, n: F.when(F.greatest(F.ceil(F.least(*[p[k][c] for k in "abc"]) - 0.5), F.lit(0)) <= F.least(F.floor(F.greatest(*[p[k][c] for k in "abc"]) - 0.5), F.lit(n - 1)), cells(c, n))
    tasks = max(1, -(-triangles.count() // TASK_ROWS))
    at = triangles.repartition(tasks, "name", "a", "b", "c").withColumn("i", F.explode(some("x", shape[0]))).withColumn("j", F.explode(some("y", shape[1])))
    x, y = F.col("i") + 0.5, F.col("j") + 0.5
    cross = lambda q, r: (p[q]["x"] - x) * (p[r]["y"] - y) - (p[r]["x"] - x) * (p[q]["y"] - y)
    u, v, w = cross("b", "c"), cross("c", "a"), cross("a", "b")
    area = u + v + w
    inside = (area != 0) & (((u >= 0) & (v >= 0) & (w >= 0)) | ((u <= 0) & (v <= 0) & (w <= 0)))
    return at.where(inside).select("name", "i", "j", F.round((u * p["a"]["z"] + v * p["b"]["z"] + w * p["c"]["z"]) / area, 9).alias("z")).repartition(tasks, "name", "i", "j").distinct()


def filled(hits: DataFrame) -> DataFrame:
    """(name, i, j, k): voxels between the crossings of each mesh."""
    names = hits.select("name").distinct().withColumn("slot", F.row_number().over(Window.orderBy("name")) - 1)
    # a mesh is one plane of columns of its own
    wide = hits.join(F.broadcast(names), "name").select((F.col("i") + F.col("slot") * (1 << 20)).alias("i"), "j", "z")
    spans = paired_hits(wide).withColumn("slot", F.floor(F.col("i") / (1 << 20))).withColumn("i", (F.col("i") % (1 << 20)).cast("int"))
    return spans.join(F.broadcast(names), "slot").select("name", "i", "j", F.explode(F.sequence("k0", F.col("k1") - 1)).alias("k"))


def surface_cells(points: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(name, i, j, k): cells of the grid that surface points (name, x, y, z) fall into."""
    at = points.select("name", *[F.floor(c).cast("int").alias(n) for c, n in (("x", "i"), ("y", "j"), ("z", "k"))])
    return at.where(F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1) & F.col("k").between(0, shape[2] - 1)).distinct()


def normal_axis(cells: DataFrame) -> DataFrame:
    """(name, axis): the axis along which the cells of a pane vary least; null for lines, points and fewer than three cells."""
    spread = cells.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(c) for c in ("i", "j", "k")])
    order = F.array_sort(F.array(*[F.struct(F.col(c).alias("v"), F.lit(a).alias("a")) for a, c in enumerate(("i", "j", "k"))]))
    return spread.select("name", F.when((F.col("n") >= 3) & (F.get(order, 1)["v"] >= 1e-9), F.get(order, 0)["a"]).alias("axis"))


def _beside(cells: DataFrame, axes: tuple) -> DataFrame:
    """Cells with their neighbours (ni, nj, nk) along some axes."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in SIDES if any((a, b, c)[x] for x in axes)])
    return cells.withColumn("d", F.explode(steps)).select(*cells.columns, (F.col("i") + F.col("d.a")).alias("ni"), (F.col("j") + F.col("d.b")).alias("nj"), (F.col("k") + F.col("d.c")).alias("nk"))


def exposed(solid: DataFrame, axis: int) -> DataFrame:
    """Solid cells (i, j, k) with an empty neighbour along an axis; beyond the grid all is empty."""
    other = solid.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("k").alias("nk"), F.lit(True).alias("full"))
    return _beside(solid.select("i", "j", "k"), (axis,)).join(other, ["ni", "nj", "nk"], "left").where("full is null").select("i", "j", "k").distinct()


def outside_air(air: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Air cells (i, j, k) that are joined with the grid's border through air: components of neighbouring cells, the border
    being one more node."""
    ni, nj, nk = shape
    number = lambda i, j, k: (F.col(i).cast("long") * nj + F.col(j)) * nk + F.col(k)
    nodes = air.select("i", "j", "k", number("i", "j", "k").alias("u"))
    other = nodes.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("k").alias("nk"), F.col("u").alias("v"))
    links = _beside(nodes, (0, 1, 2)).join(other, ["ni", "nj", "nk"]).where("u < v").select("u", "v")
    rim = F.col("i").isin(0, ni - 1) | F.col("j").isin(0, nj - 1) | F.col("k").isin(0, nk - 1)
    border = nodes.where(rim).select("u", F.lit(-1).cast("long").alias("v"))
    found = components(links.union(border)).where("root = -1").select(F.col("node").alias("u"))
    return nodes.join(found, "u").select("i", "j", "k")


def hull(solid: DataFrame, outside: DataFrame, axes: tuple) -> DataFrame:
    """Solid cells next to outside air along some axes: walls for (0, 1), roofs and floors for (2,)."""
    other = outside.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("k").alias("nk"))
    return _beside(solid.select("i", "j", "k"), axes).join(other, ["ni", "nj", "nk"], "left_semi").select("i", "j", "k").distinct()


def stamped_windows(panes: DataFrame, walls: DataFrame, radius: int = 1, code: int = dims.MATERIALS["glass"]) -> DataFrame:
    """(i, j, k, code): the wall cell nearest to each pane cell, if it is within ``radius`` along every axis; of equally near
    ones the first by place."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    near = panes.select(F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("k").alias("pk")).distinct()
    for c, d in (("i", "pi"), ("j", "pj"), ("k", "pk")):
        near = near.withColumn("__s", F.explode(steps)).withColumn(c, F.col(d) + F.col("__s")).drop("__s")
    far = sum((F.pow(F.col(c) - F.col(d), 2) for c, d in (("i", "pi"), ("j", "pj"), ("k", "pk"))), F.lit(0.0))
    met = near.join(walls.select("i", "j", "k"), ["i", "j", "k"]).groupBy("pi", "pj", "pk").agg(F.min(F.struct(far.alias("far"), "i", "j", "k")).alias("m"))
    return met.select("m.i", "m.j", "m.k").distinct().withColumn("code", F.lit(code))


def stamped(cells: DataFrame, occupied: DataFrame, mesh: float = 1.0) -> DataFrame:
    """Cells (i, j, bh, bid, z) with the buildings of occupied voxels (name, i, j, k): names get new ids in order, the last
    name of a column wins it, heights are those above the ground's level and never fall."""
    names = occupied.select("name").distinct().withColumn("n", F.row_number().over(Window.orderBy("name")))
    top = F.broadcast(cells.agg(F.coalesce(F.max("bid"), F.lit(0)).alias("__top")))
    held = occupied.join(F.broadcast(names), "name").groupBy("i", "j").agg(F.max("n").alias("n"), (F.max("k") + 1).alias("high"))
    ground = (F.col("z") / mesh + 0.5).cast("int") + 1
    joined = cells.crossJoin(top).join(held, ["i", "j"], "left")
    return joined.withColumns({"bid": F.when(F.col("n").isNotNull(), F.col("__top") + F.col("n")).otherwise(F.col("bid")), "bh": F.when(F.col("n").isNotNull(), F.greatest(F.coalesce("bh", F.lit(0.0)), (F.col("high") - ground) * mesh)).otherwise(F.col("bh"))}).drop("__top", "n", "high")


def levels_needed(cells: DataFrame, mesh: float = 1.0) -> DataFrame:
    """(ni, nj, nk, bytes): the size of the voxel relation before it is made; unknown heights count 10."""
    high = F.max(F.coalesce("bh", F.lit(10.0)) + F.col("z") + F.col("top")) / mesh
    n = [F.max(c) + 1 for c in ("i", "j")]
    return cells.agg(n[0].alias("ni"), n[1].alias("nj"), (F.ceil(high).cast("int") + 1).alias("nk")).withColumn("bytes", F.col("ni").cast("long") * F.col("nj") * F.col("nk"))


# --- canopy from a surface model ----------------------------------------------------------------------------------------


def resized(grid: DataFrame, shape: tuple[int, int], wanted: tuple[int, int]) -> DataFrame:
    """(i, j, v) of another shape, each cell taking the nearest place from end to end, halves to even."""
    def places(c: str, n: int, m: int) -> DataFrame:
        spine = grid.sparkSession.range(m).select(F.col("id").cast("int").alias(f"new_{c}"))
        return spine.withColumn(c, F.bround(F.col(f"new_{c}") * ((n - 1) / max(m - 1, 1))).cast("int"))

    out = grid
    for c, n, m in zip(("i", "j"), shape, wanted):
        out = out.join(F.broadcast(places(c, n, m)), c)
    return out.select(F.col("new_i").alias("i"), F.col("new_j").alias("j"), "v")


def canopy_from_surface(grid: DataFrame, tree: int) -> DataFrame:
    """(i, j, top) of cells (code, v): heights at tree cells, none below 0, null elsewhere."""
    return grid.select("i", "j", F.when(F.col("code") == tree, F.greatest(F.col("v"), F.lit(0.0))).alias("top"))


def around(grid: DataFrame, radius: int, aggregates: dict) -> DataFrame:
    """(i, j, ...): aggregates over the cells around each cell of the grid, itself included."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    rest = [c for c in grid.columns if c not in ("i", "j")]
    sent = grid.withColumn("__di", F.explode(steps)).withColumn("__dj", F.explode(steps)).select((F.col("i") + F.col("__di")).alias("i"), (F.col("j") + F.col("__dj")).alias("j"), *rest)
    return grid.select("i", "j").join(sent, ["i", "j"]).groupBy("i", "j").agg(*[v.alias(k) for k, v in aggregates.items()])


def checked_canopy(grid: DataFrame, replacement: float = 10.0, low: float = 2.0, high: float = 35.0, leak: float = 5.0, margin: float = 12.0, least: int = 4, lonely: float = 20.0) -> DataFrame:
    """(i, j, top): tree heights (tree, top, bh) after quality checks: too low ones are replaced, too high ones cut; then
    those like a roof beside them, those far above the median of enough neighbours, and high lonely ones beside buildings
    are replaced."""
    t = F.when(F.col("tree"), F.when(F.col("top") < low, replacement).when(F.col("top") > high, high).otherwise(F.col("top"))).otherwise(F.col("top"))
    g = grid.select("i", "j", "tree", "bh", t.alias("top"))
    valid = F.col("tree") & F.col("top").isNotNull()
    near = around(g.withColumn("own", F.when(valid, F.col("top"))), 1, {"roof": F.max("bh"), "n": F.count("own"), "mid": F.percentile("own", F.lit(0.5))})
    j = g.join(near, ["i", "j"])
    roof = F.greatest(F.coalesce("roof", F.lit(0.0)), F.lit(0.0))
    odd = (roof > 0) & (F.abs(F.col("top") - roof) <= leak) | (F.col("n") >= least) & (F.col("top") > F.col("mid") + margin) | (roof > 0) & (F.col("n") <= 2) & (F.col("top") >= lonely)
    return j.select("i", "j", F.when(valid & odd, replacement).otherwise(F.col("top")).alias("top"))


def mean_under(footprints: DataFrame, pixels: DataFrame) -> DataFrame:
    """Footprints (id, i0, j0, i1, j1, height) whose height is missing or not above 0 take the mean of the pixels (i, j, v)
    they cover; null where there is none."""
    from citylattice.operators.raster import covered

    need = footprints.where("height is null or height <= 0").select("id", "i0", "j0", "i1", "j1")
    mean = covered(need).join(pixels.where("v is not null"), ["i", "j"]).groupBy("id").agg(F.avg("v").alias("__mean"))
    return footprints.join(mean, "id", "left").withColumn("height", F.when(F.col("height") > 0, F.col("height")).otherwise(F.col("__mean"))).drop("__mean")
