"""Voxelisation, columns, faces, neighbourhoods and edits of the voxel relation (i, j, k, code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylattice.functions import dims
from citylattice.functions.exprs import half_up

OPEN = (dims.AIR, dims.TREE)


def voxelise(cell: DataFrame, mesh: float = 1.0) -> DataFrame:
    """Voxels of cells (i, j, bh, segs, code, z, top, bottom): ground up to the terrain with the land cover on top, then
    crowns, then buildings over all. The number of layers holds the highest sum of building, terrain and tree."""
    height = F.coalesce("bh", F.lit(10.0)) + F.col("z") + F.col("top")
    nz = cell.agg((F.ceil(F.max(height) / mesh) + 1).cast("int").alias("nz"))
    level = half_up(F.col("z") / mesh) + 1
    low, high = half_up(F.col("bottom") / mesh), half_up(F.col("top") / mesh)
    base = F.when((low == high) & (low > 0), low - 1).otherwise(low)
    tall = F.transform("segs", lambda s: F.struct(half_up(F.coalesce(s["lo"], F.lit(10.0)) / mesh).alias("lo"), half_up(F.coalesce(s["hi"], F.lit(10.0)) / mesh).alias("hi")))
    column = cell.select("i", "j", "code", level.alias("level"), base.alias("base"), high.alias("crown"), (F.col("top") > 0).alias("tree"), tall.alias("segs"))
    spread = column.join(F.broadcast(nz)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)))
    k, g = F.col("k"), F.col("level")
    code = (
        F.when(F.exists("segs", lambda s: (k >= g + s["lo"]) & (k < g + s["hi"])), dims.BUILDING)
        .when(F.col("tree") & (k >= g + F.col("base")) & (k < g + F.col("crown")), dims.TREE)
        .when(k == g - 1, F.col("code"))
        .when(k < g - 1, dims.GROUND)
        .otherwise(dims.AIR)
    )
    return spread.select("i", "j", "k", code.cast("int").alias("code"))


def packed(voxels: DataFrame) -> DataFrame:
    """(i, j, codes): one array for each column, from the bottom up."""
    return voxels.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda x: x["code"]).alias("codes"))


def observers(columns: DataFrame, roofs: bool = False) -> DataFrame:
    """(i, j, k): standing height of each packed column. From below: the first open voxel on something, null on water and
    on negative codes. With roofs: the topmost one on ground, land or building."""
    codes = F.col("codes")
    ks = F.sequence(F.lit(1), F.size(codes) - 1)
    step = lambda k: F.get(codes, k).isin(*OPEN) & ~F.get(codes, k - 1).isin(*OPEN)
    below = lambda k: F.get(codes, k - 1)
    if roofs:
        good = lambda k: step(k) & ~below(k).isin(7, 8, 9) & ~((below(k) < 0) & (below(k) != dims.BUILDING))
        k = F.array_max(F.filter(ks, good))
    else:
        first = F.array_min(F.filter(ks, step))
        k = F.when(first.isNotNull() & ~F.get(codes, first - 1).isin(7, 8, 9) & (F.get(codes, first - 1) >= 0), first)
    return columns.where(F.size("codes") > 1).select("i", "j", k.cast("int").alias("k"))


DIRECTIONS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def faces(voxels: DataFrame, codes: tuple = (dims.BUILDING,), open_codes: tuple | None = OPEN) -> DataFrame:
    """(i, j, k, di, dj, dk): faces of voxels of a class towards the edge of the model, towards open voxels or, without
    ``open_codes``, towards any voxel of another class. Columns are packed first, so that a neighbour is a look-up in the
    same or the next column and only columns are joined."""
    columns = packed(voxels)
    mine = columns.select("i", "j", F.posexplode("codes").alias("k", "code"), F.col("codes").alias("own")).where(F.col("code").isin(*codes))
    steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for a, b, c in DIRECTIONS])
    asked = mine.withColumn("d", F.explode(steps)).select("i", "j", "k", "d.*", "own")
    side = columns.select(F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("codes").alias("beside"))
    joined = asked.join(side, (F.col("i") + F.col("di") == F.col("__i")) & (F.col("j") + F.col("dj") == F.col("__j")), "left")
    other = F.get(F.col("beside"), F.col("k") + F.col("dk"))
    free = F.col("beside").isNull() | other.isNull() | (F.col("k") + F.col("dk") < 0)
    shown = free | (other.isin(*open_codes) if open_codes is not None else ~other.isin(*codes))
    return joined.where(shown).select("i", "j", "k", "di", "dj", "dk")


def spans(voxels: DataFrame, code: int = dims.BUILDING) -> DataFrame:
    """(i, j, k0, k1): contiguous runs of a code in each column, ends exclusive."""
    by = Window.partitionBy("i", "j").orderBy("k")
    runs = voxels.where(F.col("code") == code).withColumn("run", F.col("k") - F.row_number().over(by))
    return runs.groupBy("i", "j", "run").agg(F.min("k").alias("k0"), (F.max("k") + 1).alias("k1")).drop("run")


def windows(voxels: DataFrame, modulo: tuple[int, int, int] = (2, 2, 2), material: int = dims.MATERIALS["concrete"], glass: int = dims.MATERIALS["glass"]) -> DataFrame:
    """Building voxels become a material, and glass on the modulo pattern below the top of their column."""
    x, y, z = modulo
    top = F.max(F.when(F.col("code") == dims.BUILDING, F.col("k"))).over(Window.partitionBy("i", "j"))
    lit = (F.col("i") % x == 0) & (F.col("j") % y == 0) & (F.col("k") % z == 0) & (F.col("k") < F.col("top"))
    return voxels.withColumn("top", top).withColumn("code", F.when(F.col("code") == dims.BUILDING, F.when(lit, glass).otherwise(material)).otherwise(F.col("code"))).drop("top")


def mark(voxels: DataFrame, ids: DataFrame, grid: DataFrame, code: int = dims.LANDMARK) -> DataFrame:
    """Building voxels above cells whose bid is among ``ids`` get a mark."""
    chosen = grid.join(ids.select("bid").distinct(), "bid", "left_semi").select("i", "j", F.lit(True).alias("__m"))
    return voxels.join(chosen, ["i", "j"], "left").withColumn("code", F.when((F.col("code") == dims.BUILDING) & F.col("__m"), code).otherwise(F.col("code"))).drop("__m")


def neighbourhood(grid: DataFrame, radius: int, value: Column, agg) -> DataFrame:
    """(i, j, out): an aggregate over the (2r+1)^2 cells around each cell of the grid."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    sent = grid.select("i", "j", value.alias("v"), F.explode(steps).alias("di")).select("i", "j", "v", "di", F.explode(steps).alias("dj"))
    sent = sent.select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "v")
    return grid.select("i", "j").join(sent, ["i", "j"]).groupBy("i", "j").agg(agg(F.col("v")).alias("out"))


def ground_level(columns: DataFrame, default: int = 0) -> DataFrame:
    """(i, j, k): top of the first contiguous solid part of each packed column."""
    codes = F.col("codes")
    air = F.array_min(F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda k: F.get(codes, k) == 0))
    return columns.select("i", "j", F.coalesce(F.greatest(air - 1, F.lit(default)), F.size(codes) - 1).alias("k"))


def downsample(voxels: DataFrame, stride: int) -> DataFrame:
    """(i, j, k, code): every stride-th column; of each stride of levels the topmost voxel that is not air."""
    kept = voxels.where((F.col("i") % stride == 0) & (F.col("j") % stride == 0))
    new = [(F.floor(F.col(c) / stride)).cast("int").alias(c) for c in ("i", "j", "k")]
    return kept.select(*new, F.col("k").alias("k0"), "code").groupBy("i", "j", "k").agg(F.coalesce(F.max_by(F.when(F.col("code") != 0, F.col("code")), F.when(F.col("code") != 0, F.col("k0"))), F.lit(0)).alias("code"))


def occluded_faces(voxels: DataFrame) -> DataFrame:
    """(code, n): faces of each class whose neighbour is empty, any voxel but air hiding what is behind."""
    columns = packed(voxels)
    mine = columns.select("i", "j", F.posexplode("codes").alias("k", "code"), F.col("codes").alias("own")).where("code <> 0")
    steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for a, b, c in DIRECTIONS])
    side = columns.select(F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("codes").alias("beside"))
    joined = mine.withColumn("d", F.explode(steps)).select("code", "k", "d.*", "i", "j").join(side, (F.col("i") + F.col("di") == F.col("__i")) & (F.col("j") + F.col("dj") == F.col("__j")), "left")
    other = F.coalesce(F.get("beside", F.col("k") + F.col("dk")), F.lit(0))
    return joined.where((F.col("k") + F.col("dk") < 0) | (other == 0)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def follow_terrain(columns: DataFrame, values: DataFrame, offset: int) -> DataFrame:
    """(i, j, value): of values (i, j, k, value), the one ``offset`` levels above the standing height; null where there is
    none or the place is solid."""
    at = observers(columns).select("i", "j", (F.col("k") + offset).alias("k"))
    solid = columns.select("i", "j", "codes")
    joined = at.join(solid, ["i", "j"]).join(values, ["i", "j", "k"], "left")
    free = F.get("codes", F.col("k")).isin(*OPEN)
    return joined.select("i", "j", F.when(free, F.col("value")).alias("value"))


def paired_hits(hits: DataFrame) -> DataFrame:
    """(i, j, k0, k1): filled levels of each column from the heights at which a mesh crosses it: sorted crossings are taken
    in pairs, an odd number as the first and the last."""
    by = Window.partitionBy("i", "j")
    n = hits.withColumn("rn", F.row_number().over(by.orderBy("z"))).withColumn("n", F.count(F.lit(1)).over(by))
    even = n.where("n % 2 = 0").groupBy("i", "j", F.floor((F.col("rn") + 1) / 2).alias("pair")).agg(F.min("z").alias("a"), F.max("z").alias("b"))
    odd = n.where("n % 2 = 1 and n > 1").groupBy("i", "j", F.lit(0).cast("long").alias("pair")).agg(F.min("z").alias("a"), F.max("z").alias("b"))
    spans_ = even.union(odd).select("i", "j", F.floor(F.col("a") + 0.5).cast("int").alias("k0"), F.floor(F.col("b") + 0.5).cast("int").alias("k1"))
    return spans_.where("k0 < k1")


def rectangles(faces_: DataFrame) -> DataFrame:
    """(plane, a0, b0, a1, b1): greedy rectangles over the faces (plane, a, b) of one plane each, row by row: the widest run
    of a row, then down as long as whole rows are free. A plane of a building is a bounded group."""
    import pandas as pd

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out, plane = set(zip(pdf.a.tolist(), pdf.b.tolist())), [], pdf.plane.iloc[0]
        for a, b in sorted(left):
            if (a, b) not in left:
                continue
            b1 = b
            while (a, b1) in left:
                b1 += 1
            a1 = a + 1
            while all((a1, x) in left for x in range(b, b1)):
                a1 += 1
            left -= {(x, y) for x in range(a, a1) for y in range(b, b1)}
            out.append((plane, a, b, a1, b1))
        return pd.DataFrame(out, columns=["plane", "a0", "b0", "a1", "b1"])

    return faces_.groupBy("plane").applyInPandas(merge, "plane string, a0 int, b0 int, a1 int, b1 int")
