"""Selections of buildings, cells and faces by shapes, masks and roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylattice.functions import geometry as G
from citylattice.functions.exprs import inside_ring
from citylattice.session import parts


def containing(buildings: DataFrame, x: float, y: float, ring: str = "ring") -> DataFrame:
    """Buildings whose ring holds a point."""
    return buildings.where(inside_ring(F.lit(x), F.lit(y), F.col(ring)))


def _crossing(a: Column, b: Column) -> Column:
    """Whether an edge of one ring crosses an edge of the other."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    edges = lambda r: F.transform(r, lambda p, i: F.struct(p.alias("p"), F.get(r, (i + 1) % F.size(r)).alias("q")))
    meet = lambda e, f: ((turn(e["p"], e["q"], f["p"]) > 0) != (turn(e["p"], e["q"], f["q"]) > 0)) & ((turn(f["p"], f["q"], e["p"]) > 0) != (turn(f["p"], f["q"], e["q"]) > 0))
    return F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: meet(e, f)))


def drawn(buildings: DataFrame, shapes: DataFrame, operation: str = "within", ring: str = "ring") -> DataFrame:
    """Distinct ids of buildings that lie within any of the shapes (ring), or meet one (``intersect``). Different rings are
    compared once, with shapes that go out in slices of a checked size; bounds are made once and compared before edges."""
    if operation not in ("within", "intersect"):
        raise ValueError(f"unknown operation {operation}")
    rings = buildings.select(F.col(ring).alias("__ring")).distinct().withColumn("__own", G.bounds(F.col("__ring")))
    own, shape = F.col("__ring"), F.col("__shape")
    inner = lambda a, b: F.transform(a, lambda p: inside_ring(p["x"], p["y"], b))
    if operation == "within":
        fits = F.forall(inner(own, shape), lambda v: v) & ~_crossing(own, shape)
    else:
        fits = F.exists(inner(own, shape), lambda v: v) | F.exists(inner(shape, own), lambda v: v) | _crossing(own, shape)
    found = []
    for part in parts(shapes.select(F.col(ring).alias("__shape")).distinct()):
        # a case, as the optimizer puts a filter on a join before the join's own condition
        meet = F.when(G.boxes_meet(F.col("__own"), F.col("__bounds")), fits).otherwise(False)
        found.append(rings.join(F.broadcast(part.withColumn("__bounds", G.bounds(shape))), meet).select("__ring"))
    chosen = reduce(DataFrame.union, found).distinct()
    return buildings.join(chosen, buildings[ring] == chosen["__ring"], "left_semi").select("id").distinct()


# --- masks of cells ---------------------------------------------------------------------------------------------------


def middle(shape: tuple[int, int], share: float) -> Column:
    """Whether a cell lies in the middle share of both axes; at least one cell does."""
    if not 0 < share <= 1:
        raise ValueError("the share must be above 0 and at most 1")
    out = F.lit(True)
    for c, n in zip(("i", "j"), shape):
        margin = int(n * (1 - share) / 2)
        low, high = (margin, n - margin) if n - margin > margin else (n // 2, n // 2 + 1)
        out = out & (F.col(c) >= low) & (F.col(c) < high)
    return out


def in_ranges(i: tuple[int, int] | None = None, j: tuple[int, int] | None = None) -> Column:
    """Whether a cell lies in index ranges, ends included; no range is the whole axis."""
    out = F.lit(True)
    for c, r in (("i", i), ("j", j)):
        out = out if r is None else out & F.col(c).between(*r)
    return out


def in_buffer(box: tuple[float, float, float, float], centre: tuple[float, float], metres: float, mesh: float) -> Column:
    """Whether a cell lies within metres of a place, in a grid from a box's south-west corner, by degrees of fixed length."""
    import math

    east, north = 111320 * math.cos(math.radians((box[1] + box[3]) / 2)), 110540
    a, b = (centre[0] - box[0]) * east / mesh, (centre[1] - box[1]) * north / mesh
    return F.sqrt(F.pow(F.col("i") - a, 2) + F.pow(F.col("j") - b, 2)) <= metres / mesh


def mask_info(cells: DataFrame, mask: str = "mask") -> DataFrame:
    """(cells, chosen, share, i0, i1, j0, j1) of a mask."""
    here = lambda c: F.when(F.col(mask), F.col(c))
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(mask).alias("chosen"), (F.count_if(mask) / F.count(F.lit(1))).alias("share"), F.min(here("i")).alias("i0"), F.max(here("i")).alias("i1"), F.min(here("j")).alias("j0"), F.max(here("j")).alias("j1"))


def from_list(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """``cells`` with mask: whether a list (i, j) names the cell; places outside the grid name none."""
    return cells.join(chosen.select("i", "j", F.lit(True).alias("mask")).distinct(), ["i", "j"], "left").withColumn("mask", F.coalesce("mask", F.lit(False)))


# --- faces ------------------------------------------------------------------------------------------------------------


def at_border(x: Column, y: Column, nz: Column, box: tuple[float, float, float, float], near: float) -> Column:
    """Whether an upright face stands on the border of the model."""
    sides = [F.abs(v - b) < near for v, b in ((x, box[0]), (y, box[1]), (x, box[2]), (y, box[3]))]
    return (F.abs(nz) < 0.01) & reduce(Column.__or__, sides)


def masked_faces(faces: DataFrame, mask: DataFrame, mesh: float, shape: tuple[int, int], value: str = "value") -> DataFrame:
    """Faces (x, y, value) with null values where the cell (i, j) under their centre is not in the mask; centres beyond the
    grid take its nearest cell."""
    at = lambda v, n: F.least(F.greatest((v / mesh).cast("int"), F.lit(0)), F.lit(n - 1))
    placed = faces.withColumns({"i": at(F.col("y"), shape[0]), "j": at(F.col("x"), shape[1])})
    return placed.join(mask.select("i", "j", "mask"), ["i", "j"], "left").withColumn(value, F.when(F.coalesce("mask", F.lit(False)), F.col(value))).drop("mask")


def selected_faces(faces: DataFrame, selectors: DataFrame) -> DataFrame:
    """Faces that a selector (building, kind, side) fits and no selector with ``exclude`` does; nulls fit anything. Selectors
    are a few rows of a request."""
    fits = lambda s: (F.coalesce(s["building"] == F.col("building"), s["building"].isNull())) & (F.coalesce(s["kind"] == F.col("kind"), s["kind"].isNull())) & (F.coalesce(s["side"] == F.col("side"), s["side"].isNull()))
    rows = F.collect_list(F.struct("building", "kind", "side", "exclude"))
    all_ = F.broadcast(selectors.agg(rows.alias("__s")))
    chosen = F.exists("__s", lambda s: ~s["exclude"] & fits(s)) & ~F.exists("__s", lambda s: s["exclude"] & fits(s))
    return faces.crossJoin(all_).where(chosen).drop("__s")


def weighted_stats(members: DataFrame, key: str = "zone_id", value: str = "value", weight: str = "area") -> DataFrame:
    """(key, cell_count, valid_count, mean, min, max, std): of faces by their area; the mean and the deviation are weighted."""
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(weight))
    s = members.groupBy(key).agg(F.count(F.lit(1)).alias("cell_count"), F.count(v).alias("valid_count"), (F.sum(v * w) / F.sum(w)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * v * w) / F.sum(w)).alias("sq"))
    return s.withColumn("std", F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("sq")


def merged_segments(segments: DataFrame, near: float = 1e-6) -> DataFrame:
    """(axis, a, b, start, end): axis-parallel segments of one line, joined where they touch or overlap: islands of a line by
    the largest end before each. Equal segments have one number, whatever their order; those without ends, which stand first,
    touch nothing and stay rows of their own."""
    from pyspark.sql import Window

    line = Window.partitionBy("axis", "a", "b").orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = segments.select("axis", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end")).withColumn("new", F.when(F.col("start") <= before + near, 0).otherwise(1))
    island = opened.withColumn("island", F.when(F.col("start").isNull(), F.row_number().over(line)).otherwise(F.sum("new").over(line)))
    return island.groupBy("axis", "a", "b", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


# What names a window.
WINDOW_WORDS = ("window", "glass", "glazing")


def role(name: Column, material: Column, explicit: dict[str, str] | None = None, words: tuple = WINDOW_WORDS) -> Column:
    """An explicit role, else window if the name or the material holds a window's word, else building."""
    out = reduce(Column.__or__, [F.coalesce(F.lower(c).contains(w.lower()), F.lit(False)) for c in (name, material) for w in words])
    found = F.when(out, F.lit("window")).otherwise(F.lit("building"))
    for k, v in (explicit or {}).items():
        found = F.when(name == k, F.lit(v)).otherwise(found)
    return found


def hour_window(start: Column, end: Column, year: int) -> tuple[Column, Column]:
    """Hours of the year, from 1, of two times `MM-DD hh:mm:ss`."""
    at = lambda t: F.try_to_timestamp(F.concat(F.lit(f"{year}-"), t), F.lit("yyyy-MM-dd HH:mm:ss"))
    hour = lambda t: (F.dayofyear(at(t)) - 1) * 24 + F.hour(at(t)) + 1
    return hour(start), hour(end)
