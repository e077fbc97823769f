"""Batch edits of the cell relation: joins of edit tables, with the last edit of a cell winning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _last(edits: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in edits.columns if c not in (*keys, "ord")]
    return edits.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("e")).select(*keys, *[F.col(f"e.{c}").alias(f"new_{c}") for c in rest])


def add_buildings(cell: DataFrame, edits: DataFrame) -> DataFrame:
    """cell (i, j, bh, bid) with edits (i, j, bid, bh, ord)."""
    joined = cell.join(_last(edits, ["i", "j"]), ["i", "j"], "left")
    return joined.withColumns({"bh": F.coalesce("new_bh", "bh"), "bid": F.coalesce("new_bid", "bid")}).drop("new_bh", "new_bid")


def set_heights(cell: DataFrame, edits: DataFrame) -> DataFrame:
    """Heights by building id, edits (bid, bh, ord)."""
    joined = cell.join(_last(edits, ["bid"]), "bid", "left")
    return joined.withColumn("bh", F.when(F.col("bid") != 0, F.coalesce("new_bh", "bh")).otherwise(F.col("bh"))).drop("new_bh")


def delete_buildings(cell: DataFrame, ids: DataFrame) -> DataFrame:
    """Height and id of the cells of these buildings become 0."""
    joined = cell.join(ids.select("bid", F.lit(True).alias("gone")).distinct(), "bid", "left")
    return joined.withColumns({"bh": F.when(F.col("gone"), 0.0).otherwise(F.col("bh")), "bid": F.when(F.col("gone"), 0).otherwise(F.col("bid"))}).drop("gone")


def updated_segments(segs: str, previous: str, height: str, low: str):
    """The segment whose top is the previous height gets a new top; without one there is a single new segment."""
    fits = F.exists(segs, lambda s: F.abs(s["hi"] - F.col(previous)) < 1e-9)
    swapped = F.transform(segs, lambda s: F.struct(s["lo"].alias("lo"), F.when(F.abs(s["hi"] - F.col(previous)) < 1e-9, F.col(height)).otherwise(s["hi"]).alias("hi")))
    return F.when(fits, swapped).otherwise(F.array(F.struct(F.col(low).alias("lo"), F.col(height).alias("hi"))))


def clear_border(cell: DataFrame, shape: tuple[int, int], width: int, developed: int = 11) -> DataFrame:
    """Buildings that touch the border band lose their height everywhere; in the band canopy is 0 and the class developed.
    Building ids stay."""
    band = (F.col("i") < width) | (F.col("j") < width) | (F.col("i") >= shape[0] - width) | (F.col("j") >= shape[1] - width)
    gone = cell.where(band & (F.col("bid") != 0)).select("bid", F.lit(True).alias("gone")).distinct()
    joined = cell.join(gone, "bid", "left")
    return joined.withColumns({"bh": F.when(F.col("gone"), 0.0).otherwise(F.col("bh")), "top": F.when(band, 0.0).otherwise(F.col("top")), "code": F.when(band, developed).otherwise(F.col("code"))}).drop("gone")


def finite_pairs(segs: str):
    """Segments whose ends are numbers."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.filter(F.coalesce(F.col(segs), F.array().cast("array<struct<lo:double,hi:double>>")), lambda s: number(s["lo"]) & number(s["hi"]))


def set_trees(cell: DataFrame, edits: DataFrame) -> DataFrame:
    """Canopy tops and bottoms of cells by edits (i, j, top, bottom, ord); 0 and 0 take trees away. Edits outside the grid
    change nothing, and of several of one cell the last one holds."""
    joined = cell.join(_last(edits, ["i", "j"]), ["i", "j"], "left")
    return joined.withColumns({"top": F.coalesce("new_top", "top"), "bottom": F.coalesce("new_bottom", "bottom")}).drop("new_top", "new_bottom")


def paint_classes(cell: DataFrame, edits: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Classes of cells by edits (i, j, code, ord) with standard classes from 1; ``names`` are the classes of the cells' own
    source from 0. A class that the source lacks keeps its number."""
    from citylattice.functions import dims

    code = F.col("new_code")
    for n, name in enumerate(dims.STANDARD, 1):
        if names and name in names:
            code = F.when(F.col("new_code") == n, F.lit(names.index(name))).otherwise(code)
    joined = cell.join(_last(edits, ["i", "j"]), ["i", "j"], "left")
    return joined.withColumn("code", F.coalesce(code, F.col("code")).cast("int")).drop("new_code")
