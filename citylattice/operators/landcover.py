"""Land-cover codes: maps between systems, nearest colours and majorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylattice.functions import dims


def to_standard(rows: DataFrame, maps: DataFrame, source: str = "source", idx: str = "idx") -> DataFrame:
    """``rows`` with code: the standard class of a source's index. Negative indices are No Data, Standard passes through,
    sources without a map count from one, an index beyond its map stays."""
    m = F.broadcast(maps.select(F.col("source").alias("__s"), F.col("idx").alias("__i"), F.col("code").alias("__c")))
    known = list(dims.TO_STANDARD)
    joined = rows.join(m, (F.col(source) == F.col("__s")) & (F.col(idx) == F.col("__i")), "left")
    code = F.when(F.col(source) == "Standard", F.col(idx)).when(F.col(source).isin(known), F.when(F.col(idx) < 0, 14).otherwise(F.coalesce("__c", F.col(idx)))).otherwise(F.col(idx) + 1)
    return joined.withColumn("code", code.cast("int")).drop("__s", "__i", "__c")


def nearest_class(r: Column, g: Column, b: Column) -> Column:
    """Index of the palette's nearest colour, the first of equally near ones."""
    far = [F.struct((F.pow(r - x, 2) + F.pow(g - y, 2) + F.pow(b - z, 2)).alias("d"), F.lit(i).alias("i")) for i, (x, y, z, _) in enumerate(dims.PALETTE)]
    return F.least(*far)["i"]


def majority(pixels: DataFrame, keys: list[str], value: str = "idx", order: str = "pos") -> DataFrame:
    """Most frequent value for each key, ties to the value that was seen first."""
    counts = pixels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("seen"))).alias(value))
