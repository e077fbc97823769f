"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylattice.session import cut, forget

#: Rounds are logarithmic in the size of a component; this bound only stops a fault.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v): neighbours are linked with the least of a node's neighbourhood."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); root is the least node of its component. Loops and repeated
    edges do no harm; no edges give no rows."""
    now, before = cut(edges.select("u", "v").where("u <> v").distinct()), None
    for _ in range(MOST_ROUNDS):
        last, now = now, cut(_star(_star(now, True), False))
        forget(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
    raise RuntimeError("the stars did not settle")
