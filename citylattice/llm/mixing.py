"""Mixing sources to target weights by nested hash thresholds, without a sort.

Every document gets a 60-bit hash of its id and text. A source whose target is r times its size takes each document
floor(r) times, and the documents below a hash threshold once more; the threshold is found from histograms of words by
source and hash bucket: the bucket in which the remaining budget ends is the only one that is split in the next level,
until one hash value is left. Documents that share this value (copies under one id) split what is left evenly by
size, in whole words. Thresholds for a smaller budget lie below those for a larger one, so that mixes are nested.

Sources are ordered by code point with null last and weigh ``WEIGHTS`` in turn. They share ``TOTAL`` times all words by
weight; no target is above ``CAP`` times its source's words, and what is over goes to the others by weight.

A level's histogram has at most ``2 ** BITS`` rows for each source. Null and empty texts have size 0 and take 0; equal
rows take the same; an empty table gives no rows; columns of the input that have the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citylattice.session import cut

WEIGHTS = (5, 2, 1)
TOTAL, CAP = 1.5, 2.0
LEVELS, BITS = 5, 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5, as SQL engines agree on it."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """Target of each row of (source, source_size): min(cap * size, level * weight), with the level at which the
    targets sum to ``total`` times all sizes. One row per source: small beside the documents."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") * 1.0 / F.col("weight"), F.col("source").asc_nulls_last())
    ahead, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("source_size").over(ahead), F.lit(0)) * F.lit(cap)
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(total) - capped) / F.sum("weight").over(rest)
    # the right level is the first that doesn't cap the source with which its uncapped group begins
    fits = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(cap))
    found = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(Window.partitionBy())
    target = F.least(F.col("source_size") * F.lit(cap), F.coalesce(found["level"] * F.col("weight"), F.col("source_size") * F.lit(cap)))
    return fits.select("source", "source_size", target.alias("target"))


def _thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, edge, left, tied): documents hashed below edge are taken once more; those at edge share ``left`` of
    ``tied`` words. The budget is what a target has beyond whole copies of its source."""
    at = wanted.where("source_size > 0").select("source", F.lit(0).cast("long").alias("base"), F.greatest(F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size"), F.lit(0.0)).alias("left"))
    for step in range(1, LEVELS + 1):
        width = 60 - step * BITS
        outer = 60 - (step - 1) * BITS
        inside = sized.join(at, (sized["source"].eqNullSafe(at["source"])) & (F.shiftright("hash", outer) == F.shiftright("base", outer)) if outer < 60 else sized["source"].eqNullSafe(at["source"])).select(at["source"], "base", "left", "size", F.shiftright("hash", width).alias("bucket"))
        counts = inside.groupBy("source", "base", "left", "bucket").agg(F.sum("size").alias("here"))
        order = Window.partitionBy("source").orderBy("bucket")
        running = counts.withColumn("below", F.sum("here").over(order) - F.col("here"))
        # the bucket in which the budget ends: the last that starts at or below it
        last = running.where("below <= left").groupBy("source").agg(F.max_by(F.struct("bucket", "below", "left", "here"), "bucket").alias("b"))
        at = cut(last.select("source", F.shiftleft("b.bucket", width).alias("base"), (F.col("b.left") - F.col("b.below")).alias("left"), F.col("b.here").alias("tied")))
        if step < LEVELS:
            at = at.drop("tied")
    return at.withColumnRenamed("base", "edge")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, source_size, target and taken, the words that the mix takes."""
    own = ["size", "source_size", "target", "taken"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    helpers = [F.col(source).alias("__s"), words(F.col(text)).alias("__size"), hashed(F.col(doc_id), F.col(text)).alias("__hash")]
    rows = docs.select(*kept, *helpers)
    # narrow rows are kept with their sizes; with texts among them only the sizes are
    light = cut(rows if text not in kept else docs.select(*helpers))
    rows = light if text not in kept else rows
    sized = light.select(F.col("__s").alias("source"), F.col("__size").alias("size"), F.col("__hash").alias("hash"))
    wanted = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, cap))
    edges = _thresholds(sized, wanted)
    plan = cut(wanted.join(edges, wanted["source"].eqNullSafe(edges["source"]), "left").select(wanted["source"].alias("__source"), "source_size", "target", "edge", "left", "tied"))
    plan = plan.select(*[F.col(c).alias(c if c.startswith("__") else f"__{c}") for c in plan.columns])
    joined = rows.join(plan, F.col("__s").eqNullSafe(F.col("__source")))
    size, whole, target, edge = F.col("__size"), F.col("__source_size"), F.col("__target"), F.col("__edge")
    copies = F.when(whole > 0, F.floor(target / whole)).otherwise(F.lit(0))
    shared = F.when(F.col("__tied") > 0, F.least(size, F.floor(size * F.col("__left") / F.col("__tied")))).otherwise(F.lit(0))
    more = F.when(F.col("__hash") < edge, size).when(F.col("__hash") == edge, shared).otherwise(F.lit(0))
    taken = (copies * size + F.coalesce(more, F.lit(0))).cast("long")
    return joined.select(*kept, size.alias("size"), whole.alias("source_size"), target.alias("target"), taken.alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken."""
    return mix(docs, keep=["doc_id"])


#: The same mix in SQL: the threshold is read off a running sum over each source by hash.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, source_size::DOUBLE / weight AS ratio,
        (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM w),
t AS (SELECT source, source_size,
        least(2.0::DOUBLE * source_size, coalesce((SELECT lev FROM l WHERE lev * weight <= 2.0::DOUBLE * source_size ORDER BY ratio, lev LIMIT 1) * weight, 2.0::DOUBLE * source_size))::DOUBLE AS target
      FROM l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
b AS (SELECT *, greatest(target - copies * source_size, 0.0) AS budget FROM k),
v AS (SELECT d.*, b.source_size, b.target, b.copies, b.budget,
        sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(size) OVER (PARTITION BY d.source, h) AS tied
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (copies * size + CASE WHEN upto <= budget THEN size
                             WHEN upto - tied <= budget THEN floor(size * (budget - (upto - tied)) / tied)
                             ELSE 0 END)::BIGINT AS taken
FROM v
"""
