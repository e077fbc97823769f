"""City tables from the driver's tables: the same integer rules in Spark and, as ``CITY_SQL``, in standard SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylattice.session import prepare

N = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession) -> DataFrame:
    return spark.range(N * N).select((F.col("id") / N).cast("int").alias("i"), (F.col("id") % N).cast("int").alias("j"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, i0, j0, i1, j1, height, min_height, inner): axis-aligned footprints in cells, ends exclusive."""
    p = F.col("p_partkey")
    i0, j0 = (p * 7 % N).cast("int"), (p * 13 % N).cast("int")
    height = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select((p + 1).alias("id"), i0.alias("i0"), j0.alias("j0"), F.least(i0 + 1 + F.col("p_size") % 3, F.lit(N)).cast("int").alias("i1"), F.least(j0 + 1 + p % 4, F.lit(N)).cast("int").alias("j1"), height.alias("height"), F.when(F.col("p_size") % 7 == 0, 2.0).otherwise(0.0).alias("min_height"), (p % 29 == 0).alias("inner"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    top = (n % 12 + 4).cast("double")
    return table(spark, sf_dir, "supplier").select(s.alias("tree_id"), (s * 11 % N + 0.5).alias("ci"), (s * 5 % N + 0.5).alias("cj"), top.alias("top"), (F.floor(top * 0.4 * 4) / 4).alias("bottom"), (n % 6 + 2).cast("double").alias("crown"))


def paints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, idx): land-cover polygons of one cell."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((o % N).cast("int").alias("i"), (F.col("o_custkey") % N).cast("int").alias("j"), (F.floor(o / N) % 14).cast("int").alias("idx"))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, z) in quarter metres where there are samples."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    key = [(F.col("l_orderkey") % N).cast("int").alias("i"), (F.col("l_partkey") % N).cast("int").alias("j")]
    return l.groupBy(*key).agg((F.floor(F.avg("l_quantity")) / 4).alias("z"))


def suns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, dni, dhi, az, el): one row an hour, with whole-degree sun positions."""
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.coalesce(F.sum(F.when(F.col("event_type").isin("view", "click"), F.floor("value"))), F.lit(0)).cast("double").alias("dni"), F.floor(F.avg(F.floor("value"))).cast("double").alias("dhi"))
    h, d = F.hour("ts"), F.dayofyear("ts")
    return e.select("ts", "dni", "dhi", ((h * 15 + d) % 360).cast("double").alias("az"), (60 - F.abs(h - 12) * 10 + d % 5).cast("double").alias("el"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone_id, ring): diamonds for odd nations, rectangles for even ones."""
    k = F.col("n_nationkey")
    x, y, r = (k * 17 % N + 0.25).cast("double"), (k * 29 % N).cast("double"), (k % 5 + 3).cast("double")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    diamond = F.array(at(x - r, y), at(x, y + r), at(x + r, y), at(x, y - r))
    square = F.array(at(x - r, y - r), at(x - r, y + r), at(x + r, y + r), at(x + r, y - r))
    return table(spark, sf_dir, "nation").select(k.alias("zone_id"), F.when(k % 2 == 1, diamond).otherwise(square).alias("ring"))


#: The adapters in SQL, as the first part of a WITH clause.
CITY_SQL = """
cells AS (SELECT (x // 48)::INT AS i, (x % 48)::INT AS j FROM range(2304) t(x)),
buildings AS (SELECT p_partkey + 1 AS id, (p_partkey * 7 % 48)::INT AS i0, (p_partkey * 13 % 48)::INT AS j0,
    least(p_partkey * 7 % 48 + 1 + p_size % 3, 48)::INT AS i1, least(p_partkey * 13 % 48 + 1 + p_partkey % 4, 48)::INT AS j1,
    CASE WHEN p_size % 10 <> 0 THEN p_size::DOUBLE END AS height, CASE WHEN p_size % 7 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS min_height, p_partkey % 29 = 0 AS inner_ FROM part),
trees AS (SELECT s_suppkey AS tree_id, (s_suppkey * 11 % 48 + 0.5)::DOUBLE AS ci, (s_suppkey * 5 % 48 + 0.5)::DOUBLE AS cj, (s_nationkey % 12 + 4)::DOUBLE AS top,
    (floor((s_nationkey % 12 + 4)::DOUBLE * 0.4::DOUBLE * 4) / 4)::DOUBLE AS bottom, (s_nationkey % 6 + 2)::DOUBLE AS crown FROM supplier),
paints AS (SELECT (o_orderkey % 48)::INT AS i, (o_custkey % 48)::INT AS j, ((o_orderkey // 48) % 14)::INT AS idx FROM orders),
dem AS (SELECT (l_orderkey % 48)::INT AS i, (l_partkey % 48)::INT AS j, (floor(avg(l_quantity)) / 4)::DOUBLE AS z FROM lineitem GROUP BY 1, 2),
suns AS (SELECT ts, dni, dhi, ((hour(ts) * 15 + dayofyear(ts)) % 360)::DOUBLE AS az, (60 - abs(hour(ts) - 12) * 10 + dayofyear(ts) % 5)::DOUBLE AS el FROM (
    SELECT date_trunc('hour', ts) AS ts, coalesce(sum(CASE WHEN event_type IN ('view', 'click') THEN floor(value) END), 0)::DOUBLE AS dni, floor(avg(floor(value)))::DOUBLE AS dhi FROM events GROUP BY 1)),
zones AS (SELECT n_nationkey AS zone_id, (n_nationkey * 17 % 48 + 0.25)::DOUBLE AS zx, (n_nationkey * 29 % 48)::DOUBLE AS zy, (n_nationkey % 5 + 3)::DOUBLE AS zr, n_nationkey % 2 = 1 AS diamond FROM nation),
priority AS (SELECT * FROM (VALUES (0, 7), (1, 9), (2, 10), (3, 5), (4, 11), (5, 12), (6, 4), (7, 15), (8, 3), (9, 8), (10, 13), (11, 1), (12, 2), (13, 14)) p(idx, pr))
"""
