"""Merged segments where ends are missing, odd or equal."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from citylattice.operators import selection
from citylattice.plans import catalogue, further  # noqa: F401  (the second adds to the first)


def test_segments_without_ends_stay_as_in_sql(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 11, None, 0.1), (1, 11, None, 0.1), (1, 21, None, 0.05), (1, 1, 3.0, 0.1), (1, 1, 3.5, 0.02), (1, 1, 9.0, 0.1), (1, 1, inf, 0.1), (1, 1, nan, 0.1), (1, 1, -inf, 0.1), (2, None, None, 0.1), (2, None, 4.0, 0.1), (None, -7, None, 0.1), (None, -7, -2.0, 0.1), (3, 5, None, 0.0), (3, 5, 1.0, None)]
    spark.createDataFrame(rows, "l_linenumber int, l_suppkey long, l_quantity double, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    duck.execute("set threads = 1")
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    shaped = lambda found: Counter(tuple(None if v is None else str(float(v)) for v in r) for r in found)
    got = shaped(catalogue.QUERIES["merged_edges"](spark, str(tmp_path)).collect())
    assert got == shaped(duck.execute(catalogue.ORACLES["merged_edges"]).fetchall())
    assert sum(n for r, n in got.items() if r[3] is None) == 5


def test_equal_segments_are_one_island_in_any_order(spark):
    k = F.col("id")
    s = spark.range(3000).select(F.lit(0).alias("axis"), (k % 3 + 0.0).alias("a"), F.lit(0.0).alias("b"), (k % 2 * 10.0).alias("start"), (k % 2 * 10.0 + 1).alias("end"))
    for order in (k, -k, F.hash(k)):
        got = selection.merged_segments(s.withColumn("id", F.monotonically_increasing_id()).repartition(5).sortWithinPartitions(order).drop("id"))
        assert sorted(map(tuple, got.collect())) == [(0, a, 0.0, x, x + 1) for a in (0.0, 1.0, 2.0) for x in (0.0, 10.0)]
