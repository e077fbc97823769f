"""Weather as a stream: hourly sums of arriving samples with late ones allowed for a stated time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(samples: DataFrame, late: str = "2 hours") -> DataFrame:
    """(start, dni, n) of samples (ts, value); works on a stream and on a table alike."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    return rows.groupBy(F.window("ts", "1 hour")).agg(F.sum("value").alias("dni"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "dni", "n")
