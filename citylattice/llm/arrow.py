"""One shape for all Arrow passes: input columns stay, new columns are appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from citylattice.session import prepare

#: Rows and bytes of one Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def session(spark: SparkSession) -> SparkSession:
    """Workers find the package, and Arrow batches are small enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return prepare(spark)


def annotate(df: DataFrame, columns: Iterable[str], make: Callable, fields: T.StructType, drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with the columns of ``fields``, computed from ``columns``.

    ``make()`` is called once in each task and returns a function from the arrays of ``columns`` to the new arrays.
    A column of ``df`` that has the name of a new one is replaced; those in ``drop`` don't come back from Python.
    """
    session(df.sparkSession)
    columns, gone = list(columns), {f.name for f in fields} | set(drop)
    kept = [f.name for f in df.schema if f.name not in gone]
    source = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, *columns])])
    schema = T.StructType([f for f in df.schema if f.name in kept] + list(fields))
    arrow = to_arrow_schema(T.StructType(list(fields)))

    def run(batches):
        compute = make()
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            new = [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, type=f.type) for x, f in zip(compute(*[batch.column(at[c]) for c in columns]), arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(at[c]) for c in kept] + new, names=kept + arrow.names)

    return source.mapInArrow(run, schema)
