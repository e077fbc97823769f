"""Session helpers shared by every operator: importable workers and lineage cuts in a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or the context's checkpoint folder names. Without one, a master on this machine
    alone (local tests) gets a folder of its own; a cluster has no other choice, as its machines could not read each
    other's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="citylattice-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _hadoop(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the plan restarts from files that all
    executors see. The table goes with ``forget``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _hadoop(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has returned and that no plan will read any more."""
    for df in tables:
        if path := _tables.pop(df, None):
            files, place = _hadoop(df.sparkSession, path)
            files.delete(place, True)


#: Rows that a side of a join without a key may have to be sent to every executor.
BROADCAST_ROWS = 20_000


def parts(df: DataFrame, rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """``df`` in slices of about ``rows`` rows at most, by a hash of the whole row: what has to go to every executor goes
    in slices of a checked size, one after another, and the caller merges the results."""
    from pyspark.sql import functions as F

    n = -(-df.count() // rows)
    if n <= 1:
        return [df]
    # twice as many slices as needed leave room for uneven hashes
    at = F.pmod(F.xxhash64(*df.columns), F.lit(2 * n))
    return [df.where(at == i) for i in range(2 * n)]


#: Rows that one task has to open into many, or to put through a costly step.
TASK_ROWS = 40_000


def spread(df: DataFrame, *columns: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by a hash of columns into tasks of about ``rows`` rows: a small file is one task, however much its rows
    become."""
    return df.repartition(max(1, -(-df.count() // rows)), *columns)
