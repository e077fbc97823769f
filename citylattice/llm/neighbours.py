"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into blocks of at most ``BLOCK`` rows, as int8 codes with a scale, the exact norms of each vector and
of its quantisation error, and the original floats. Query blocks meet candidate blocks of the same dimension as tiles.
For each pair of a tile the int8 product (exact in float32 for dimensions up to 1040, in float64 above) gives an
approximate inner product whose error is at most |e_q||c| + |q^||e_c|. A candidate survives if its upper bound reaches
the query's k-th largest lower bound; survivors are computed again from the original vectors in double precision, summed
in order of dimension, and go to a heap of k for each query. Heaps of different tiles are merged by rank. No pair is
lost: the result is exact.

Vectors that are null, zero, or hold null or non-finite components take no part. Only vectors of equal length are
compared. A row is never its own neighbour; another row with the same id is. Ties go to the smaller id, null ids last.
An empty table gives no rows, a query without candidates none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citylattice.llm.arrow import session
from citylattice.session import cut

BLOCK = 1024
#: Queries of a tile that are bounded at once.
STRIP = 256
#: Queries whose heaps a task holds at most, beside those of one tile.
HELD = 16 * BLOCK
_NULL = np.iinfo(np.int64).max


def _codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms and error norms; norms are rounded up a little so that the bounds hold."""
    wide = vectors.astype(np.float64)
    scale = np.abs(wide).max(axis=1) / 127.0
    codes = np.rint(wide / scale[:, None]).astype(np.int8)
    error = wide - codes * scale[:, None]
    up = 1 + 1e-6
    return codes, scale, np.sqrt((wide**2).sum(1)) * up, np.sqrt((error**2).sum(1)) * up


def _blocks(vec_id: str, vector: str, modulus: int):
    """Packs rows into blocks: candidates (all) and, apart from them, queries."""

    def run(batches):
        open_: dict[tuple, list] = {}
        number = 0

        def shut(key):
            nonlocal number
            number += 1
            rows = open_.pop(key)
            stacked = np.stack([r[2] for r in rows])
            return pa.RecordBatch.from_pydict({"query": pa.array([key[0]]), "dim": pa.array([key[1]], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "ids": pa.array([np.array([r[0] for r in rows], np.int64).tobytes()], pa.binary()), "rows": pa.array([np.array([r[1] for r in rows], np.int64).tobytes()], pa.binary()), "vectors": pa.array([stacked.tobytes()], pa.binary())})

        for batch in batches:
            ids, uid, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i in range(len(ids)):
                if not (x := column[i]).is_valid or x.values.null_count or not len(x.values):
                    continue
                v = np.asarray(x.values.to_numpy(zero_copy_only=False))
                if not np.isfinite(v).all() or not v.any():
                    continue
                row = (_NULL if ids[i] is None else ids[i], uid[i], v)
                for key in [(False, len(v))] + ([(True, len(v))] if ids[i] is not None and ids[i] % modulus == 0 else []):
                    open_.setdefault(key, []).append(row)
                    if len(open_[key]) == BLOCK:
                        yield shut(key)
        for key in list(open_):
            yield shut(key)

    return run


def _unpack(row, dtype):
    ids, uid = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
    return ids, uid, np.frombuffer(row["vectors"], dtype).reshape(row["n"], row["dim"])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in order of dimension in double precision."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return out


def _emptied(heaps: dict) -> pa.RecordBatch:
    flat = [(u, i, -c, s, -w) for (u, i), heap in heaps.items() for s, c, w in heap]
    heaps.clear()
    cols = list(zip(*flat)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, [pa.int64()] * 3 + [pa.float64(), pa.int64()])], names=["q_row", "query_id", "vec_id", "score", "c_row"])


def _tiles(k: int, dtype: str):
    def run(batches):
        heaps: dict[tuple[int, int], list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                if len(heaps) >= HELD:  # what is held stays bounded; the merge takes any number of parts
                    yield _emptied(heaps)
                row = batch.slice(i, 1).to_pylist()[0]
                side = [_unpack({c: row[f"{s}_{c}"] for c in ("ids", "rows", "vectors", "n")} | {"dim": row["dim"]}, dtype) for s in "qc"]
                (q_id, q_uid, q), (c_id, c_uid, c) = side
                q8, q_scale, _, q_error = _codes(q)
                c8, c_scale, c_norm, c_error = _codes(c)
                kind = np.float32 if row["dim"] <= 1040 else np.float64
                q_hat = np.sqrt((q8.astype(np.float64) ** 2).sum(1)) * q_scale * (1 + 1e-6)
                right = c8.T.astype(kind)
                for lo in range(0, len(q), STRIP):
                    hi = min(lo + STRIP, len(q))
                    near = (q8[lo:hi].astype(kind) @ right).astype(np.float64) * q_scale[lo:hi, None] * c_scale
                    slack = q_error[lo:hi, None] * c_norm + q_hat[lo:hi, None] * c_error + 1e-9
                    own = q_uid[lo:hi, None] == c_uid
                    low = np.where(own, -np.inf, near - slack)
                    at_least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(hi - lo, -np.inf)
                    for j in range(lo, hi):  # a heap that is full raises the bar
                        if len(h := heaps.get((int(q_uid[j]), int(q_id[j])), ())) == k:
                            at_least[j - lo] = max(at_least[j - lo], h[0][0])
                    a, b = np.nonzero(~(near + slack < at_least[:, None]) & ~own)  # what overflows stays in
                    for x, y, s in zip((a + lo).tolist(), b.tolist(), _exact(q[a + lo], c[b]).tolist()):
                        heap = heaps.setdefault((int(q_uid[x]), int(q_id[x])), [])
                        entry = (s, -int(c_id[y]), -int(c_uid[y]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        yield _emptied(heaps)

    return run


def nearest(table: DataFrame, k: int = 20, modulus: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row whose id is divisible by
    ``modulus``."""
    spark = session(table.sparkSession)
    dtype = {"float": "float32", "double": "float64"}.get(table.schema[vector].dataType.elementType.typeName(), "float64")
    value = F.col(vector) if dtype == "float32" or table.schema[vector].dataType.elementType.typeName() == "double" else F.col(vector).cast("array<double>")
    given = table.select(F.col(vec_id).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), value.alias("v"))
    blocks = cut(given.mapInArrow(_blocks("id", "v", modulus), "query boolean, dim int, n int, ids binary, rows binary, vectors binary"))
    # candidate blocks are dealt into groups and query blocks go to every group, so that each task has its own tiles
    groups = max(1, min(blocks.where("not query").count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    own = ("n", "ids", "rows", "vectors")
    q = blocks.where("query").select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), *[F.col(c).alias(f"q_{c}") for c in own])
    c = blocks.where("not query").select("dim", F.pmod(F.xxhash64("ids", "rows"), F.lit(groups)).cast("int").alias("g"), *[F.col(c).alias(f"c_{c}") for c in own])
    best = q.join(c, ["dim", "g"]).mapInArrow(_tiles(k, dtype), "q_row long, query_id long, vec_id long, score double, c_row long")
    order = Window.partitionBy("query_id", "q_row").orderBy(F.desc("score"), "vec_id", "c_row")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != _NULL, F.col("vec_id")).alias("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
