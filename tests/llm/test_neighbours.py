"""Exact neighbours against a full sort, and edge cases."""

import math

from citylattice.llm import neighbours
from citylattice.llm.neighbours import nearest


def brute(rows, k, modulus):
    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    rows, out = [r for r in rows if ok(r[1])], []
    for i, (q, v) in enumerate(rows):
        if q is None or q % modulus:
            continue
        scored = []
        for j, (c, w) in enumerate(rows):
            if i != j and len(v) == len(w):
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                scored.append((-s, c is None, c or 0, c))
        out += [(q, n, c, -s) for n, (s, _, _, c) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_small_blocks_and_edge_cases(spark, monkeypatch):
    import random

    random.seed(3)
    data = [(i, [round(random.uniform(-1, 1), 2) for _ in range(6)]) for i in range(150)]
    data += [(200 + i, data[i][1]) for i in range(30)]  # ties
    data += [(300, None), (320, [0.0] * 6), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (360, [float("nan")] * 6), (380, [float("inf")] * 6), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (420, []), (None, [0.5] * 6), (20, data[20][1]), (440, [1.0, 0.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<double>, label string, rank int")
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    assert rows(nearest(df, k=5)) == brute(data, 5, 20)
    assert rows(nearest(df.limit(0), k=5)) == []
    assert rows(nearest(df.where("vec_id in (0, 1, 2)"), k=20)) == brute([d for d in data if d[0] in (0, 1, 2)], 20, 20)
    huge = spark.createDataFrame([(0, [3e38, 1e38]), (1, [1e38, 3e38]), (20, [1e-38, 1e-40])], "vec_id long, embedding array<float>")
    assert len(rows(nearest(huge, k=2))) == 4


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert rows(nearest(df)) == brute([(r.vec_id, list(r.embedding)) for r in df.collect()], 20, 20)
