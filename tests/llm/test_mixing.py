"""Targets by the stated iteration, taken words near them, and edge cases."""

from collections import defaultdict

import pytest

from citylattice.llm.mixing import mix, report


def poured(sizes, weights=(5, 2, 1), total=1.5, cap=2.0):
    """Targets by the iteration itself: cap what is above, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = total * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def holds(rows, source_of):
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = source_of(r)
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert 0 <= r.taken <= 2 * r.size
    want = poured(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s] + 1


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mix(docs, keep=["doc_id", "source"]).collect()
    assert len(rows) == docs.count()
    holds(rows, lambda r: r.source)
    again = mix(docs.repartition(7), keep=["doc_id", "source"]).collect()
    assert sorted(rows) == sorted(again)


def test_small_cases(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(60)] + [(100 + i, "a b c", None) for i in range(20)]
    rows += [(None, None, None), (200, "", "empty"), (201, "x " * 50_000, "long"), (7, "same text", "s1"), (7, "same text", "s1")] + [(300, "tie tie tie tie", "tied")] * 10
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, hash string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    assert {"doc_id", "text", "source", "hash", "size", "source_size", "target", "taken"} == set(got[0].asDict())
    holds([r for r in got if r.source not in ("long", "tied")] and got, lambda r: r.source)
    assert len({r.taken for r in got if r.source == "tied"}) == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert report(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.source_size, r.target, r.taken) for r in report(blank).collect()] == [(0, 0, 0.0, 0)] * 2
