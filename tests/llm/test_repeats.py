"""Removed bytes against a table of all 200-byte strings, and edge cases."""

import hashlib
import random

from citylattice.llm import repeats
from citylattice.llm.repeats import LENGTH, remove, report


def brute(docs):
    seen = {}
    raw = [(t or "").encode() for _, t in docs]
    for i, b in enumerate(raw):
        for p in range(len(b) - LENGTH + 1):
            seen.setdefault(b[p : p + LENGTH], []).append((i, p))
    cover = [bytearray(len(b)) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                cover[i][p : p + LENGTH] = b"\x01" * LENGTH
    out = []
    for (d, _), b, c in zip(docs, raw, cover):
        runs = sum(c[i] and not (i and c[i - 1]) for i in range(len(c)))
        out.append((d, len(b), sum(c), runs, hashlib.sha256(bytes(x for x, y in zip(b, c) if not y)).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cases():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, other = text(420), text(200)
    out = [(i, text(rng.randrange(300)) + passage[: rng.randrange(150, 420)] + text(rng.randrange(300))) for i in range(30)]
    out += [(50 + i, text(100) + passage[i : 230 + 3 * i] + text(5) + passage[200:]) for i in range(20)]
    base = text(900)
    for i in range(25):  # copies with one change each
        p = rng.randrange(900)
        out.append((100 + i, base[:p] + text(3) + base[p + rng.randrange(4) :]))
    out += [(200, other), (201, "x" + other + "y"), (202, other[:199]), (203, None), (204, ""), (205, "ab" * 700), (206, "z" * 199), (207, "z" * 200), (208, "z" * 201), (209, text(30_000)), (210, text(50) * 9), (100, out[50][1]), (205, "ab" * 700), (None, other), (211, "é" * 100), (212, "é" * 101)]
    return out


def test_equals_brute_force(spark):
    data = cases()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, a string, n_bytes int")
    assert rows(report(docs)) == brute(data)
    assert report(docs.limit(0)).count() == 0


def test_split_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 3)
    monkeypatch.setattr(repeats, "WORK", 2)
    data = cases()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(report(docs)) == brute(data)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert rows(report(docs)) == brute([tuple(r) for r in docs.collect()])


def test_remove(spark):
    same = "".join(chr(97 + i * i % 26) + str(i) for i in range(120))
    docs = spark.createDataFrame([(1, "own " + same, 5), (2, same + " mine", 6), (3, None, 7)], "doc_id long, text string, id int")
    got = remove(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "own ", 5), (2, " mine", 6), (3, None, 7)]


def test_many_equal_rows_give_short_lists(spark):
    rng = random.Random(3)
    one = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    docs = spark.range(10_000).selectExpr("cast(null as bigint) doc_id", f"'{one}' text")
    found = repeats.repeated(docs).collect()
    assert len(found) == 1 and len(found[0].firsts) <= 1500
    got = {tuple(r) for r in report(docs).collect()}
    assert len(got) == 1 and got.pop()[1:4] == (1500, 1500, 1)
