"""Counts and base scores against plain Python, the lattice against all segmentations, and edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from citylattice.llm import lattice as L
from citylattice.llm.lattice import SIGN, Lattice, default_vocabulary, read_pieces, report


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in docs:
        w = [*tokens(t), None]
        out[i] = (held[i], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    return out


def test_sum_over_all_segmentations():
    pieces = (b"a", b"ab", b"b", SIGN, SIGN + b"a", b"bab", *[bytes([b]) for b in range(256)])
    weights = np.linspace(1, 3, len(pieces) + 1)
    logp = np.log(weights / weights.sum())
    words = [b"abab", b"b", b"xyz", b"", "é".encode(), b"ab" * 400]

    def plain(word):
        whole, p = SIGN + word, [1.0] + [0.0] * (len(SIGN) + len(word))
        for end in range(1, len(p)):
            for piece, x in zip(pieces, logp):
                if whole[:end].endswith(piece):
                    p[end] += p[end - len(piece)] * math.exp(x)
        return p[-1]

    model = Lattice(pieces, logp)
    got = model.score(pa.array(words, pa.binary()))
    for w, x in zip(words[:5], got):
        assert math.exp(x) == pytest.approx(plain(w))
    assert got[5] < -400
    for lo, hi, data, word, first in model.batches(pa.array(words[:5], pa.binary())):  # uses of pieces cover the bytes
        edges = model.edges(data, word, first)
        uses = model.expected(data, word, first, edges, model.forward(data, word, first, edges), np.ones(hi - lo))
        assert sum(n * len(p) for n, p in zip(uses, pieces)) == pytest.approx(len(data))


def segmentations(whole, pieces):
    """Lists of numbers of the pieces that make up ``whole``."""
    if not whole:
        yield []
    for x, piece in enumerate(pieces):
        if whole.startswith(piece):
            for rest in segmentations(whole[len(piece) :], pieces):
                yield [x, *rest]


@pytest.mark.parametrize("common", [0, 2, 4096])
def test_scores(spark, monkeypatch, common):
    """The learnt model and its scores, from all segmentations of each word; blocks and common words of several sizes."""
    monkeypatch.setattr(L, "BLOCK", 12)
    monkeypatch.setattr(L, "COMMON", common)
    pieces = (b"a", b"ab", b"b", b"ba", b"c", SIGN, SIGN + b"a", SIGN + b"ab", *[bytes([b]) for b in range(256)])
    weights = tuple(1.0 + 0.01 * i for i in range(len(pieces)))
    monkeypatch.setattr(L, "read_pieces", lambda path: (pieces, weights))
    docs = [(1, "ab ab ba"), (2, "abc b ab"), (3, "ba"), (4, None), (5, ""), (6, "cab ab AB\tab"), (7, "ab abba"), (8, "new ab"), (9, "ab ab ab c")]
    held = {i: i % 4 == 0 for i, _ in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in tokens(t))
    n_train = sum(not h for h in held.values())
    n, v = sum(counts.values()) + n_train, len(counts) + 1

    def weighted(word, p):
        return [(math.prod(p[x] for x in s), s) for s in segmentations(SIGN + word.encode(), pieces)]

    start = [*weights, max(weights)]
    prior = [w / sum(start) for w in start]
    uses = [L.PRIOR * p for p in prior]
    uses[-1] += n_train
    for w, c in counts.items():
        found = weighted(w, prior)
        whole = sum(p for p, _ in found)
        for p, s in found:
            for x in s:
                uses[x] += c * p / whole
    logp = [u / sum(uses) for u in uses]
    end = math.log10((n_train + v * logp[-1]) / (n + v))
    want = {i: end + sum(math.log10(counts[w] / (n + v) + v / (n + v) * sum(p for p, _ in weighted(w, logp))) for w in tokens(t)) for i, t in docs}
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in L.score(table, "any", held=table.doc_id % 4 == 0).collect()}
    assert len(got) == len(docs) and all(got[i].held_out == held[i] for i in got)
    for i in want:
        assert got[i].score == pytest.approx(want[i], rel=1e-9)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = base([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in report(docs).collect()}
    assert len(got) == len(want)
    for i, (held, n, known, train, b) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(b) and r.score < 0
    # learning pays on texts that were not seen: against the weights of the file alone
    held = {r.doc_id: r.score for r in got.values() if r.held_out}
    unlearnt = {r.doc_id: r.score for r in report(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()}
    assert set(held) == set(unlearnt) and sum(held.values()) > 0.7 * sum(unlearnt.values())
    assert all(held[i] > unlearnt[i] for i in held if want[i][1] > 50)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 40)
    rows = [(1, "One two  one"), (2, None), (3, ""), (4, "two\tthree\x00four é中😀"), (5, "w" * 3000 + " " + "long text " * 5000), (8, "only here")]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, block string").repartition(2)
    want = base(rows)
    got = {r.doc_id: r for r in report(docs).collect()}
    for i, (held, n, known, train, b) in want.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held, n, known, train)
        assert got[i].base_score == pytest.approx(b)
    assert report(docs.limit(0)).count() == 0
    none = [r for r in report(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()]
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in none)
    pieces, weights = read_pieces(default_vocabulary())
    assert len(pieces) == len(weights) and len(set(pieces[:-256])) == len(pieces) - 256
