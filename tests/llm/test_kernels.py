"""Polynomial hashes against whole numbers, and strings that collide modulo powers of two."""

import numpy as np
import pytest

from citylattice.llm import kernels as K
from citylattice.llm.decontaminate import report as leaks
from citylattice.llm.lattice import report as scores
from citylattice.llm.minhash import report as groups
from citylattice.llm.repeats import report as repeats
from test_repeats import brute as removed


def pair(n):
    """Two strings of n letters that are equal to every polynomial with an odd base modulo 2^64, for n from 1024."""
    parity = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in parity), "".join("ba"[x] for x in parity)


def test_hashes_are_polynomials():
    data = np.random.default_rng(3).integers(0, 256, 3 * K.STEP).astype(np.uint8)
    for h in (K.FIRST, K.SECOND):
        prefix = h.prefix(data)
        for a, n in ((0, 5), (K.STEP - 3, 9), (2 * K.STEP + 7, 300), (5, 0)):
            want = sum((int(x) + 1) * pow(h.base, k, K.PRIME) for k, x in enumerate(data[a : a + n])) % K.PRIME
            assert int(h.spans(prefix, np.array([a]), np.array([a + n]))[0]) == want
        assert (h.windows(prefix, 40)[[0, 77, -1]] == h.spans(prefix, np.array([0, 77, len(data) - 40]), np.array([40, 117, len(data)]))).all()


@pytest.mark.parametrize("n", [128, 512, 1024, 4096])
def test_no_collisions(n):
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in pair(n))
    for h in (K.FIRST, K.SECOND):
        a, b = (int(h.spans(h.prefix(d), np.array([0]), np.array([n]))[0]) for d in (x, y))
        assert a != b and (a ^ b) & 0xFFFFFFFF


def test_operators_tell_such_words_apart(spark):
    rows = [(10 * i + j, t) for i, n in enumerate((128, 1024, 4096)) for j, t in enumerate(pair(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = docs.where("doc_id % 2 = 0").selectExpr("doc_id item_id", "text")
    assert {r.doc_id: r.n_items for r in leaks(docs, items).collect()} == {d: 1 - d % 2 for d, _ in rows}
    assert all(r.kept for r in groups(docs).collect())
    got = {r.doc_id: r.n_known for r in scores(docs).collect()}
    held = {r.doc_id for r in docs.selectExpr("doc_id", "crc32(binary(string(doc_id))) % 7 = 2 held").where("held").collect()}
    assert got == {d: 2 - (d in held) for d, _ in rows}
    assert sorted(tuple(r) for r in repeats(docs).collect()) == removed(rows)
