"""Counts against plain Python, held-out accuracy, and edge cases."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from citylattice.llm.language import TOP, grams_by_text, identify, keep_known, learn, report


def plain(text):
    out, s = Counter(), "_"
    for c in text:
        c = c.lower()[0] if c.isalpha() else "_"
        if c != "_" or s[-1] != "_":
            s += c
    s += "" if s[-1] == "_" else "_"
    for n in (1, 2, 3):
        out.update(s[i : i + n] for i in range(len(s) - n + 1))
    del out["_"]
    return out if len(s) > 1 else Counter()


def test_counts():
    texts = ["Ab ab, ÀÉ😀ß中x", "", None, "123 --", "a", " a ", "Zß" * 3000]
    for text, (codes, counts) in zip(texts, grams_by_text(pa.array(texts))):
        want = plain(text or "")
        got = {}
        for code, n in zip(codes.tolist(), counts.tolist()):
            signs = []
            while code:
                signs.append(code & 0x1FFFFF)
                code >>= 21
            got["".join("_" if x == 1 else chr(x) for x in reversed(signs))] = n
        assert got == dict(want)


def code(gram):
    """An n-gram's rank among ties: its signs as one number, the separator as 1."""
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == "_" else ord(c))
    return out


def ranked(counts):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:TOP]


def test_predictions(spark):
    """Every prediction against profiles and out-of-place distances by plain Python; ties are in the rows of one sign."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = [(10**9 + i, t, "en" if i % 2 else "fr") for i, t in enumerate(["zq", "b a", "a", "Q!", "1", "", None, "qz zq"])]
    docs = table.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    rows = [tuple(r) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    totals = {}
    for i, text, lang in rows:
        if not held[i] and text is not None and lang is not None:
            totals.setdefault(lang, Counter()).update(plain(text))
    profiles = {k: {g: at for at, g in enumerate(ranked(c))} for k, c in sorted(totals.items())}
    got = {r.doc_id: r for r in report(docs).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        mine = ranked(plain(text or ""))
        away = {k: sum(abs(p[g] - at) if g in p else TOP for at, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(away, key=away.get) if mine else "und"
        assert (got[i].held_out, got[i].lang_pred) == (held[i], best)
        assert got[i].score == (1 - away[best] / (TOP * len(mine)) if mine else 0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in report(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.95
    assert keep_known(docs).count() == docs.count()


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "le chat et le chien", "fr"), (3, "le chat et le chien", "fr"), (4, None, "en"), (5, "", None), (6, "12 34 !?", "en"), (None, "the dog", None), (7, "le chien " * 30_000, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    profiles = learn(docs)
    assert sorted(profiles) == ["en", "fr"]
    got = [(r.doc_id, r.lang_pred) for r in identify(docs, profiles).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (3, "fr"), (3, "fr"), (4, "und"), (5, "und"), (6, "und"), (None, "en"), (7, "fr")], key=str)
    assert keep_known(docs).columns == docs.columns
    assert report(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}
