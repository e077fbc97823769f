"""Parsing and rules against plain Python, accuracy on labels held back, and edge cases."""

import math
import re

import numpy as np
import pyarrow as pa

from citylattice.llm import kernels as K
from citylattice.llm.urls import BITS, RULES, SIZES, fit, judge, label_by_rules, learn, report


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [
    "http://www.example.com/en/a", "https://WWW.Example.COM/en/", "http://example.com/en/1?x#y", "http://a.www.example.com/en/", "http://notexample.com/en/x", "http://example.com", "http://example.com?en/", "http://example.com#/en/", "ftp://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://xnet/es/", "nothing", "", None, "a://b://c/d", "://", "http://É.com/ü?x", "http://x.org/" + "long/" * 20_000, "http://example.com/EN/1", "http://x.com\n/en/", "http://example.com/en/1?x#y",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, verdict string, p_block double")
    got = {r.page_id: r for r in report(df).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    assert report(df.limit(0)).count() == 0
    assert {r.verdict for r in report(df.where("page_id in (12, 13, 14)")).collect()} == {"allow"}


def test_held_out_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = sorted((r.url, r.verdict == "block") for r in label_by_rules(pages).collect())
    cut = [plain(u)[:2] for u, _ in rows]
    known = [(h, p, y) for (h, p), (_, y) in zip(cut, rows)]
    train, held = known[::2], known[1::2]
    model = fit(*map(list, zip(*train)))
    p = model.score(pa.array([h for h, _, _ in held]), pa.array([q for _, q, _ in held]))
    assert np.mean((p >= 0.5) == [y for _, _, y in held]) > 0.95


def gram_cells(host, path):
    """Features of a URL by whole numbers instead of arrays."""
    out = []
    for field, value in enumerate((host, path)):
        raw = b"\x01" + value.encode() + b"\x02"
        for k in SIZES:
            for i in range(len(raw) - k + 1):
                h = sum((x + 1) * pow(K.FIRST.base, j, K.PRIME) for j, x in enumerate(raw[i : i + k])) % K.PRIME
                out.append(int(K.mix(np.array([h + 64 * field + k], np.uint64))[0]) >> (64 - BITS))
    return out


def test_scores_equal_plain_sums(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = learn(label_by_rules(pages))
    for r in report(pages.limit(60)).collect():
        cells = gram_cells(r.host, r.path)
        z = sum(model.weights[c] for c in cells) / math.sqrt(len(cells)) + model.bias
        assert abs(r.p_block - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9
        assert r.rule or r.verdict == ("block" if r.p_block >= 0.5 else "allow")


def test_long_urls_in_parts(spark, monkeypatch):
    model = fit(["a.b", "c.d"], ["/x", "/y/z"], [True, False])
    long = ["p" * 9 + str(i) * (i * 977) for i in range(12)]
    whole = model.score(pa.array(["h.org"] * 12), pa.array(long))
    monkeypatch.setattr(K, "SLICE", 64)
    assert np.allclose(whole, model.score(pa.array(["h.org"] * 12), pa.array(long)), atol=1e-12)
    df = spark.createDataFrame([(1, "http://x.org/" + "long/" * 1_000_000)], "page_id long, url string")
    assert len(report(df).first().path) == 5_000_001


def test_own_labels(spark):
    labelled = spark.createDataFrame([("http://casino.org/win", "block"), ("http://bonus-casino.org/spin", "block"), ("http://school.org/maths", "allow"), ("http://museum.org/art", "allow")], "url string, verdict string")
    df = spark.createDataFrame([(1, "http://casino.info/x"), (2, "http://school.info/art")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in judge(df, learn(labelled)).collect()}
    assert got == {1: "block", 2: "allow"}
