"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A rule is a host, a slash and a path prefix. It fits its host and all subdomains if the URL's path begins with the
prefix; of several the longest wins, of equally long ones a block and then the smaller by code point. A URL that no rule
fits is judged by the model.

The model learns from a small labelled URL table. ``label_by_rules`` makes one where none is given: the distinct URLs on
which the rules decide, at most ``SAMPLE`` of each verdict and ``SAMPLE_BYTES`` long, those of least hash. Only this bounded
sample reaches the driver. With no labelled URL, or labels of one kind only, the model returns that kind, or allow.

Null URLs and URLs without ``://`` have an empty host and path, which the model judges like any other. Repeated rows get
a row each; columns of the input that have the name of a result are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylattice.llm import kernels as K
from citylattice.llm.arrow import annotate

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Labelled URLs of each verdict at most, and their length in bytes at most.
SAMPLE, SAMPLE_BYTES = 2000, 4096
BITS, SIZES = 16, (1, 2, 3, 4, 5)
#: Penalty on squared weights, and gradient steps.
RIDGE, STEPS = 1e-4, 300
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower-case ASCII, and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The rule that decides, as (rule, verdict), or null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    # from the last resort to the first choice
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0]), reverse=True):
        name, _, prefix = rule.partition("/")
        here = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        fits = F.when(here, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _padded(column: pa.Array):
    """Slices of a field as (first row, bytes with a sign before and after each text, each byte's row)."""
    for lo, hi, data, offs in K.slices(column):
        n = hi - lo
        padded = np.zeros(len(data) + 2 * n, dtype=np.uint8)
        mine = np.ones(len(padded), dtype=bool)
        starts = offs[:-1] + 2 * np.arange(n)
        ends = offs[1:] + 2 * np.arange(n) + 1
        mine[starts] = mine[ends] = False
        padded[starts], padded[ends], padded[mine] = 1, 2, data
        yield lo, padded, np.repeat(np.arange(n), np.diff(offs) + 2)


def _features(host: pa.Array, path: pa.Array):
    """Parts of (row, feature): every n-gram of each field, with a sign before and after it; rows count from 0. A part has
    about ``K.SLICE`` n-grams of one size at most, however long a URL is."""
    for field, column in enumerate((host, path)):
        for lo, padded, row in _padded(column):
            for part in range(0, len(padded), K.SLICE):
                data, owner = (x[part : part + K.SLICE + max(SIZES) - 1] for x in (padded, row))
                prefix = K.FIRST.prefix(data)
                for k in SIZES:
                    at = np.arange(min(len(data) - k + 1, K.SLICE)) if len(data) >= k else np.zeros(0, np.int64)
                    at = at[owner[at] == owner[at + k - 1]] if len(at) else at
                    h = K.mix(K.FIRST.spans(prefix, at, at + k) + np.uint64(64 * field + k))
                    yield owner[at] + lo, (h >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        n = len(host)
        z, grams = np.zeros(n), np.zeros(n)
        for row, cell in _features(host, path):
            z += np.bincount(row, weights=self.weights[cell], minlength=n)
            grams += np.bincount(row, minlength=n)
        # over the root of a URL's n-grams, so that long URLs weigh like short ones
        z = z / np.sqrt(np.maximum(grams, 1)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(hosts: list[str], paths: list[str], blocked: list[bool]) -> Model:
    """Logistic regression by gradient steps with momentum from zero, both verdicts weighing alike; the same rows in the
    same order give the same model."""
    n, y = len(hosts), np.array(blocked, dtype=float)
    if not n or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 20.0 if n and y[0] else -20.0)
    row, cell = map(np.concatenate, zip(*_features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))))
    value = (1.0 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)))[row]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, v, b, vb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for _ in range(STEPS):
        p = 1.0 / (1.0 + np.exp(-(np.bincount(row, weights=w[cell] * value, minlength=n) + b)))
        g = (p - y) * share
        v = 0.9 * v - 4.0 * (np.bincount(cell, weights=g[row] * value, minlength=1 << BITS) + RIDGE * w)
        vb = 0.9 * vb - 4.0 * g.sum()
        w, b = w + v, b + vb
    return Model(w, b)


def _parsed(df: DataFrame, url: str) -> DataFrame:
    host, path = split_url(F.col(url))
    return df.withColumns({"host": host, "path": path}).withColumn("__rule", rule_for(F.col("host"), F.col("path")))


def label_by_rules(urls: DataFrame, url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """A small labelled table (url, verdict) from the URLs that the rules decide."""
    known = _parsed(urls.select(F.col(url).alias("url")).where(F.octet_length("url") <= SAMPLE_BYTES), "url").where("__rule is not null").select("url", F.col("__rule.verdict").alias("verdict")).distinct()
    parts = [known.where(F.col("verdict") == v).orderBy(F.xxhash64("url"), "url").limit(sample) for v in ("allow", "block")]
    return reduce(DataFrame.union, parts)


def learn(labelled: DataFrame, url: str = "url", verdict: str = "verdict") -> Model:
    """Fits on a labelled table that is small by contract; more than ``2 * SAMPLE`` rows are refused."""
    host, path = split_url(F.col(url))
    rows = labelled.select(host.alias("host"), path.alias("path"), (F.col(verdict) == "block").alias("block")).where("block is not null").limit(2 * SAMPLE + 1).toArrow().to_pylist()
    if len(rows) > 2 * SAMPLE:
        raise ValueError(f"the labelled table has more than {2 * SAMPLE} rows")
    rows.sort(key=lambda r: (r["host"], r["path"], r["block"]))
    return fit([r["host"] for r in rows], [r["path"] for r in rows], [r["block"] for r in rows])


FIELDS = T.StructType([T.StructField("p_block", T.DoubleType())])


def judge(pages: DataFrame, model: Model, url: str = "url", keep_url: bool = True) -> DataFrame:
    """``pages`` with host, path, rule, verdict and p_block."""
    new = ("host", "path", "rule", "verdict", "p_block")
    plain = pages.select(*[c for c in pages.columns if c not in new])
    parsed = _parsed(plain, url) if keep_url else _parsed(plain, url).drop(url)
    scored = annotate(parsed, ["host", "path"], lambda: lambda h, p: [model.score(h, p)], FIELDS)
    verdict = F.coalesce("__rule.verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.withColumns({"rule": F.col("__rule.rule"), "verdict": verdict}).drop("__rule")


def report(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, p_block."""
    model = learn(label_by_rules(pages))
    return judge(pages.select("page_id", "url"), model, keep_url=False).select("page_id", "host", "path", "rule", "verdict", "p_block")
