"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

A window is ``WINDOW`` consecutive words of a benchmark item; a shorter item is one window. Of each window's
``GRAM``-word hashes the least is its fingerprint, so that equal windows have equal fingerprints wherever they stand:
every shared passage of ``WINDOW`` words is found. Document windows whose fingerprint is a benchmark fingerprint are
extended to the whole window and confirmed by two independent 64-bit hashes.

The windows of the benchmark are hashed on the executors and become a table of distinct (length, fingerprint, both hashes,
item). It goes out in slices of ``max_index_rows`` rows, dealt by a hash of window and item, so that neither long nor
repeated items nor a window of many items make a slice larger. One slice is the usual case; a larger benchmark takes one
pass over the documents for each slice, with the same result, and the lineage is cut every few passes.

Null and empty texts have no words and no hits. Repeated item ids count once, a null item id marks words but is not
listed. Repeated documents get a row each. Columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylattice.llm import kernels as K
from citylattice.llm.arrow import annotate, session
from citylattice.session import cut, forget

WINDOW, GRAM = 10, 5
U64 = np.uint64
MARKS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_starts", T.ArrayType(T.IntegerType())), T.StructField("hit_ends", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _parse(column: pa.Array):
    """Slices of lower-cased words: first row, bytes, word starts and ends, words' offsets by text, word hashes."""
    for lo, hi, data, offs in K.slices(column):
        low = K.LOWER[data]
        start, end, by_text = K.words(low, offs, K.ALNUM)
        yield lo, hi, low, start, end, by_text, K.word_hashes(low, start, end)


def _second(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return K.mix(K.SECOND.spans(K.SECOND.prefix(low), start, end))


def _at(hashes: np.ndarray, where: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hashes of k words from each position."""
    factor, out = K.seeds(k, salt) | U64(1), np.zeros(len(where), dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += hashes[where + j] * factor[j]
    return K.mix(out)


def _least(grams: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive hashes."""
    if len(grams) < n:
        return grams[:0]
    out = grams[: len(grams) - n + 1].copy()
    for j in range(1, n):
        np.minimum(out, grams[j : len(grams) - n + 1 + j], out=out)
    return out


class _Table:
    """Distinct windows of one length with their items; a bit for each 22-bit prefix of the first key screens look-ups."""

    def __init__(self, key: np.ndarray, first: np.ndarray, second: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, second, first))
        first, second, item, key = first[order], second[order], item[order], key[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.first, self.second = first[new], second[new]
        self.bounds, self.item = np.append(np.flatnonzero(new), len(first)), item
        self.screen = np.zeros(1 << 22, dtype=bool)
        self.screen[key >> U64(42)] = True
        self.keys = np.unique(key)

    def screened(self, keys: np.ndarray) -> np.ndarray:
        where = np.flatnonzero(self.screen[keys >> U64(42)])
        if len(where):
            at = np.minimum(np.searchsorted(self.keys, keys[where]), len(self.keys) - 1)
            where = where[self.keys[at] == keys[where]]
        return where

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Index of the window that has both hashes, or -1."""
        at = np.searchsorted(self.first, first)
        found = np.full(len(first), -1)
        left = np.arange(len(first))
        while len(left):  # equal first hashes are next to each other; nearly always one
            left = left[at[left] < len(self.first)]
            left = left[self.first[at[left]] == first[left]]
            same = self.second[at[left]] == second[left]
            found[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return found


class Index:
    """Windows of one slice of the benchmark, by their length in words."""

    def __init__(self, windows: pa.Table):
        self.ids, item = np.unique(windows.column("item").to_numpy(zero_copy_only=False).astype(object), return_inverse=True) if windows.num_rows else (np.zeros(0, object), np.zeros(0, int))
        n = windows.column("n").to_numpy()
        key, first, second = (windows.column(c).to_numpy().view(U64) for c in ("key", "first", "second"))
        self.tables = {int(k): _Table(key[n == k], first[n == k], second[n == k], item[n == k]) for k in np.unique(n)}


def _windows(batches):
    """All windows of items (item, text)."""
    for batch in batches:
        for lo, hi, low, start, end, by_text, h in _parse(batch.column(1)):
            h2 = _second(low, start, end)
            for i in range(hi - lo):
                a, b = int(by_text[i]), int(by_text[i + 1])
                if (n := min(WINDOW, b - a)) == 0:
                    continue
                where = np.arange(a, b - n + 1)
                first = _at(h, where, n, n)
                key = _least(K.grams(h[a:b], GRAM), WINDOW - GRAM + 1) if n == WINDOW else first
                items = batch.column(0).slice(lo + i, 1).take(pa.array(np.zeros(len(where), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (key, first, _at(h2, where, n, n + 50))), items], names=["n", "key", "first", "second", "item"])


#: No item's id; a null id marks words but is not listed.
NO_ITEM = "\0"


def _marker(index: Index):
    names = [None if i == NO_ITEM else i for i in index.ids]

    def compute(column: pa.Array, *before):
        n_rows = len(column)
        n_words, starts, ends, items = np.zeros(n_rows, np.int64), [None] * n_rows, [None] * n_rows, [None] * n_rows
        earlier = [x.to_pylist() for x in before]
        for lo, hi, low, start, end, by_text, h in _parse(column):
            n_words[lo:hi] = np.diff(by_text)
            text_of = np.repeat(np.arange(hi - lo), np.diff(by_text))
            h2, edge, pairs = None, np.zeros(len(h) + 1, dtype=np.int32), []
            for n, table in index.tables.items():
                if len(h) < n:
                    continue
                keys = _least(K.grams(h, GRAM), WINDOW - GRAM + 1) if n == WINDOW else K.grams(h, n, n)
                where = table.screened(keys)
                where = where[text_of[where] == text_of[where + n - 1]]
                if not len(where):
                    continue
                if h2 is None:
                    h2 = _second(low, start, end)
                found = table.find(_at(h, where, n, n), _at(h2, where, n, n + 50))
                where, found = where[found >= 0], found[found >= 0]
                np.add.at(edge, where, 1)
                np.add.at(edge, where + n, -1)
                got = np.unique(np.stack([text_of[where], found], axis=1), axis=0)
                pairs += [(t, x) for t, w in got for x in table.item[table.bounds[w] : table.bounds[w + 1]]]
            hit = np.cumsum(edge[:-1]) > 0
            if not hit.any():
                continue
            inner = by_text[1:-1][(by_text[1:-1] > 0) & (by_text[1:-1] < len(hit))]
            run_start = np.union1d(np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1), inner[hit[inner]])
            run_end = np.union1d(np.flatnonzero(np.diff(np.concatenate([hit.astype(np.int8), [0]])) == -1) + 1, inner[hit[inner - 1]])
            owner = text_of[run_start]
            for t in np.unique(owner):
                starts[lo + t] = (run_start[owner == t] - by_text[t]).astype(np.int32)
                ends[lo + t] = (run_end[owner == t] - by_text[t]).astype(np.int32)
            for t, x in pairs:
                if names[x] is not None:
                    items[lo + t] = (items[lo + t] or set()) | {names[x]}
        if earlier:
            for i, (a, b, c) in enumerate(zip(*earlier)):
                starts[i], ends[i] = _merged(a, b, starts[i], ends[i])
                items[i] = set(c or ()) | (items[i] or set())
        none = []
        return n_words, [none if x is None else x for x in starts], [none if x is None else x for x in ends], [sorted(x) if x else none for x in items]

    return compute


def _merged(a, b, c, d):
    """Union of two lists of word ranges."""
    ranges = sorted([*zip(a or (), b or ()), *(zip(c, d) if c is not None else ())])
    out = []
    for s, e in ranges:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [int(s) for s, _ in out], [int(e) for _, e in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_index_rows: int = 1 << 18, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, hit_starts and hit_ends (word ranges inside benchmark windows, ends exclusive) and items
    (ids, sorted as strings, of items that have a window in the text)."""
    session(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit(NO_ITEM)).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    windows = cut(items.mapInArrow(_windows, "n int, key long, first long, second long, item string").distinct())
    n = max(1, -(-windows.count() // max_index_rows))
    out = docs
    for s in range(n):
        index = Index((windows if n == 1 else windows.where(F.pmod(F.xxhash64("first", "item"), F.lit(n)) == s)).toArrow())
        before = ["hit_starts", "hit_ends", "items"] if s else []
        out = annotate(out, [text, *before], lambda index=index: _marker(index), MARKS, drop=[text] if s == n - 1 and not keep_text else [])
        if s % 4 == 3 and s < n - 1:
            out = cut(out)
    forget(windows)
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = decontaminate(docs.select("doc_id", "text"), benchmark, keep_text=False, **options)
    hit = F.coalesce(F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda s, e: e - s), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return marked.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a benchmark window; columns as they were."""
    names = {f.name for f in MARKS} & set(docs.columns)
    held = docs.withColumns({f"__{c}": F.col(c) for c in names})
    marked = decontaminate(held, benchmark, **options).where(F.size("hit_starts") == 0)
    return marked.select(*[F.col(f"__{c}").alias(c) if c in names else F.col(c) for c in docs.columns])


#: The report in SQL, by joining all windows.
ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, dw.n, p, item_id FROM dw JOIN win ON win.n = dw.n AND win.s = dw.s),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
