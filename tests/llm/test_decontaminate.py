"""The operator against a plain loop over windows, and its edge cases."""

import hashlib
import re

from citylattice.llm.decontaminate import clean, decontaminate, report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in got if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force_on_the_tables(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(report(docs, items)) == want
    assert any(r[5] for r in want)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short, item"), (10, "short item"), (3, ""), (4, None), (None, "no id here"), (2, "twice"), (5, "é ü ñ")]
DOCS = [
    (1, "x one two three four five six seven eight nine ten y"),
    (2, "one two three four five six seven eight nine y ten"),
    (3, "SHORT-item! short item and twice"),
    (4, None),
    (5, ""),
    (6, "short"),
    (7, "item short"),
    (8, "No id. Here"),
    (9, "é ü ñ"),
    (10, "É ü ñ; é ü ñ"),
    (11, "w " * 30000 + "two three four five six seven eight nine ten eleven " * 50),
    (11, "twice"),
    (None, "twice twice"),
    (12, "ten short"),
]


def test_small_cases(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(report(docs, items)) == brute(DOCS, ITEMS)


def test_benchmark_in_slices_gives_the_same(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(report(docs, items, max_index_rows=3)) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert report(docs.limit(0), items).count() == 0
    assert rows(report(docs, items.limit(0))) == brute(DOCS, [])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "twice", 5, "a"), (2, "clean", 7, "b")], "doc_id long, text string, n_words int, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in clean(docs, items).collect()] == [(2, "clean", 7, "b")]
    assert dict(decontaminate(docs, items).dtypes)["n_words"] == "bigint"


def test_repeated_and_long_items_fill_no_slice(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    items = spark.createDataFrame([(1, "same words in every row of this item " * 3)] * 2000 + [(2, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(long.split()[2900:2950])), (2, "same words in every row of this item same words")], "doc_id long, text string")
    once = [(1, "same words in every row of this item " * 3), (2, long)]
    assert rows(report(docs, items, max_index_rows=1000)) == brute([tuple(r) for r in docs.collect()], once)
