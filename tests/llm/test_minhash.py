"""Components against brute force over all pairs, by heads and by blocks, and edge cases."""

import random
import re
from collections import defaultdict

from citylattice.llm import minhash
from citylattice.operators.components import components
from citylattice.llm.minhash import keep_one, report


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    holders, root = defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += 1
            holders[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    out, n = [], 0
    for _ in range(60):  # near copies: one or two changes each, so that only some pairs are links
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(150)] = f"x{n}{rng.random()}"
        out.append((n, " ".join(w)))
        n += 1
    chain = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(12):  # each is a link of the next, the ends are not
        chain = chain[:-3] + [f"c{i}a"]
        out.append((n, " ".join(chain)))
        n += 1
    out += [(500 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)]
    out += [(600 + i, out[0][1]) for i in range(20)] + [(700, None), (701, ""), (702, " \t\n"), (703, "One Two"), (704, "one two"), (705, "two one"), (706, "one two three four five"), (None, "one two"), (703, "again one two three four five"), (707, "long " * 80_000), (708, "LONG " * 90_000)]
    return out


def test_components_by_heads_and_by_blocks(spark, monkeypatch):
    data = cases()
    docs = spark.createDataFrame([(d, t, "x", 9) for d, t in data], "doc_id long, text string, cls string, n_shingles int")
    want = brute(data)
    assert rows(report(docs)) == want
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "LARGE", 30)
    assert rows(report(docs)) == want


def test_keep_one(spark):
    data = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, None), (4, ""), (5, "other words than these are here")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]
    assert report(docs.limit(0)).count() == 0


def test_keep_one_of_components_that_share_an_id(spark):
    texts = [f"{w} one two three four five six" for w in ("red", "green blue", "a b c d e f g h")]
    data = [(None, t) for t in texts * 2] + [(7, t + " of seven and more words that differ from those above") for t in texts]
    data += [(i, t) for i in (None, 7, 8) for t in (None, "", " \t\x0b")] * 2
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    worded = [x for x in data if (x[1] or "").strip()]
    want = [next(x for x in worded if x[1] == t) for t in dict.fromkeys(t for _, t in worded)] + [x for x in data if not (x[1] or "").strip()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in keep_one(docs).collect())


def test_keep_one_does_not_depend_on_order(spark):
    data = [(1, "a b c d e f", lang, source, 1) for lang in ("en", "de", None) for source in ("z", "y", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = {str(keep_one(spark.createDataFrame(x, schema).repartition(n)).collect()) for x, n in ((data, 3), (data[::-1], 2))}
    assert len(got) == 1


def test_all_pairs_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert rows(report(docs)) == brute([tuple(r) for r in docs.collect()])


def test_long_path(spark):
    edges = spark.range(200).selectExpr("lpad(string((id * 7919) % 1009), 5, '0') u", "lpad(string(((id + 1) * 7919) % 1009), 5, '0') v")
    got = components(edges).collect()
    assert len(got) == 201 and len({r.root for r in got}) == 1 and got[0].root == min(r.node for r in got)
