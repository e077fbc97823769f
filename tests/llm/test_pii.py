"""Base spans against Python's re, the additions of the method, and edge cases."""

import hashlib
import re

from pyspark.sql import functions as F

from citylattice.llm.pii import find, luhn, mod97, redact, report

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(doc_id, text):
    spans = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return (doc_id, *[sum(x[3] == k for x in spans) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest())


CASES = [
    "mail me: a.b+c@x-y.example.com, or a@b.c_d@e.f or x@y, @z.com q@.com q@a..b",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 000000010.1.1.255 1.2..3.4.5.6 é1.2.3.4é",
    "4111 1111 1111 1111 and 4111111111111111 4111111111111111 and 4111-1111-1111-1112, 0",
    "+1 (771) 555-1655 +44 20 7946 0958. +1 +1234567890 (+1-23)",
    "😀 a@b.co 😀 +1 (771) 555-1655 😀",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33",
    "my ssn 123-45-6789" + " filler" * 9 + " part 123-45-6789" + " filler" * 9 + " call 555-123-4567",
    "",
    None,
    "a" * 60_000 + " " + "1" * 60_000 + " " + "1 " * 20_000 + "1.1." * 5_000,
    "a@b.co " * 700,
    "@" * 1000 + "+" * 1000,
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(0, CASES[0])], "doc_id long, text string")
    got = sorted(tuple(r)[:6] for r in report(docs).collect())
    assert got == sorted([brute(i, t) for i, t in enumerate(CASES)] + [brute(0, CASES[0])])


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(tuple(r)[:6] for r in report(docs).collect())
    assert got == sorted(brute(r.doc_id, r.text) for r in docs.collect())


def test_additions(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES[:7])], "doc_id long, text string")
    text = dict(enumerate(CASES))
    more = {(r.doc_id, x.kind, text[r.doc_id][x.start : x.end]) for r in find(docs).collect() for x in r.pii if not x.base}
    assert (5, "iban", "GB82 WEST 1234 5698 7654 32") in more and len([x for x in more if x[0] == 5]) == 1
    assert (6, "ssn", "123-45-6789") in more and (6, "phone", "555-123-4567") in more
    assert (2, "card", "4111111111111111") in more
    one = spark.range(1).select(luhn(F.lit("4111 1111 1111 1111")), luhn(F.lit("4111111111111112")), mod97(F.lit("GB82WEST12345698765432")), mod97(F.lit("GB82WEST12345698765431"))).first()
    assert tuple(one) == (True, False, True, False)


def test_context_is_whole_words(spark):
    cases = ["the hotel preferred 555-123-4567", "I tell 555-123-4567", "tel. 555-123-4567", "Phones: 555-123-4567 in the party", "call 555-123-4567 about orders"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id for r in find(docs).collect() if r.pii} == {2, 3}


def test_redact(spark):
    rows = [(1, "a@b.co and 10.0.0.1.", "en", 20, "x"), (2, None, None, None, "y"), (3, "clean", "en", 5, None), (3, "é +1 (771) 555-1655", "fr", 19, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, pii string")
    got = [tuple(r) for r in redact(docs).collect()]
    assert got == [(1, "[EMAIL] and [IP].", "en", 17, "x"), rows[1], rows[2], (3, "é [PHONE]", "fr", 9, "z")]
    assert report(docs.limit(0)).count() == 0
