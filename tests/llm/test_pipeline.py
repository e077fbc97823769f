"""The pipeline stage by stage against brute force on the smallest tables, with planted rows."""

import re

import corpus_pipeline
from test_decontaminate import brute as leaks
from test_minhash import brute as groups
from test_mixing import holds
from test_pii import PLAIN, passes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(90_001, None, "en", "src1", None), (90_002, "", "en", None, 0), (90_003, "12 34 !!", "fr", "src1", 8), (90_004, "mail x.y@example.com or call " + "the " * 40, "en", None, 150)]
    docs = given.unionByName(spark.createDataFrame(more, SCHEMA))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    rows = {r.doc_id: r for r in docs.collect()}
    d, now, kept = str(tmp_path), docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        now.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        kept.append(now.collect())
        if name != "mixing":
            assert now.columns == docs.columns
    language, near, clean, private, mixed = kept
    # only texts without letters go: these tables are clean
    assert {r.doc_id for r in language} == {i for i, r in rows.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    again = corpus_pipeline.minhash.near_duplicates(spark.read.parquet(f"{d}/language"), percent=80)
    assert {r.doc_id for r in near} == {r.doc_id for r in again.collect() if r.doc_id == r.component_id}
    assert len(near) == len({x[2] for x in groups([(r.doc_id, r.text) for r in language], percent=80)})
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {x[0] for x in leaks([(r.doc_id, r.text) for r in near], bench) if not x[5]}
    before = {r.doc_id: r.text for r in clean}
    assert {r.doc_id for r in private} == set(before)
    for r in private:
        assert r.n_chars == len(r.text)
        found = [m[0] for k, p in PLAIN.items() for m in re.finditer(p, before[r.doc_id]) if passes(k, m[0])]
        assert all(x not in r.text for x in found)
        if not found and r.text != before[r.doc_id]:
            assert re.search(r"\[(CARD|IBAN|SSN|PHONE)\]", r.text)
    whole = {r.doc_id: r for r in mixed}
    full = corpus_pipeline.mixing.mix(spark.read.parquet(f"{d}/personal_data")).collect()
    holds(full, lambda r: r.source)
    assert {r.doc_id: r.taken for r in full if r.taken > 0} == {i: r.taken for i, r in whole.items()}
    out = corpus_pipeline.run(spark, d)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixed))

