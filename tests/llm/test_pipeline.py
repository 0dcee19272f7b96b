import corpus_pipeline
from millrace.llm import exact_dedup, minhash, packing, pii, quality_rules

from . import cases


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "private", "packed"]
    got = {(r.doc_id, r.start, r.length, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect()}
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    docs = docs.where(docs.doc_id.isin(*kept))
    docs = docs.where(docs.doc_id.isin(*[r.doc_id for r in exact_dedup.classes(docs).where("kept").collect()]))
    docs = docs.where(docs.doc_id.isin(*[r.doc_id for r in minhash.classes(docs).where("kept").collect()]))
    texts = {r.doc_id: pii.redacted(r.text) for r in docs.collect()}
    code = packing.encoder()
    totals = {i: len(code.encode_ordinary(t)) + 1 for i, t in texts.items()}
    assert {i: t for i, _, _, t in got} == totals and 0 < len(totals) < 200
    assert sum(n for _, _, n, _ in got) == sum(totals.values())


def test_stages_take_odd_rows(spark, sf):
    for rows in (cases.edge(spark), cases.empty(spark)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, sf)
            assert name == "packed" or docs.columns == columns
        assert docs.count() >= 0
