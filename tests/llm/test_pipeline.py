"""The pipeline's stages, one after the other, each against brute force on its own input."""

import corpus_pipeline
from factloom.llm.queries import QUERIES
from pyspark.sql import functions as F
from test_structure_operators import brute
from test_text_operators import check_packing


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, sf).cache()
    assert kept.columns == docs.columns and 0.5 < kept.count() / docs.count() < 1
    single = stages["near_duplicates"](spark, kept, sf).cache()
    assert {r.doc_id for r in single.collect()} == {c for _, c, _ in brute([(r.doc_id, r.text) for r in kept.collect()])}
    clean = stages["secrets"](spark, single, sf).cache()
    assert clean.columns == docs.columns and clean.count() == single.count()
    before = {r.doc_id: r for r in single.collect()}
    for r in clean.collect():
        assert r.text == before[r.doc_id].text or ("[secret]" in r.text and r.n_chars == len(r.text))
    check_packing(clean, stages["packing"](spark, clean, sf).collect())


def test_run_equals_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) == sorted(map(str, docs.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))


def test_stages_on_odd_documents(spark, sf, odd_documents, no_documents):
    """Nulls, repeats and clashing names pass every stage; an empty table stays empty."""
    clashing = odd_documents.withColumns({c: F.lit("x") for c in ("_text", "record", "row", "hash", "found", "_row", "slot")})
    for df in (clashing, no_documents):
        now = df
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, sf)
            assert after.columns == df.columns or name == corpus_pipeline.STAGES[-1][0]
            assert after.isEmpty() is (df is no_documents)
            now = after
