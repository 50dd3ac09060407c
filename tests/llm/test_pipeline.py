"""Stages of the pipeline, each on its own input."""

import __spark_entry__ as entry
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, SMALL).write.parquet(out)
        docs = spark.read.parquet(out)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= before
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        before = now


def test_names():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
