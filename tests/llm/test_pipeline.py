"""The pipeline's decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline
from claimgraph.llm import decontam, ngram_join, pii
from tests.llm.test_brute_force import base_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 !!", "en", "s", 6), (10**6 + 2, "Call +1 415 555 0100 and the others with them.", None, None, None)], docs.schema))
    columns = docs.columns
    sizes = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
            sizes.append((before.count(), docs.count()))
        if i == 0:
            assert docs.filter(f"doc_id in ({10**6}, {10**6 + 1})").count() == 0
        if i == 1:
            assert ngram_join.near_duplicates(docs).filter("component_id <> doc_id").count() == 0
        if i == 2:
            assert decontam.op10(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count() == 0
        if i == 3:
            assert not any(base_spans(r.text) for r in docs.collect())
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert sizes[3][0] == sizes[3][1]
    assert docs.groupBy("doc_id", "copy_no").count().filter("count > 1").count() == 0
    assert pii.train(docs.filter("false")).weights == {}
