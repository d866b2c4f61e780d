"""Nulls in every column, repeated rows, empty tables, and columns named like the operators' own."""

import pytest
from pyspark.sql import functions as F

from claimgraph.llm import decontam, knn, langid, lm, mixing, ngram_join, pii, quality, suffix, tokens

CLASHES = ["a.b", "row", "base", "added", "loose", "t", "h", "hs", "hits", "from", "ident", "cdf", "parts", "__cdf", "__w", "__meets", "__base", "chunk", "block", "key", "id", "n", "label", "meets", "items", "spans", "score", "copy_no", "shuffle_key", "rate", "weight", "grams", "k1", "w", "lang_pred", "held_out", "n_words", "contaminated", "component_id"]
PASSAGE = " ".join(f"word{i}" for i in range(40)) + " mail a@b.co now "
ROWS = [(None, PASSAGE, None, None, None), (None, PASSAGE, "en", "s", 1), (None, None, None, None, None), (1, PASSAGE, "en", None, None), (2, PASSAGE + " tail", "en", "s", 3), (2, PASSAGE + " tail", "en", "s", 3), (3, None, "en", "s", 0), (4, "", None, "s", 0), (5, "é" * 5000, "fr", "s", 5000), (6, " ".join(f"word{i}" for i in range(14)), "en", "t", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, " ".join(f"word{i}" for i in range(3, 15))), (8, "word1 word2"), (9, None)], "item_id long, text string").select("*", F.lit(1).alias("doc_id"), F.lit(2).alias("h"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


@pytest.mark.parametrize("op", [pii.op1, tokens.op3, lm.op4, suffix.op5, ngram_join.op6, langid.op8])
def test_one_row_for_each(docs, op):
    assert sorted(str(r.doc_id) for r in op(docs).collect()) == sorted(str(r[0]) for r in ROWS)
    assert op(docs.filter("false")).count() == 0


def test_quality(docs, labels):
    assert quality.op9(docs, labels).filter("score between 0 and 1").count() == len(ROWS)
    assert quality.op9(docs.filter("false"), labels).count() == 0
    assert quality.op9(docs, labels.filter("false")).count() == len(ROWS)


def test_join_without_ids(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op6(docs).collect()}
    assert got == {(None, 39, 1), (None, 0, None), (1, 39, 1), (2, 40, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 10, 6)}
    alone = ngram_join.op6(docs.filter("doc_id is null")).collect()
    assert len(alone) == 3 and all(r.component_id is None for r in alone)


def test_decontam_without_ids(docs, bench):
    for df in (decontam.op10(docs, bench), decontam.decontaminate(docs, bench)):
        hits = sorted((str(r.doc_id), r.n_hit) for r in df.collect())
        assert hits == sorted([("None", 14), ("None", 14), ("None", 0), ("1", 14), ("2", 14), ("2", 14), ("3", 0), ("4", 0), ("5", 0), ("6", 13)])
    assert decontam.decontaminate(docs.filter("false"), bench).count() == 0
    named = decontam.op10(docs, bench.withColumn("item_id", F.concat(F.lit("item-"), "item_id")))
    assert named.filter("contaminated").count() == 6


def test_mixing_replaces_clashes(docs):
    got = mixing.mix(docs, size=3.0)
    assert len(got.columns) == len(set(got.columns)) == len(docs.columns)
    assert got.filter("copy_no < 0 or length(shuffle_key) <> 32").count() == 0
    assert mixing.mix(docs.filter("false")).count() == 0


def test_filters_keep_columns(docs):
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and kept.count() == 7
    clean = pii.redacted(docs, pii.train(docs))
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert clean.filter("text like '%@%' or n_chars <> length(text)").filter("text is not null").count() == 0


def test_search_asks_once(spark):
    rows = [(None, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0]), (40, [1.0, None])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("c").alias(c) for c in ("v", "cell", "score", "block")])
    assert [tuple(r) for r in knn.op2(vectors).orderBy("rank").collect()] == [(20, 1, 5, 4096), (20, 2, 6, 4096), (20, 3, 4, 0)]
