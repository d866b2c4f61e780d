"""No document is lost for its alphabet, or for want of an id of its own."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimgraph.llm import langid, mixing


def test_language_of_many_characters(spark):
    """6,000 characters: what it was taught is recognised however many documents there are, and noise of the same characters isn't."""
    random.seed(1)
    signs = [chr(0x4E00 + i) for i in range(6000)]
    text = lambda: "".join(random.choices(signs, k=3000))
    taught = [text() for _ in range(300)]
    latin = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = latin.union(spark.createDataFrame([(100_000 + i, t, "zz") for i, t in enumerate(taught)], latin.schema)).repartition(4)
    model = langid.train(docs)
    assert model.false_rate.max() < 0.1 and model.params.slots > langid.LangParams().slots and model.bits.dtype.itemsize == 1
    ask = spark.createDataFrame([(i, t) for i, t in enumerate(taught)] + [(1000 + i, text()) for i in range(50)], "doc_id long, text string").repartition(4)
    rows = langid.identify(ask, model).collect()
    assert all(r.lang_pred == "zz" and r.cover > 0.9 for r in rows if r.doc_id < 1000)
    assert all(r.cover < 0.35 for r in rows if r.doc_id >= 1000)
    assert {r.doc_id for r in langid.keep_identified(ask, model).collect()} == set(range(300))


def test_filter_of_too_many_bytes_is_refused(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "en")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="most_bytes"):
        langid.train(docs, langid.LangParams(most_bytes=1000))


@pytest.mark.parametrize("langs", [3, 12, 20, 70])
def test_words_of_any_width(spark, langs):
    rows = [(i, " ".join(f"{chr(0x3400 + i * 40 + a)}{chr(0x3400 + i * 40 + a + 1)}{chr(0x3400 + i * 40 + a + 2)}" for a in range(30)), f"l{i:02d}") for i in range(langs)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.LangParams(slots=1 << 17))
    assert model.bits.shape == (1 << 17, 3 * (2 if langs > 64 else 1))
    got = langid.identify(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {r[0]: r[2] for r in rows}


@pytest.mark.parametrize("kind", ["null ids, equal rows", "null ids", "one id"])
def test_mixture_of_rows_without_ids_of_their_own(spark, kind):
    n, rate = 5000, 1.7
    of = {"null ids, equal rows": (F.lit(None), F.lit("same")), "null ids": (F.lit(None), F.col("id").cast("string")), "one id": (F.lit(7), F.col("id").cast("string"))}[kind]
    docs = spark.range(n).select(of[0].cast("long").alias("doc_id"), of[1].alias("text"), F.lit("s").alias("source"), F.create_map(F.lit("a"), F.lit(1)).alias("m")).union(spark.range(1).select(F.lit(99_999).cast("long"), F.lit("x"), F.lit("s"), F.create_map(F.lit("a"), F.lit(1))))
    got = mixing.mix(docs, size=rate).cache()
    total = got.count()
    assert abs(total - n * rate) < 3 * math.sqrt(n * rate) + 5
    per = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) == 8 and max(r["count"] for r in per) < 1.3 * total / 8
    assert got.select("shuffle_key").distinct().count() == total
    if kind != "null ids, equal rows":
        times = {r["text"]: r["count"] for r in got.groupBy("text").count().collect()}
        never = n + 1 - len(times)
        assert abs(never / n - math.exp(-rate)) < 0.03 and max(times.values()) < 15
    assert sorted(got.select("shuffle_key").collect()) == sorted(mixing.mix(docs.repartition(3), size=rate).select("shuffle_key").collect())


def test_rows_with_ids_are_drawn_as_before(spark):
    """Rows that have no id of their own change nothing for those that have."""
    docs = spark.createDataFrame([(i, "s") for i in range(300)], "doc_id long, source string")
    beside = docs.union(spark.createDataFrame([(None, "s"), (None, "s"), (500, "s"), (500, "s")], docs.schema))
    taken = lambda df: {(r.doc_id, r.copy_no, r.shuffle_key) for r in df.collect() if r.doc_id is not None and r.doc_id < 300}
    alone = taken(mixing.mix(docs))
    assert alone and taken(mixing.mix(beside)) == alone
    assert mixing.mix(docs.filter("false")).count() == 0
