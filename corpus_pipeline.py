"""A corpus pipeline of five stages over ``documents``; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm import decontam, langid, mixing, ngram_join, pii
from claimgraph.llm.common import cut, quoted, whole
from claimgraph.storage import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't in a learnt language go; the model learns from those that have one named and are not held out.

    Rejected are null and empty texts, texts without a letter, and texts of whose n-grams their predicted language has too
    few. Repeated rows stay or go together; long texts are read whole; without any named language, and of an empty table, nothing stays.
    """
    return langid.keep_identified(docs, langid.train(docs.filter(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row stays: that of the smallest id, one without an id only if none has one.

    Repeated rows and rows without an id are copies like others. Rows of one id with other texts are documents of their
    own. Null and blank texts are in no group, but rows that repeat an id and its text leave one. An empty table gives an empty one.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("repeated"))
    if odd.isEmpty():
        groups = ngram_join.near_duplicates(docs)
        gone = groups.filter("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
    # Rows that their id doesn't tell apart are told apart by a digest of their text as well. Each row that is left is then
    # numbered, so that no name of one can be that of another.
    rows = docs.select("doc_id", "text", whole(docs).alias("row"))
    alone = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = rows.filter(~alone).join(odd.filter("repeated is not null"), F.col("doc_id") == F.col("repeated"), "left")
    digest = F.when(F.col("doc_id").isNull() | F.col("repeated").isNotNull(), F.sha2("text", 256))
    first = marked.groupBy("doc_id", digest.alias("digest")).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    one = cut(first.select(F.monotonically_increasing_id().alias("name"), "doc_id", "digest", "row"))
    groups = ngram_join.near_duplicates(one.select(F.col("name").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("name"), "component_id")
    ids = one.select("name", "doc_id", "digest").join(groups, "name")
    best = ids.groupBy("component_id").agg(F.min_by("name", F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("name"))
    return one.join(best, "name", "left_semi").select("row.*").unionByName(rows.filter(alone).select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a window of a benchmark item go.

    Rows are judged by their text alone, so repeated rows and rows without an id go or stay together; null and empty texts
    stay, as they repeat nothing. With an empty benchmark all stay; an empty table gives an empty one.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean(docs, bench)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and n_chars follows; every row stays, repeated ones too.

    Null and empty texts and texts without personal data stay as they are; an empty table gives an empty one.
    """
    return pii.redacted(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares, as many rows as there are on average, shuffled.

    Each row is taken a number of times drawn from a digest of its id, so repeated rows, and rows without an id, are taken
    alike; a null source is one of its own, and texts are not looked at. An empty table gives an empty one.
    """
    return mixing.mix(docs)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminated), ("pii", without_pii), ("mixing", mixed)]

#: Language identification and the span classifier are fitted models, which SQL can't express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written below spark.checkpoint.dir and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
