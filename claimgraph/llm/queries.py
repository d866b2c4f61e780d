"""Queries of the training-data operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgraph.llm import chat, decontam, knn, langid, lm, mixing, ngram_join, pii, quality, repair, suffix, tokens, upsert


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_pii": lambda spark, d: pii.op1(table(spark, d, "documents")),
    "op2_topk_search": lambda spark, d: knn.op2(table(spark, d, "embeddings")),
    "op3_token_counts": lambda spark, d: tokens.op3(table(spark, d, "documents")),
    "op4_lm_scores": lambda spark, d: lm.op4(table(spark, d, "documents")),
    "op5_suffix_dedup": lambda spark, d: suffix.op5(table(spark, d, "documents")),
    "op6_ngram_join": lambda spark, d: ngram_join.op6(table(spark, d, "documents")),
    "op7_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")),
    "op8_langid": lambda spark, d: langid.op8(table(spark, d, "documents")),
    "op9_quality": lambda spark, d: quality.op9(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_decontam": lambda spark, d: decontam.op10(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op11_upsert": lambda spark, d: upsert.op11(table(spark, d, "clients"), table(spark, d, "client_changes")),
    "op12_chat": lambda spark, d: chat.op12(table(spark, d, "conversations")),
    "op13_repair": lambda spark, d: repair.op13(table(spark, d, "conversations")),
}

ORACLES = {
    "op2_topk_search": knn.ORACLE,
    "op4_lm_scores": lm.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op7_mixing": mixing.oracle(),
    "op10_decontam": decontam.ORACLE,
}
