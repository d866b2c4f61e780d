"""Evidence without the sentences that several articles have, kept up as articles come, change and go.

Two stores: which articles have a sentence, by the sentence's digest, and the articles with their sentences, each marked
if another article has it too. An update reads and writes the parts of both that its articles touch. A sentence's mark
turns over where the number of its articles passes between one and two, so that at most one article that isn't itself
updated has to be marked anew for it, however many articles have it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions import text as T
from claimgraph.operators import keyed_store
from claimgraph.operators.keyed_store import Arriving, KeyedStore
from claimgraph.storage import Table

SPAN = "struct<offset:int,sentence:string,key:binary,repeated:boolean>"
ARTICLE = f"url string, content_hash string, spans array<{SPAN}>, evidence_hash string"
PLACE = "key binary, url string"


@dataclass(frozen=True)
class SentenceView:
    places: KeyedStore
    articles: KeyedStore

    def evidence(self) -> DataFrame:
        """url, content_hash, spans (array<struct<offset, sentence>>, those of no other article), dropped (how many others have), evidence_hash."""
        return self.articles.rows().select("url", "content_hash", kept(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["repeated"])).alias("dropped"), "evidence_hash")


def kept(spans: Column) -> Column:
    return F.transform(F.filter(spans, lambda s: ~s["repeated"]), lambda s: F.struct(s["offset"].alias("offset"), s["sentence"].alias("sentence")))


def marked(spans: Column, shared: Column) -> Column:
    """The spans, each with whether its place is among ``shared``, which has places in order or is null: the places between two of them are told at once."""
    ends = F.concat(F.coalesce(shared, F.array().cast("array<int>")), F.array(F.size(spans)))
    gap = lambda xs, i: F.get(xs, i) - F.when(i > 0, F.get(xs, i - 1) + 1).otherwise(0)
    flags = T.let(ends, lambda xs: F.slice(F.flatten(F.transform(xs, lambda _, i: F.concat(F.array_repeat(F.lit(False), gap(xs, i)), F.array(F.lit(True))))), F.lit(1), F.size(spans)))
    return T.let(flags, lambda told: F.transform(spans, lambda s, i: F.struct(s["offset"].alias("offset"), s["sentence"].alias("sentence"), s["key"].alias("key"), F.get(told, i).alias("repeated"))))


def created(spark: SparkSession, folder: str, buckets: int = 64) -> SentenceView:
    return SentenceView(keyed_store.created(spark, f"{folder}/places", ["key", "url"], PLACE, buckets, by=["key"]), keyed_store.created(spark, f"{folder}/articles", ["url"], ARTICLE, buckets))


def opened(spark: SparkSession, folder: str) -> SentenceView:
    return SentenceView(keyed_store.opened(spark, f"{folder}/places"), keyed_store.opened(spark, f"{folder}/articles"))


def first_by_offset(articles: DataFrame) -> DataFrame:
    """url, content_hash, spans (array<struct<offset, sentence, key>>, by offset): of the sentences of ``articles`` (url, content_hash, spans of sentence and offset) that are the same but for case and white space, the first in each article."""
    keyed = lambda s: F.struct(F.unhex(F.substring(F.sha2(T.sentence_key(s["sentence"]), 256), 1, 32)).alias("key"), s["offset"].cast("int").alias("offset"), s["sentence"].alias("sentence"))
    said = F.array_sort(F.transform(F.filter("spans", lambda s: s["sentence"].isNotNull()), keyed))
    # An article is one row, and its sentences stay in it: equal ones stand next to each other once they are sorted.
    first = T.let(said, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x["key"] != F.get(xs, i - 1)["key"])))
    spans = F.array_sort(F.transform(first, lambda x: F.struct(x["offset"].alias("offset"), x["sentence"].alias("sentence"), x["key"].alias("key"))))
    return articles.filter("url IS NOT NULL").select("url", "content_hash", F.coalesce(spans, F.array().cast("array<struct<offset:int,sentence:string,key:binary>>")).alias("spans"))


def update(view: SentenceView, added: DataFrame | None = None, removed: DataFrame | None = None) -> SentenceView:
    """The view after articles are ``added`` (one row a url: content_hash, spans of sentence and offset), in place of what it had of their urls, and others ``removed`` (url).

    An update that died is to be run again as it was: what it had written by then is written over with the same.
    """
    spark = view.articles.spark
    added = spark.createDataFrame([], "url string, content_hash string, spans array<struct<sentence:string,offset:int>>") if added is None else added
    removed = spark.createDataFrame([], "url string") if removed is None else removed
    fresh = Table(first_by_offset(added))
    gone = Table(removed.select("url").filter("url IS NOT NULL").distinct().join(fresh.df, "url", "left_anti"))
    keys = F.col("spans.key").alias("keys")
    pairs = lambda df: df.select(F.explode("keys").alias("key"), "url")
    before, after = pairs(view.articles.part(fresh.df.select("url").union(gone.df), [keys])), pairs(fresh.df.select("url", keys))
    steps = Table(before.join(after, ["key", "url"], "left_anti").withColumn("step", F.lit(-1)).union(after.join(before, ["key", "url"], "left_anti").withColumn("step", F.lit(1))))
    places = view.places.merge(Arriving(steps.df), lambda old, new: F.when(new["step"] > 0, F.struct(new["key"].alias("key"), new["url"].alias("url"))))
    # How many articles have each sentence that came or went, now; and before, told from what came and went.
    held = Table(places.part(after.select("key").union(steps.df.select("key"))))
    counts = Table(held.df.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    turned = steps.df.groupBy("key").agg(F.sum("step").alias("by")).join(counts.df, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), "by").filter("(n > 1) <> (n - by > 1)").select("key", (F.col("n") > 1).alias("repeated"))
    others = held.df.join(turned, "key").join(fresh.df.select("url"), "url", "left_anti")
    turns = Table(others.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("key", "repeated"))).alias("turns")))
    # Which of an article's sentences others have too, by place, so that the sentences themselves aren't sent about.
    shared = fresh.df.select("url", F.posexplode(keys).alias("pos", "key")).join(counts.df.filter("n > 1"), "key").groupBy("url").agg(F.sort_array(F.collect_list("pos")).alias("shared"))
    span = lambda s: F.struct(s["offset"].alias("offset"), s["sentence"].alias("sentence"), s["key"].alias("key"), F.lit(False).alias("repeated"))
    whole = fresh.df.select("url", "content_hash", F.transform("spans", span).cast(f"array<{SPAN}>").alias("spans"), F.lit(None).cast("map<string,boolean>").alias("turns"), F.lit(False).alias("gone"))
    rest = turns.df.select("url", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast(f"array<{SPAN}>").alias("spans"), "turns", F.lit(False).alias("gone"))
    dead = view.articles.part(gone.df, []).select("url", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast(f"array<{SPAN}>").alias("spans"), F.lit(None).cast("map<string,boolean>").alias("turns"), F.lit(True).alias("gone"))

    def combine(old: Column, new: Column, beside: Column) -> Column:
        turn = lambda s: F.struct(s["offset"].alias("offset"), s["sentence"].alias("sentence"), s["key"].alias("key"), F.coalesce(F.try_element_at(new["turns"], s["key"]), s["repeated"]).alias("repeated"))
        said = F.when(new["spans"].isNotNull(), marked(new["spans"], beside["shared"])).otherwise(F.transform(old["spans"], turn))
        content = F.when(new["spans"].isNotNull(), new["content_hash"]).otherwise(old["content_hash"])
        digest = F.when(F.coalesce(content, F.lit("")) != "", T.evidence_hash(content, kept(said)))
        return F.when(~new["gone"], F.struct(new["url"].alias("url"), content.alias("content_hash"), said.alias("spans"), digest.alias("evidence_hash")))

    articles = view.articles.merge(Arriving(whole.unionByName(rest).unionByName(dead), shared), combine)
    for table in (fresh, gone, steps, held, counts, turns):
        table.drop()
    return SentenceView(places, articles)
