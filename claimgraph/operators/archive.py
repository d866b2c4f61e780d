"""Stores that are kept up from run to run: the archive of claims, the labels of reviews, the history of quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.dates import parse_date
from claimgraph.operators import state
from claimgraph.operators.keyed_store import KeyedStore

#: What a capture sees, and what a review has settled of it.
REVIEWED = ("claim_type", "denominator_stated", "topic", "entity")
SEEN = ("headline", "date", "min_tier", "max_tier", "auto_labelled", "source")
ARCHIVE = "url string, headline string, entity string, date string, claim_type string, denominator_stated string, topic string, min_tier int, max_tier int, reviewed boolean, auto_labelled boolean, source string, last_seen date, first_seen date, captured date, outcome string, outcome_note string, outcome_date date"
DEFAULTS = {"headline": "", "entity": "", "date": "", "claim_type": "unclassified", "denominator_stated": "?", "topic": ""}


def first_url(sources: Column) -> Column:
    """The first url of an item's sources that isn't empty; null if there is none."""
    return F.get(F.filter(F.transform(sources, lambda s: s["url"]), lambda u: F.coalesce(u != "", F.lit(False))), F.lit(0))


def observed(items: DataFrame, today: str | Column, order: Sequence[str | Column]) -> DataFrame:
    """A row for each url of ``items`` (headline, entity, date, claim_type, denominator_stated, topic, reviewed, auto_labelled, sources): what a capture of them sees.

    Items stand in ``order``. The last of a url is what was seen of it; what a review settles is taken from the last that
    is reviewed, if one is; the claim's day is that of the first, or today where its date can't be read. Items without
    a url are passed over. Of a url's items three at the most are held at a time.
    """
    day = (F.lit(today) if isinstance(today, str) else today).cast("date")
    said = {c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()}
    tiers = F.filter(F.transform("sources", lambda s: s["source_tier"].cast("int")), lambda t: F.coalesce(t != 0, F.lit(False)))
    row = F.struct(*[v.alias(c) for c, v in said.items()], F.array_min(tiers).alias("min_tier"), F.array_max(tiers).alias("max_tier"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.coalesce("auto_labelled", F.lit(False)).alias("auto_labelled"), F.coalesce(F.get("sources", F.lit(0))["name"], F.lit("")).alias("source"))
    rows = items.select(first_url(F.col("sources")).alias("url"), row.alias("row"), F.struct(*order).alias("place")).filter("url IS NOT NULL")
    one = rows.groupBy("url").agg(F.min_by("row", "place").alias("first"), F.max_by("row", "place").alias("last"), F.max_by("row", F.when(F.col("row.reviewed"), F.col("place"))).alias("settled"))
    first, last, settled = F.col("first"), F.col("last"), F.col("settled")
    by_review = [F.when(settled.isNotNull(), settled[c]).otherwise(last[c]).alias(c) for c in REVIEWED]
    return one.select("url", *[last[c].alias(c) for c in SEEN], *by_review, settled.isNotNull().alias("reviewed"), day.alias("today"), F.coalesce(parse_date(first["date"]).cast("date"), day).alias("claimed"))


def capture(store: KeyedStore, items: DataFrame, today: str | Column, order: Sequence[str | Column]) -> KeyedStore:
    """The archive after ``items`` were seen; its schema is ARCHIVE and its key the url.

    A claim that is new is first seen on its own day, captured today, without an outcome. Of one that is there, what was
    seen is brought up to date; first_seen, captured and the outcome stay whatever comes; and what a review has settled
    stays, unless the new item is reviewed as well.
    """

    def combine(old: Column, new: Column) -> Column:
        keeps = F.coalesce(old["reviewed"], F.lit(False)) & ~new["reviewed"]
        fields = {c: new[c] for c in ("url", *SEEN)}
        fields |= {c: F.when(keeps, old[c]).otherwise(new[c]) for c in REVIEWED}
        fields |= {"reviewed": keeps | new["reviewed"], "last_seen": new["today"]}
        fields |= {c: F.when(old.isNull(), v).otherwise(old[c]) for c, v in (("first_seen", new["claimed"]), ("captured", new["today"]), ("outcome", F.lit("")), ("outcome_note", F.lit("")), ("outcome_date", F.lit(None).cast("date")))}
        return F.struct(*[fields[c].alias(c) for c in store.schema.names])

    return store.merge(observed(items, today, order), combine)


def settle(store: KeyedStore, outcomes: DataFrame) -> KeyedStore:
    """The archive after ``outcomes`` (url, outcome, outcome_note, outcome_date) were entered; urls that it doesn't have are passed over."""
    own = ("outcome", "outcome_note", "outcome_date")
    return store.merge(outcomes.select("url", *own), lambda old, new: F.when(old.isNotNull(), F.struct(*[(new if c in own else old)[c].alias(c) for c in store.schema.names])))


def keep_reviews(store: KeyedStore, items: DataFrame, order: Sequence[str]) -> KeyedStore:
    """The store of labels (a row for each url) after the items' labels were put into it, as by ``state.harvest``; only urls that are labelled in ``items`` are touched."""
    labelled = state.labelled(items, store.schema, order)
    return store.merge(labelled, lambda old, new: state.merged_label(old, new, store.schema))


HISTORY = "date date, symbol string, price double"


def keep_quotes(store: KeyedStore, quotes: DataFrame, most: int = 400) -> KeyedStore:
    """The history (keys date and symbol) with the quotes (date, symbol, price, stale) of today; a stale quote is no observation. Only the last ``most`` dates stay.

    Of several quotes of a date and symbol the highest price stays. The dates are as many as days; the rest is not read.
    """
    fresh = quotes.filter("NOT coalesce(stale, false)").groupBy("date", "symbol").agg(F.max("price").alias("price"))
    dates = store.rows().select("date").union(fresh.select("date")).distinct()
    last = dates.orderBy(F.desc("date")).limit(most)
    gone = store.rows().join(last, "date", "left_anti").select("date", "symbol", F.lit(None).cast("double").alias("price"), F.lit(True).alias("gone"))
    new = fresh.join(last, "date", "left_semi").withColumn("gone", F.lit(False)).unionByName(gone)
    return store.merge(new, lambda old, new: F.when(~new["gone"], F.struct(*[new[c].alias(c) for c in store.schema.names])))
