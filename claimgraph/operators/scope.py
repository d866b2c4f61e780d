"""What is in scope: vocabularies of feeds and gazettes, routine notices, and the facets of a board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.dates import date_in_url, page_date, too_old

from claimgraph.operators.relational import top_per, unused

# The words that put a feed's title in scope, those that put a gazette's notice in scope, and routine notices.
FEED_SCOPE = (
    r"\b(a\.?i\.?|artificial intelligence|machine learning|algorithm\w*|"
    r"large language model|LLM|chatbot|generative|OpenAI|Anthropic|DeepMind|"
    r"Nvidia|data cent(?:re|er)|compute|semiconductor|chip\w*|automat\w*)\b"
)
GAZETTE_SCOPE = (
    r"\b(artificial intelligence|machine learning|algorithm\w*|deepfake|watermark\w*|"
    r"transparency|foundation model|frontier model|high-risk|automated decision|ADM|"
    r"data centre|compute|semiconductor|export control|GPU|Nvidia|OpenAI|Anthropic|DeepMind)\b"
)
ROUTINE = (
    r"\b(Unified Agenda of Federal Regulatory|Introduction to the Unified Agenda)\b",
    r"\b(Renewal of the Innovation Advisory|Innovation Advisory Committee Meeting)\b",
    r"\b(Community Outreach Office Locations|Substance Use Primary Prevention Month|Purple Heart Day)\b",
    r"\b(Airworthiness Directives|Drug Interdiction Assistance|Military Spouse Commission)\b",
)
# The search terms of the quick filters.
CHIPS = {"all": "", "models": "model", "hardware": "energy", "regulation": "regulation", "labour": "cost"}

#: Any case; letters of any script make words.
FLAGS = "(?iU)"


def said(*texts: Column) -> Column:
    """The texts with a space between; null ones are empty."""
    return F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in texts])


def in_feed_scope(title: Column) -> Column:
    return said(title).rlike(FLAGS + FEED_SCOPE)


def in_gazette_scope(title: Column, summary: Column) -> Column:
    return said(title, summary).rlike(FLAGS + GAZETTE_SCOPE)


def is_routine(title: Column, summary: Column) -> Column:
    """True for administrative notices, which nobody has to be asked about."""
    return said(title, summary).rlike(FLAGS + "|".join(ROUTINE))


def scoped_top(items: DataFrame, feed: str, title: str, general: Column, order: Sequence[str | Column], most: int = 6) -> DataFrame:
    """The first ``most`` items of each feed, with rank; titles of general feeds out of scope are left out before they are counted."""
    return top_per(items.filter(~F.coalesce(general, F.lit(False)) | in_feed_scope(F.col(title))), [feed], order, most)


def faceted(items: DataFrame, term: str = "", topics: Sequence[str] | None = None, tiers: Sequence[int] | None = None, conflicts_only: bool = False) -> DataFrame:
    """Items (search, topics, tiers, conflict, ...) that meet all facets: the term, any case, any of the topics, any of the tiers, a conflict if asked.

    An item without topics has the topic ''. None stands for all topics or tiers; an item without a tier meets no tier at all.
    """
    wanted = term.strip().lower()
    meets = F.size(F.coalesce("tiers", F.array().cast("array<int>"))) > 0
    if tiers is not None:
        meets &= F.arrays_overlap(F.col("tiers").cast("array<int>"), F.array(*map(F.lit, tiers)).cast("array<int>"))
    if topics is not None:
        own = F.when(F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0, F.col("topics")).otherwise(F.array(F.lit("")))
        meets &= F.arrays_overlap(own, F.array(*map(F.lit, topics)).cast("array<string>"))
    if wanted:
        meets &= F.contains(F.lower("search"), F.lit(wanted))
    if conflicts_only:
        meets &= F.coalesce("conflict", F.lit(False))
    return items.filter(meets)


def chip(items: DataFrame, name: str, topics: Sequence[str] | None = None, tiers: Sequence[int] | None = None, conflicts_only: bool = False) -> DataFrame:
    """A quick filter: 'all' lifts the term and the topics, any other sets its term beside the other facets."""
    return faceted(items, CHIPS[name], None if name == "all" else topics, tiers, conflicts_only)


def fresh_items(items: DataFrame, feed_date: Column, url: Column, html: Column, today: Column, limit: Column, asks: Column) -> DataFrame:
    """``items`` that aren't too old, with ``effective_date``: by what the feed says, and where ``asks`` is true again by the article's own date.

    That is the day the page says, else the one in its URL, else the feed's. An item of an aggregator is as old as what
    it links to, however lately it was put in. Ages are in days and an item of just ``limit`` stays; one without any
    date stays.
    """
    age = lambda day: F.datediff(today, day)
    feed = feed_date.cast("date")
    first = items.filter(~too_old(age(feed), limit))
    own = F.when(asks, F.coalesce(page_date(html), date_in_url(url)))
    # The day is judged where it is found: a filter behind would be pushed below, and the page read again in it.
    name = unused("day", items)
    days = F.filter(F.array(F.coalesce(own, feed)), lambda day: ~too_old(age(day), limit))
    return first.select("*", F.explode(days).alias(name)).withColumn("effective_date", F.col(name)).drop(name)
