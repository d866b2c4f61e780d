"""Totals and tables that tell how a board stands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgraph.operators import rules as L


def tier_range(sources: Column) -> Column:
    """struct<min_tier, max_tier> of an item's sources; nulls without any."""
    tiers = F.filter(F.transform(sources, lambda s: s["source_tier"]), lambda x: x.isNotNull())
    return F.struct(F.array_min(tiers).alias("min_tier"), F.array_max(tiers).alias("max_tier"))


def outcome_histogram(rows: DataFrame, outcome: str) -> DataFrame:
    """outcome, n: blank outcomes as '(not scored)', most first."""
    name = F.coalesce(F.nullif(outcome, F.lit("")), F.lit("(not scored)"))
    return rows.groupBy(name.alias("outcome")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "outcome")


def unresolvable_share(rows: DataFrame, outcome: str) -> DataFrame:
    """scored, unresolvable, share: of the claims that have an outcome; the share is null if none has."""
    told = F.coalesce(F.col(outcome), F.lit(""))
    sums = rows.agg(F.count_if(told != "").alias("scored"), F.count_if(told == "unresolvable").alias("unresolvable"))
    return sums.withColumn("share", F.round(F.try_divide("unresolvable", "scored"), 4))


def urgent_counts(alerts: DataFrame) -> DataFrame:
    """alerts, p1, p2, duties: how many there are, of the two highest priorities, and that shift a duty."""
    return alerts.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("priority") == 1).alias("p1"), F.count_if(F.col("priority") == 2).alias("p2"), F.count_if("is_duty").alias("duties"))


def reader_families(readings: DataFrame, item: str, reader: str) -> DataFrame:
    """item, families: how many independent families of readers judged it; what stands behind a reader's colon is a size of the same one."""
    return readings.groupBy(item).agg(F.countDistinct(F.regexp_replace(reader, r"[:].*$", "")).alias("families"))


def model_answers(ids: DataFrame, answers: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """ids with a struct of each model's answer, named as the model; null where it has none."""
    out = ids
    for name, df in answers.items():
        out = out.join(df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)), key, "left")
    return out


def model_scores(joined: DataFrame, baseline: str, model: str) -> DataFrame:
    """One row for a model against the baseline, over what both answered: n, agree, false_positives, false_negatives, cited, mean and total seconds."""
    a, b = F.col(f"{baseline}.duty"), F.col(f"{model}.duty")
    cited = F.coalesce(F.col(f"{model}.reference"), F.lit("")) != ""
    sec = F.col(f"{model}.sec")
    both = joined.filter(F.col(baseline).isNotNull() & F.col(model).isNotNull())
    return both.agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("n"), F.count_if(a == b).alias("agree"), F.count_if(b & ~a).alias("false_positives"), F.count_if(a & ~b).alias("false_negatives"), F.count_if(cited).alias("cited"), F.round(F.avg(sec), 4).alias("mean_sec"), F.round(F.sum(sec), 4).alias("total_sec"))


def strongest_moves(quotes: DataFrame, most: int = 3) -> DataFrame:
    """list, rank, symbol, change: the deepest falls of 3 percent or more, the highest rises of 5 or more, and macro moves by size; at most ``most`` each.

    ``quotes``: symbol, kind (equity or index), change_pct. A quote without a change is in none.
    """
    change = F.round("change_pct", 2)
    band = L.market_band(F.col("change_pct"))
    name = F.when((F.col("kind") == "index") & L.macro_move(F.col("change_pct")), "macro").when((F.col("kind") == "equity") & band.isin("critical", "warning"), "drops").when((F.col("kind") == "equity") & band.isin("breakout", "surge"), "rallies")
    rows = quotes.select("symbol", change.alias("change"), name.alias("list")).filter("list is not null")
    order = F.when(F.col("list") == "drops", F.col("change")).when(F.col("list") == "rallies", -F.col("change")).otherwise(-F.abs("change"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(order, "symbol")))
    return ranked.filter(F.col("rank") <= most)


def market_chip(entity: Column, known: Column, ticker: Column, uncovered: Column, quote: Column) -> Column:
    """What is told of an entity's security: '' of one that isn't known or has no quote, 'listed, not covered here', 'no listed security', or 'quote'."""
    listed = F.coalesce(ticker, F.lit("")) != ""
    return F.when((F.coalesce(entity, F.lit("")) == "") | ~known, "").when(~listed & (F.coalesce(uncovered, F.lit("")) != ""), "listed, not covered here").when(~listed, "no listed security").when(quote.isNull(), "").otherwise("quote")


#: Texts meet by their beginnings of so many characters.
BEGINNING = 3


def containing(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """a, b: the distinct texts of both sides of which one contains the other; empty texts contain and are contained by none.

    A text that is contained has its beginning among the short runs of characters of the other: both sides meet by
    those, in an equi-join each way, and what meets is looked at. Neither side has to be small.
    """
    one = lambda df, c: df.select(F.col(c).alias(c)).filter(F.col(c) != "").distinct()
    begins = lambda c: F.substring(c, 1, BEGINNING)

    def runs(c: str) -> Column:
        each = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(n))) for n in range(1, BEGINNING + 1)]  # noqa: B023
        return F.array_distinct(F.concat(*each))

    def inside(small: DataFrame, s: str, large: DataFrame, g: str) -> DataFrame:
        met = large.select(g, F.explode(runs(g)).alias("run")).join(small.select(s, begins(s).alias("begins")), F.col("run") == F.col("begins"))
        return met.filter(F.col(g).contains(F.col(s))).select(a, b)

    x, y = one(left, a), one(right, b)
    return inside(x, a, y, b).union(inside(y, b, x, a)).distinct()


def reconciled(names: DataFrame, key: str, name: str, entities: DataFrame, filed: DataFrame) -> DataFrame:
    """key, status, tickers, reasons: whether an item's names lead to a filing, a listed security, a private company or none.

    ``names``: key and name, a row for each name of an item; ``entities``: entity, ticker, private; ``filed``: ticker. A name and an
    entity match if either contains the other, in any case.
    """
    held = entities.select(F.lower("entity").alias("e"), "entity", "ticker", "private")
    met = containing(names.select(F.lower(name).alias("low")), "low", held, "e").join(held, "e")
    has = met.join(filed.select(F.col("ticker").alias("f")).distinct(), F.col("ticker") == F.col("f"), "left")
    rows = names.select(key, F.lower(name).alias("low")).join(has, "low", "left")
    listed = F.coalesce(F.col("ticker"), F.lit("")) != ""
    sums = rows.groupBy(key).agg(F.bool_or(F.col("f").isNotNull()).alias("filing"), F.array_sort(F.collect_set(F.when(listed, F.col("ticker")))).alias("tickers"), F.array_sort(F.collect_set(F.when(~listed & F.col("private").isNotNull(), F.concat_ws(": ", "entity", "private")))).alias("reasons"))
    status = F.when(F.col("filing"), "AUDITABLE_PUBLIC_FILING").when(F.size("tickers") > 0, "MAPPED_PUBLIC_SECURITY").when(F.size("reasons") > 0, "PRIVATE_UNCHECKABLE").otherwise("UNCLASSIFIED_SOURCE")
    return sums.select(key, status.alias("status"), F.array_join("tickers", ", ").alias("tickers"), F.array_join("reasons", "; ").alias("reasons"))


def with_status(rows: DataFrame, status: str | None = None) -> DataFrame:
    """The rows of one status, or all."""
    return rows if status is None else rows.filter(F.col("status") == status)


def symbols(*lists: DataFrame) -> DataFrame:
    """symbol: each symbol of the lists once."""
    out = lists[0].select("symbol")
    for more in lists[1:]:
        out = out.union(more.select("symbol"))
    return out.filter("symbol <> ''").distinct()


def ordered_sources(rows: DataFrame, item: str, place: str) -> DataFrame:
    """item, names (each once, in order of place), tiers (each once, ascending)."""
    held = rows.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(place, "name"))).alias("x"), F.array_sort(F.collect_set("tier")).alias("tiers"))
    return held.select(item, F.array_distinct(F.transform("x", lambda r: r["name"])).alias("names"), "tiers")


def money(value: Column, prefix: str = "$", places: int = 2) -> Column:
    return F.concat(F.lit(prefix), F.format_number(value, places))


def signed_percent(change: Column) -> Column:
    """+1.20% or -0.50%; '' without a change."""
    return F.when(change.isNotNull(), F.format_string("%+.2f%%", change)).otherwise("")


def clock_text(stamp: Column) -> Column:
    """The T between a date's digits and a time's as a space; other letters stay."""
    return F.regexp_replace(stamp, r"(?<=[0-9])T(?=[0-9])", " ")


def market_digest(quotes: DataFrame, articles: DataFrame, most: int = 3) -> DataFrame:
    """list, rank, name, change: the strongest falls and rises, and the first article of each category of trends (without a change).

    ``articles``: category, place, title; those without a title don't count.
    """
    moves = strongest_moves(quotes, most).filter("list <> 'macro'").select("list", "rank", F.col("symbol").alias("name"), "change")
    first = articles.filter("title <> ''").groupBy("category").agg(F.min_by("title", "place").alias("title"))
    shown = first.select(F.lit("article").alias("list"), F.lit(1).alias("rank"), F.concat_ws(": ", "category", "title").alias("name"), F.lit(None).cast("double").alias("change"))
    return moves.unionByName(shown)


def sorted_map(held: Column) -> Column:
    """A map with its keys in order, so that equal maps are written alike."""
    return F.map_from_entries(F.array_sort(F.map_entries(held)))
