"""Relational building blocks: ordered first-wins, ranks, ordered dimension matches, upserts and change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from claimgraph.functions.urls import suffixes
from claimgraph.storage import Table, stored

#: Registries are held in code or small files; up to so many rows they are broadcast.
MOST_BROADCAST = 10_000


def dim(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A registry as a DataFrame, in list order."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= MOST_BROADCAST else df


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores before it as make it no column's of the tables."""
    while any(name in t.columns for t in tables):
        name = f"_{name}"
    return name


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    nth = unused("nth", df)
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(nth) == 1).drop(nth)


def top_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank; Spark limits the groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def suffix_match(df: DataFrame, host: str, registry: DataFrame) -> DataFrame:
    """Left join on 'host is the domain or ends in .domain', first in registry order (domain, ord, ...): an equi-join on the host's suffixes."""
    hosts = df.select(host).distinct()
    named = hosts.select(host, F.explode(suffixes(F.col(host))).alias("domain")).join(registry, "domain")
    value = [c for c in registry.columns if c not in ("domain", "ord")]
    best = named.groupBy(host).agg(F.min_by(F.struct(*value), "ord").alias("m")).select(host, "m.*")
    return df.join(best, host, "left")


def first_containing(text: Column, rows: Sequence[tuple[str, str]], default: str) -> Column:
    """The value of the first part, in list order, that the text contains."""
    out = F
    for part, value in rows:
        out = out.when(text.contains(part), value)
    return out.otherwise(default)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: Sequence[str], refresh: Sequence[str], locked: Column | None = None, lockable: Sequence[str] = ()) -> DataFrame:
    """``old`` with ``new`` merged in. ``keep`` columns hold their old value, ``refresh`` take the new one where there is one; of locked rows (a condition on ``o``), lockable ones stay too."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, key, "full")
    hold = locked if locked is not None else F.lit(False)
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(F.coalesce(hold, F.lit(False)), F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")) if c in lockable else F.coalesce(f"n.{c}", f"o.{c}")
    return both.select(key, *[pick(c).alias(c) for c in [*keep, *refresh]])


def changed(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digest is known and differs."""
    return new.select(key, digest).alias("n").join(old.select(key, digest).alias("o"), key).filter(F.col(f"n.{digest}") != F.col(f"o.{digest}")).select(key, F.col(f"n.{digest}"))


#: The low bits of monotonically_increasing_id number the rows of a partition.
ROW_BITS = 33


def with_previous(df: DataFrame, value: Column, order: Sequence[str | Column], name: str = "previous", first: str = "is_first") -> DataFrame:
    """``df`` with the value of the row before in one order over all rows, and whether a row is the first.

    Rows are sorted by ranges; each range's first row gets what the range before it ended with, a value for each range by
    way of the driver. ``order`` should tell all rows apart: rows alike in it stand in one range, in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = stored(ordered.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), value.alias("value"), F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", ROW_BITS).cast("int")
    held = ranged.withColumn("part", part)
    ends = sorted(held.groupBy("part").agg(F.max_by(F.struct("value"), "at").alias("last")).collect(), key=lambda r: r["part"])
    carried = [(b["part"], a["last"][0]) for a, b in zip(ends, ends[1:], strict=False)]
    kind = ranged.schema["value"].dataType
    before = df.sparkSession.createDataFrame(carried, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("carried", kind)]))
    within = Window.partitionBy("part").orderBy("at")
    opens = F.row_number().over(within) == 1
    told = held.withColumns({"opens": opens, "before": F.lag("value").over(within)}).join(F.broadcast(before), "part", "left")
    start = F.col("opens") & (F.col("part") == F.lit(ends[0]["part"] if ends else 0))
    kept = [c for c in df.columns if c not in (name, first)]
    return told.select(*[F.col(f"row.`{c}`") for c in kept], F.when(F.col("opens"), F.col("carried")).otherwise(F.col("before")).alias(name), start.alias(first))


def opening(df: DataFrame, bucket: Column, order: Sequence[str | Column], heading: str = "heading") -> DataFrame:
    """The rows of ``df`` at which, in the given order over all rows, a run of one bucket begins, and its ``heading``. A null bucket is one of its own."""
    marked = df.select(*[c for c in df.columns if c != heading], bucket.alias(heading))
    return with_previous(marked, F.col(heading), order).filter(F.col("is_first") | ~F.col(heading).eqNullSafe(F.col("previous"))).drop("previous", "is_first")


def feed_slots(items: DataFrame, feed: str, place: str, url: str, title: str, most: int = 6) -> DataFrame:
    """``items`` that are taken from their feeds: feeds in order, of each the first ``most`` by place.

    An item whose url an earlier feed has given takes no slot. One whose url its own feed has given before, or that has
    no title, takes a slot and isn't given. Items without a url (null or empty) are never the same as others. Feed and
    place tell all items apart.

    What a feed gives depends on what earlier feeds gave, so feeds are settled from the first on: in each round all take
    their slots as if the last round's givers were right, and of the feeds whose urls are contested at least one more is
    right for good. Rounds end when nothing changes, after as many as feeds wait for each other; only urls of several
    feeds are told from round to round.
    """
    u = F.nullif(F.col(url), F.lit(""))
    rows = stored(items.select(F.col(feed).alias("feed"), F.col(place).alias("place"), F.when(u.isNotNull(), F.sha2(u, 256)).alias("u"), (F.coalesce(F.col(title), F.lit("")) != "").alias("titled")))
    contested = rows.filter("u IS NOT NULL").groupBy("u").agg(F.min("feed").alias("a"), F.max("feed").alias("b")).filter("a <> b").select("u")
    shared = stored(rows.join(contested, "u", "left_semi").select("u").distinct())
    givers = None
    while True:
        fresh = rows
        if givers is not None:
            seen = givers.select(F.col("u").alias("of"), F.col("feed").alias("giver"))
            fresh = rows.join(seen, F.col("u") == F.col("of"), "left").filter("giver IS NULL OR giver >= feed").drop("of", "giver")
        taken = top_per(fresh, ["feed"], ["place"], most, "slot").drop("slot")
        now = Table(taken.filter("titled AND u IS NOT NULL").join(shared, "u", "left_semi").groupBy("u").agg(F.min("feed").alias("feed"))).df
        if now.isEmpty() if givers is None else now.exceptAll(givers).isEmpty() and givers.exceptAll(now).isEmpty():
            break
        givers = now
    given = taken.filter("titled").withColumn("nth", F.when(F.col("u").isNull(), 1).otherwise(F.row_number().over(Window.partitionBy("feed", "u").orderBy("place")))).filter("nth = 1")
    wanted = given.select(F.col("feed").alias("of"), F.col("place").alias("at"))
    return items.join(wanted, (F.col(feed) == F.col("of")) & (F.col(place) == F.col("at"))).drop("of", "at")
