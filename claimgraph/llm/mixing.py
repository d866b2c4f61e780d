"""Mixing of sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import let, whole
from claimgraph.storage import stored

#: Up to so many bytes of distributions, counted first, the table of sources is broadcast; beyond it, the join is dealt by source and a part of the document's digest.
MOST_BROADCAST_BYTES = 8 << 20
#: Parts into which the rows of a source are dealt in that case.
SALTS = 64
#: Rates above this are drawn in equal parts, since exp(-rate) would be lost.
MOST_RATE = 500
#: Equal rows that one task numbers.
EQUAL_ROWS = 10_000
#: 52 bits of an MD5 digest make a uniform number that any SQL engine can repeat.
BITS = 52


def uniform(*parts):
    """A number in [0, 1) from a digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, BITS // 4), 16, 10).cast("double") / float(2**BITS)


def rates(docs: DataFrame, weights: Mapping[str, float] | None, default: float, size: float) -> DataFrame:
    """source, rate: the mean number of times that a document of the source is taken.

    A source's share of the output is its weight over the sum of the weights of the sources present; the output has
    ``size`` times the rows of the input on average. A null source is a source of its own. The documents are read once.
    """
    wrong = {k: v for k, v in [*(weights or {}).items(), ("default", default), ("size", size)] if not (math.isfinite(v) and v >= 0)}
    if wrong:
        raise ValueError(f"weights must be finite and not negative: {wrong}")
    weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in (weights or {}).items()], F.lit(float(default)))
    counted = stored(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))).withColumn("weight", weight)
    all_n, all_w = counted.agg(F.sum("n"), F.sum("weight")).first()
    if not all_w:
        return counted.filter("false").select("source", F.lit(0.0).alias("rate"))
    return counted.select("source", (F.col("weight") / F.lit(float(all_w)) * F.lit(all_n) * float(size) / F.col("n")).alias("rate"))


def cumulative(rate):
    """Poisson probabilities P(X <= k) for k = 0, 1, ... as far as 12 deviations and 30 beyond the mean: less than 2**-52 is left."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), (acc["c"] + acc["p"] * rate / k).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * rate / k)).alias("all"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step)["all"]


def named(docs: DataFrame) -> DataFrame:
    """(row, source, ident): each row with a name of its own.

    Ids alone are looked at to find those that are null or not alone. Rows of such are counted by a digest of all they
    hold, equal rows once for each task, and come out again with their numbers, a hot one's dealt over many tasks.
    """
    rows = docs.select(whole(docs).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("id"))
    plain = F.col("id").cast("string").alias("ident")
    odd = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("of")))
    if odd.isEmpty():
        return rows.select("row", "source", plain)
    alone = rows.filter("id is not null").join(odd, F.col("id") == F.col("of"), "left_anti").select("row", "source", plain)
    several = rows.join(odd, F.col("id").eqNullSafe(F.col("of")), "left_semi").withColumn("digest", F.sha2(F.to_json("row"), 256))
    kinds = several.groupBy("digest").agg(F.first("row").alias("row"), F.first("source").alias("source"), F.first("id").alias("id"), F.count(F.lit(1)).alias("n"))
    runs = kinds.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL_ROWS).cast("long")))).repartition("digest", "begin")
    each = runs.withColumn("nth", F.explode(F.sequence("begin", F.least(F.col("begin") + EQUAL_ROWS, F.col("n")) - 1)))
    name = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), "digest", F.col("nth").cast("string"))
    return alone.unionByName(each.select("row", "source", name.alias("ident")))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, default: float = 1.0, size: float = 1.0, seed: str = "mix", most_broadcast: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled; all columns of ``docs`` and copy_no (from 0), shuffle_key.

    Each row is taken X times, X being Poisson with its source's rate, found by inverting the distribution at a uniform
    number that is a digest of seed and the row's name; so a rerun takes the same rows. A row's name is its doc_id;
    where that is null or stands in several rows, also a digest of the whole row and its number among equal rows, so
    that each of them is drawn for itself. The rows are dealt to partitions by a digest of (seed, name, copy_no) and
    sorted by it there. Sources of weight 0 are left out; negative, infinite or missing weights raise. An empty table
    gives an empty one; text may be null, empty or long. Columns of ``docs`` that are named as the two are replaced; any
    other names will do. A rate above MOST_RATE is the sum of equal parts, each with a digest of its own; a rate below
    is one part.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    rows = named(docs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / float(MOST_RATE))).cast("int")
    table = stored(rates(docs, weights, default, size).filter("rate > 0").withColumn("parts", parts).select(F.col("source").alias("from"), "parts", cumulative(F.col("rate") / F.col("parts")).alias("cdf")))
    same = F.col("source").eqNullSafe(F.col("from"))
    if (table.agg(F.sum(F.size("cdf") * 8 + 64)).first()[0] or 0) <= most_broadcast:
        joined = rows.join(F.broadcast(table), same)
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int"))
        joined = salted.join(table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("salt") == F.col("part")))
    # The uniform number is bound before the distribution is searched, so it is worked out once.
    draw = lambda i: let(uniform(F.lit(seed), F.col("ident"), i.cast("string")), lambda u: F.size(F.filter("cdf", lambda c: c <= u)))
    times = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), draw), F.lit(0), lambda a, x: a + x)
    copies = joined.select("row", "ident", times.alias("times")).filter("times > 0").select("row", "ident", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times").cast("long") - 1)).alias("copy_no"))
    keyed = copies.select("row", "copy_no", F.md5(F.concat_ws("|", F.lit(seed), F.col("ident"), F.col("copy_no").cast("string"))).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "row.doc_id").select("row.*", "copy_no", "shuffle_key")


def oracle(weights: Mapping[str, float] | None = None, default: float = 1.0, size: float = 1.0, seed: str = "mix", docs: str = "documents", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """DuckDB SQL of ``mix``."""
    cases = "".join(f" WHEN '{k}' THEN {float(v)!r}" for k, v in (weights or {}).items())
    weight = f"CASE source{cases} ELSE {float(default)!r} END" if cases else f"{float(default)!r}"
    return f"""
WITH RECURSIVE counted AS (SELECT source, count(*) AS n, CAST({weight} AS DOUBLE) AS w FROM {docs} GROUP BY source),
rate AS (SELECT source, w / (SELECT sum(w) FROM counted) * (SELECT sum(n) FROM counted) * {float(size)!r} / n AS r FROM counted),
parted AS (SELECT source, greatest(1, CAST(ceil(r / {float(MOST_RATE)!r}) AS INTEGER)) AS parts, r / greatest(1, CAST(ceil(r / {float(MOST_RATE)!r}) AS INTEGER)) AS r FROM rate WHERE r > 0),
cdf AS (SELECT source, parts, r, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM parted
  UNION ALL SELECT source, parts, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM cdf WHERE k < ceil(r + 12 * sqrt(r) + 30)),
cdfs AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
draws AS (SELECT d.*, cs, list_transform(range(1, parts + 1), lambda i: ('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || i), 1, 13))::BIGINT / {float(2**BITS)!r}) AS us
  FROM {docs} d JOIN cdfs s ON d.source IS NOT DISTINCT FROM s.source),
timed AS (SELECT *, CAST(list_sum(list_transform(us, lambda u: len(list_filter(cs, lambda c: c <= u)))) AS BIGINT) AS times FROM draws)
SELECT {columns}, copy_no, md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy_no) AS shuffle_key
FROM (SELECT *, CAST(unnest(range(times)) AS BIGINT) AS copy_no FROM timed)"""
