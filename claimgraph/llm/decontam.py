"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions only.

Of each ``WINDOW - K + 1`` consecutive K-word hashes, the smallest is kept as a fingerprint. Two texts that share
WINDOW words in a row share those hashes, so both keep the same one of them: joining the fingerprints meets every
such span. Each place of a met fingerprint is then extended word by word, which also sorts out hashes that agree by chance.

Only fingerprints travel, and of the few texts that meet the benchmark the text; all others stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import let, whole
from claimgraph.storage import stored

WINDOW = 10
K = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many distinct fingerprints of the benchmark, a long each, they are broadcast: some 20 MB.
MOST_BROADCAST = 500_000
BEFORE = WINDOW - K


def words(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def each(n: Column, body) -> Column:
    """[body(1), ..., body(n)]; empty if n is below 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), body)).otherwise(F.array().cast("array<bigint>"))


def grams(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order, from the words' own; with k, so that runs of other lengths differ."""
    return each(F.size(hashes) - (k - 1), lambda i: F.xxhash64(F.lit(k), *[F.element_at(hashes, i + j) for j in range(k)]))


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def lowest(hs: Column, w: int) -> Column:
    """The smallest of each w values in a row, by doubling."""
    if w == 1:
        return hs
    half = w // 2
    step = lambda v: each(F.size(v) - half, lambda i: F.least(F.element_at(v, i), F.element_at(v, i + half)))
    return let(lowest(hs, w - half) if w - half != half else lowest(hs, half), step)


def fingerprints(hashes: Column, k: int = K, window: int = WINDOW) -> Column:
    """The distinct winnowed k-gram hashes of words given by their hashes."""
    return F.array_distinct(lowest(grams(hashes, k), window - k + 1))


def run_left(ws: Column, iw: Column, p: Column, q: Column, most: int) -> Column:
    """How many words, ``most`` at the most, agree to the left of ws[p] and iw[q] (from 1)."""
    step = lambda acc, j: F.when((acc == j - 1) & (p - j >= 1) & (q - j >= 1) & F.coalesce(F.get(ws, p - j - 1) == F.get(iw, q - j - 1), F.lit(False)), j).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0), step)


def run_right(ws: Column, iw: Column, p: Column, q: Column, most: int) -> Column:
    """How many words agree from ws[p] and iw[q] on."""
    step = lambda acc, j: F.when((acc == j - 1) & F.coalesce(F.get(ws, p + j - 2) == F.get(iw, q + j - 2), F.lit(False)), j).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0), step)


def placed(ws: Column, hashes: Column, k: int, wanted: Column | None) -> Column:
    """array<struct<h, p, q, near>>: the runs of k words, those of the wanted hashes if named; where they begin, and the words around: run number q of ``near``."""
    runs = F.transform(grams(hashes, k), lambda h, i: F.struct(h.alias("h"), (i + 1).cast("int").alias("p")))
    some = runs if wanted is None else F.filter(runs, lambda x: F.array_contains(wanted, x["h"]))
    around = lambda p: F.slice(ws, F.greatest(p - BEFORE, F.lit(1)), F.least(p - 1, F.lit(BEFORE)) + WINDOW)
    return F.transform(some, lambda x: F.struct(x["h"].alias("h"), x["p"].alias("p"), F.least(x["p"], F.lit(BEFORE + 1)).alias("q"), around(x["p"]).alias("near")))


def items_of(bench: DataFrame) -> DataFrame:
    """h, item_id, iq, iw, least: each fingerprint of an item, the words around it, and how many of them make a window."""
    items = bench.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    long = items.filter(F.size("w") >= WINDOW).select("item_id", let(word_hashes(F.col("w")), lambda v: let(fingerprints(v), lambda own: placed(F.col("w"), v, K, own))).alias("f")).select("item_id", F.inline("f"))
    short = items.filter(F.size("w") < WINDOW).select("item_id", "w", word_hashes(F.col("w")).alias("v"))
    own = F.coalesce(*[F.when(F.size("v") == k, F.element_at(grams(F.col("v"), k), 1)) for k in range(1, WINDOW)])
    return long.select("h", "item_id", F.col("q").alias("iq"), F.col("near").alias("iw"), F.lit(WINDOW).alias("least")).union(short.select(own.alias("h"), "item_id", F.lit(1).alias("iq"), F.col("w").alias("iw"), F.size("w").alias("least")))


def text_key() -> Column:
    """What names a text: rows of one text are judged together, whatever their ids."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")


def judged(docs: DataFrame, bench: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """t, hits, items for each distinct text of ``docs`` that repeats a window of an item: the number of its words that do, and the item_ids, distinct and sorted as strings."""
    items = stored(items_of(bench))
    # Only the lengths that there are of items of fewer than WINDOW words: 1 to 9.
    lengths = sorted(r["least"] for r in items.filter(F.col("least") < WINDOW).select("least").distinct().collect())
    keys = items.select("h").distinct()
    if keys.limit(most_broadcast + 1).count() <= most_broadcast:
        keys = F.broadcast(keys)
    marks = let(word_hashes(words(F.col("text"))), lambda v: F.concat(fingerprints(v), *[F.array_distinct(grams(v, k)) for k in lengths]))
    met = stored(docs.select(text_key(), F.explode(marks).alias("h")).join(keys, "h", "left_semi").groupBy("t").agg(F.collect_set("h").alias("hs")))
    # The texts that meet the benchmark, once each, and where they do.
    texts = docs.select(text_key(), "text").join(met, "t").groupBy("t").agg(F.first("text").alias("text"), F.first("hs").alias("hs"))
    ws = texts.select("t", "hs", words(F.col("text")).alias("w")).withColumn("v", word_hashes(F.col("w")))
    places = ws.select("t", F.inline(F.concat(*[placed(F.col("w"), F.col("v"), k, F.col("hs")) for k in sorted({K, *lengths})])))
    both = places.join(items, "h")
    left, right = run_left(F.col("near"), F.col("iw"), F.col("q"), F.col("iq"), BEFORE), run_right(F.col("near"), F.col("iw"), F.col("q"), F.col("iq"), WINDOW)
    found = both.select("t", "item_id", "p", "least", left.alias("left"), right.alias("right")).filter("`left` + `right` >= least")
    # Of the spans that begin at one word, the longest; so there is one for each word at the most.
    longest = found.groupBy("t", (F.col("p") - F.col("left")).alias("s")).agg(F.max(F.col("p") + F.col("right")).alias("e")).groupBy("t").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    names = found.select("t", F.col("item_id").cast("string").alias("item")).distinct().groupBy("t").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return longest.join(names, "t").select("t", covered(F.col("ranges")).cast("long").alias("hits"), "items")


def covered(ranges: Column) -> Column:
    """The number of words in the union of array<struct<s, e>>."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to"))
    return F.aggregate(F.array_sort(ranges), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"]


def decontaminate(docs: DataFrame, bench: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``docs`` and n_words, n_hit (long), items (array of the item_ids met, distinct and sorted as strings), contaminated.

    A word is hit if it lies in an occurrence of a window: WINDOW words in a row of an item, or a whole item of fewer.
    Null and empty texts have no words; items without words are passed over, and with an empty benchmark nothing is
    hit. Rows are judged by their text, so repeated rows and rows without a doc_id are judged as any others. Columns of
    ``docs`` are kept, but for those named as the results; any other names will do. An empty table gives an empty one.
    """
    clash = {"n_words", "n_hit", "items", "contaminated"} & set(docs.columns)
    done = stored(judged(docs.select("text"), bench, most_broadcast))  # its size is known from here on: small, it is broadcast
    rows = docs.select(text_key(), whole(docs, *clash).alias("row"), F.size(words(F.col("text"))).cast("long").alias("n_words")).join(done, "t", "left")
    return rows.select("row.*", "n_words", F.coalesce("hits", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("hits").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of ``docs`` that repeat no window of an item, all columns as they are, whatever their names; judged as by ``decontaminate``."""
    hit = stored(judged(docs.select("text"), bench, most_broadcast).select("t"))
    return docs.select(text_key(), whole(docs).alias("row")).join(hit, "t", "left_anti").select("row.*")


def op10(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The columns of the contract."""
    done = stored(judged(docs.select("text"), bench))
    rows = docs.select(text_key(), "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(done, "t", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", F.coalesce("hits", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("hits").isNotNull().alias("contaminated"))


#: DuckDB: all windows of the items against all runs of as many words of the documents.
ORACLE = r"""
WITH ws AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iwin),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM ws, ks WHERE len(w) >= k)),
met AS (SELECT doc_id, i, dwin.k, item_id FROM dwin JOIN iwin ON dwin.k = iwin.k AND dwin.s = iwin.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY doc_id)
SELECT ws.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM ws LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""
