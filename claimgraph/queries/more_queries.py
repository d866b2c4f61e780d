"""Bare figures, product fallback, write-if-changed, effective dates and publisher tags."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimgraph.functions import dates as D
from claimgraph.functions import text as T
from claimgraph.queries.common import query
from claimgraph.queries.text_queries import NOTE_SPARK
from claimgraph.sources import sinks
from claimgraph.storage import shared_folder


@query("q12_bare_figures", f"SELECT o_orderkey, 6 AS s, CAST(o_orderkey AS VARCHAR) AS figure FROM orders WHERE NOT regexp_matches(CAST(o_orderkey AS VARCHAR), '^(19|20)[0-9][0-9]$') AND o_orderkey % 4 <> 0")
def q12(t, spark):
    # A count, beside strong figures; a year is none, nor what stands near the name of a section.
    note = F.expr(NOTE_SPARK)
    told = F.when(F.col("o_orderkey") % 4 == 0, F.replace(note, F.lit("Order "), F.lit("Section "))).otherwise(note)
    found = F.filter(T.figure_spans(told), lambda x: ~x["strong"])
    return t("orders").select("o_orderkey", F.inline(found)).select("o_orderkey", "s", "figure")


PRODUCTS = [("Value line", "economy"), ("Bulk line", "large"), ("Main line", "standard"), ("Mid line", "medium"), ("Compact line", "small")]
LONGEST_FIRST = sorted(PRODUCTS, key=lambda p: (-len(p[1]), p[1]))


@query("q21_entity_product_fallback", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'Eleven' " + " ".join(f"WHEN {T.word_sql('p_type', form)} THEN '{name}'" for name, form in LONGEST_FIRST) + " ELSE '' END AS entity FROM part")
def q21(t, spark):
    # The publisher's own tag resolves first; then the longest product named.
    named = F.coalesce(*[F.when(T.word(F.col("p_type"), form), name) for name, form in LONGEST_FIRST], F.lit(""))
    return t("part").select("p_partkey", F.when(F.col("p_brand") == "Brand#11", "Eleven").otherwise(named).alias("entity"))


@query("q58_write_if_changed", "SELECT unnest([1, 2, 3]) AS step, unnest([true, false, true]) AS wrote, unnest([(SELECT sum(n_nationkey) FROM nation), (SELECT sum(n_nationkey) FROM nation), (SELECT sum(n_nationkey) FROM nation WHERE n_regionkey <> 1)])::BIGINT AS held")
def q58(t, spark):
    at = f"{shared_folder(spark)}/unchanged-{uuid.uuid4().hex}"
    rows = t("nation").withColumn("generated", F.current_timestamp())
    steps = []
    for i, now in enumerate((rows, rows.orderBy(F.desc("n_name")), rows.filter("n_regionkey <> 1")), 1):
        wrote = sinks.write_if_changed(now, at)
        steps.append((i, wrote, spark.read.parquet(at).agg(F.sum("n_nationkey")).first()[0]))
    return spark.createDataFrame(steps, "step int, wrote boolean, held long")


@query("q62_effective_date", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 2 THEN DATE '1990-01-01' ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS day FROM orders")
def q62(t, spark):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    page = F.when(k == 0, F.concat(F.lit('<meta name="date" content="'), F.date_format(d, "yyyy-MM-dd"), F.lit('">'))).otherwise("<p>none</p>")
    url = F.when(k == 1, F.concat(F.lit("https://example.com/"), F.date_format(d, "yyyy/MM/dd"), F.lit("/post"))).otherwise("https://example.com/post")
    # The page's own date, then that of a tag the ladder doesn't know, the URL's, and the feed's.
    own = D.parse_date(F.regexp_extract(page, r'<meta name="date" content="([^"]*)"', 1)).cast("date")
    return t("orders").select("o_orderkey", F.coalesce(D.page_date(page), own, D.date_in_url(url), F.lit("1990-01-01").cast("date")).cast("string").alias("day"))


@query("q64_publisher_tags", "SELECT p_partkey, lower(p_brand) || '|' || lower(p_type) AS tags FROM part")
def q64(t, spark):
    told = F.to_json(F.struct(F.array("p_brand", "p_type", F.upper("p_brand")).alias("keywords")))
    html = F.concat(F.lit('<script type="application/ld+json">'), told, F.lit("</script>"))
    block = F.regexp_extract(html, r'(?s)<script type="application/ld\+json">(.*?)</script>', 1)
    tags = F.from_json(block, "keywords array<string>")["keywords"]
    kept = F.slice(F.array_distinct(F.transform(F.filter(tags, lambda x: F.length(x) < 60), lambda x: F.lower(x))), 1, 30)
    return t("part").select("p_partkey", F.array_join(kept, "|").alias("tags"))


