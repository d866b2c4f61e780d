"""Dates, rails, observations, identities, digests and queues of a board, told from the shop's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgraph.functions import text as T
from claimgraph.operators import evidence as E
from claimgraph.operators import reports, scope, state
from claimgraph.operators import rules as L
from claimgraph.queries.common import query
from claimgraph.sources import catalogues as C
from claimgraph.sources import sinks

TODAY = "2024-06-01"
#: A page of each sale: its own date in the JSON, in a meta tag, in words by the h1, in the URL, or nowhere; the feed's date is of the sale's arrival.
FORMS = 6


@query("q107_fresh_items", f"""WITH s AS (SELECT sale_id, CAST(arrived_at AS DATE) AS feed, CAST(sold_at AS DATE) - INTERVAL 40 DAY AS own, sale_id % {FORMS} AS k, CASE sale_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 120 ELSE 150 END AS lim, sale_id % 5 <> 0 AS asks FROM sales),
e AS (SELECT *, CASE WHEN asks AND k < 4 AND own IS NOT NULL THEN CAST(own AS DATE) ELSE feed END AS eff FROM s)
SELECT sale_id, CAST(eff AS VARCHAR) AS effective_date FROM e WHERE NOT coalesce(date_diff('day', feed, DATE '{TODAY}') > lim, false) AND NOT coalesce(date_diff('day', eff, DATE '{TODAY}') > lim, false)""")
def q107(t, spark):
    k, own = F.col("sale_id") % FORMS, F.date_sub(F.col("sold_at").cast("date"), 40)
    said = lambda form: F.date_format(own, form)
    page = F.when(k == 0, F.concat(F.lit('<script>{"datePublished": "'), said("yyyy-MM-dd"), F.lit('T05:00:00Z"}</script><h1>January 2, 2020</h1>')))
    page = page.when(k == 1, F.concat(F.lit('<meta content="'), said("yyyy-MM-dd"), F.lit('" property="article:published_time"><h1>x</h1>January 3, 2020')))
    page = page.when(k == 2, F.concat(F.lit("<p>January 4, 2020</p>"), F.lit("x" * 900), F.lit("<h1>News</h1> on "), said("MMMM d, yyyy"))).otherwise("<h1>no date</h1>")
    url = F.when(k == 3, F.concat(F.lit("https://a.example/"), said("yyyy/MM/dd"), F.lit("/post"))).otherwise("https://a.example/post")
    limit = F.when(F.col("sale_id") % 4 == 0, 60).when(F.col("sale_id") % 4 == 1, 120).otherwise(150)
    # Dealt anew, since a page costs many times what its sale takes in the file.
    items = t("sales").repartition("sale_id").select("sale_id", "sold_at", "arrived_at", url.alias("url"), page.alias("html"))
    done = scope.fresh_items(items, F.col("arrived_at"), F.col("url"), F.col("html"), F.lit(TODAY).cast("date"), limit, F.col("sale_id") % 5 != 0)
    return done.select("sale_id", F.col("effective_date").cast("string").alias("effective_date"))


KEY = r"lower(trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g')))"


@query("q108_rails", f"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS head, string_split(text, chr(10)) AS xs FROM documents), h AS (SELECT DISTINCT {KEY.format(x='head')} AS k FROM d),
l AS (SELECT doc_id, {KEY.format(x='head')} AS mine, {KEY.format(x='x')} AS k FROM (SELECT doc_id, head, unnest(xs) AS x FROM d))
SELECT doc_id, count(*) AS lines, count(*) FILTER (k = mine OR k NOT IN (SELECT k FROM h WHERE k IS NOT NULL)) AS kept FROM l GROUP BY doc_id""")
def q108(t, spark):
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    docs = t("documents").filter("text IS NOT NULL")
    lines = docs.select("doc_id", head.alias("head"), F.explode(F.split("text", "\n")).alias("line"))
    kept = E.without_headlines(lines, "line", "head", docs.select(head)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines")).join(kept, "doc_id", "left").select("doc_id", "lines", F.coalesce("kept", F.lit(0)).alias("kept"))


OBSERVED = "CASE WHEN sale_id % 9 = 0 THEN '.' WHEN sale_id % 9 = 1 THEN 'n/a' ELSE CAST(CAST(priority * 10 + sale_id % 7 AS INTEGER) AS {s}) END"


@query("q109_observations", f"""WITH o AS (SELECT client_id AS series, CAST(sold_at AS DATE) AS day, try_cast({OBSERVED.format(s='VARCHAR')} AS DOUBLE) AS v FROM sales WHERE client_id IS NOT NULL),
d AS (SELECT series, day, max(v) AS v FROM o WHERE v IS NOT NULL AND day IS NOT NULL GROUP BY ALL), r AS (SELECT *, lead(v) OVER (PARTITION BY series ORDER BY day DESC) AS before, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS n FROM d)
SELECT series, CAST(day AS VARCHAR) AS "asof", v AS value, round(CASE WHEN before <> 0 THEN 100 * (v / before - 1) END, 6) AS change_pct FROM r WHERE n = 1""")
def q109(t, spark):
    rows = t("sales").filter("client_id IS NOT NULL").select("client_id", F.col("sold_at").cast("date").alias("day"), F.expr(OBSERVED.format(s="STRING")).alias("value"))
    return C.last_observations(rows, "client_id", "day", "value").select("series", F.col("asof").cast("string").alias("asof"), "value", F.round("change_pct", 6).alias("change_pct"))


@query("q110_source_identity", "SELECT page_id, 'the daily ' || page_id || '  ' || regexp_replace(lower(split_part(url, '/', 3)), '^www\\.', '') || ' other.example' AS identity FROM pages WHERE url IS NOT NULL")
def q110(t, spark):
    source = lambda name, url: F.struct(name.alias("name"), url.alias("url"))
    sources = F.array(source(F.concat(F.lit("The Daily "), F.col("page_id").cast("string")), F.col("url")), source(F.lit(None).cast("string"), F.lit("https://Other.example/The-Rival/a")))
    return t("pages").filter("url IS NOT NULL").select("page_id", E.source_identity(sources).alias("identity"))


CHANGE = "round((price - size) / 10, 2)"
#: The same as binary numbers have it, which is how the SQL rounds: Spark's own round goes by the shortest decimals, so 0.285 becomes 0.29 there and 0.28 here.
CHANGE_SPARK = "round((price - size) / 10 * 100) / 100"


@query("q111_market_digest", f"""WITH q AS (SELECT 'I' || item_id AS symbol, {CHANGE} AS change FROM items WHERE price IS NOT NULL AND size IS NOT NULL), d AS (SELECT *, row_number() OVER (ORDER BY change, symbol) AS r FROM q WHERE change <= -3), u AS (SELECT *, row_number() OVER (ORDER BY change DESC, symbol) AS r FROM q WHERE change >= 5),
a AS (SELECT kind, arg_min(name, item_id) AS name FROM items WHERE kind IS NOT NULL AND name <> '' GROUP BY kind)
SELECT 'drops' AS list, CAST(r AS INTEGER) AS rank, symbol AS name, change FROM d WHERE r <= 3 UNION ALL SELECT 'rallies', CAST(r AS INTEGER), symbol, change FROM u WHERE r <= 3 UNION ALL SELECT 'article', 1, kind || ': ' || name, NULL FROM a""")
def q111(t, spark):
    items = t("items")
    quotes = items.filter("price IS NOT NULL AND size IS NOT NULL").select(F.format_string("I%d", "item_id").alias("symbol"), F.lit("equity").alias("kind"), F.expr(CHANGE_SPARK).alias("change_pct"))
    return reports.market_digest(quotes, items.filter("kind IS NOT NULL").select(F.col("kind").alias("category"), F.col("item_id").alias("place"), F.col("name").alias("title")))


HEADLINE = "concat(CASE priority WHEN 1 THEN 'Up by 40% in ' WHEN 2 THEN 'A plan for ' ELSE 'Of $9 and ' END, status)"


@query("q112_revisit_queue", f"""WITH s AS (SELECT sale_id, {HEADLINE} AS headline, CASE sale_id % 4 WHEN 0 THEN 'announced' WHEN 1 THEN 'target' WHEN 2 THEN 'prediction' END AS claim, CASE WHEN sale_id % 3 = 0 THEN 5 ELSE 2 END AS tier, CASE WHEN sale_id % 5 = 0 THEN 'chips' END AS topic, sale_id % 7 = 0 AS reviewed, CASE WHEN sale_id % 11 = 0 THEN 'delivered' ELSE '' END AS outcome, date_diff('day', CAST(sold_at AS DATE), DATE '2024-08-01') AS age FROM sales)
SELECT sale_id, CAST(age AS INTEGER) AS age, CAST(CASE WHEN coalesce(contains(headline, '%') OR contains(headline, '$'), false) THEN 3 ELSE 0 END + CASE WHEN claim = 'target' THEN 2 ELSE 0 END + CASE WHEN tier = 5 THEN 2 ELSE 0 END + CASE WHEN topic IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN reviewed THEN 1 ELSE 0 END AS INTEGER) AS score
FROM s WHERE outcome = '' AND age >= CASE claim WHEN 'announced' THEN 90 WHEN 'target' THEN 180 WHEN 'prediction' THEN 180 END""")
def q112(t, spark):
    i = F.col("sale_id")
    rows = t("sales").select("sale_id", F.expr(HEADLINE).alias("headline"), F.when(i % 4 == 0, "announced").when(i % 4 == 1, "target").when(i % 4 == 2, "prediction").alias("claim"), F.when(i % 3 == 0, 5).otherwise(2).alias("tier"), F.when(i % 5 == 0, "chips").alias("topic"), (i % 7 == 0).alias("reviewed"), F.when(i % 11 == 0, "delivered").otherwise("").alias("outcome"), "sold_at")
    queue = state.due(rows, "claim", F.datediff(F.lit("2024-08-01").cast("date"), F.col("sold_at").cast("date")), "outcome")
    return queue.select("sale_id", "age", state.revisit_score(F.col("headline"), F.col("claim"), F.col("tier"), F.col("topic"), F.col("reviewed")).alias("score"))


@query("q113_market_chips", """SELECT item_id, CASE WHEN brand IS NULL OR item_id % 6 = 0 THEN '' WHEN item_id % 6 = 1 THEN 'listed, not covered here' WHEN item_id % 6 = 2 THEN 'no listed security' WHEN price IS NULL THEN '' ELSE 'quote' END AS chip, '$' || format('{:,.2f}', price) AS money FROM items""")
def q113(t, spark):
    k = F.col("item_id") % 6
    chip = reports.market_chip(F.col("brand"), k != 0, F.when(k > 2, "TICK").otherwise(""), F.when(k == 1, "elsewhere"), F.col("price"))
    return t("items").select("item_id", chip.alias("chip"), reports.money(F.col("price")).alias("money"))


@query("q114_bulletin", f"""SELECT CAST(place AS INTEGER) AS place, '| ' || left(CAST(sold_at AS VARCHAR), 16) || ' | P' || CASE WHEN priority BETWEEN 1 AND 5 THEN priority ELSE 5 END || ' | **' || CASE WHEN sale_id % 2 = 0 THEN 'EU' ELSE 'US/UK' END || ' | ' || status || ' | sale ' || sale_id || ' | Primary |' AS line
FROM (SELECT *, row_number() OVER (ORDER BY sold_at DESC, sale_id) AS place FROM (SELECT * FROM sales WHERE sold_at IS NOT NULL AND status IS NOT NULL) s) WHERE place <= 50""".replace("'US/UK' END || ' | '", "'US/UK' END || '** | '"))
def q114(t, spark):
    # A top-50 report.
    none = F.lit(None).cast("string")
    rows = t("sales").filter("sold_at IS NOT NULL AND status IS NOT NULL")
    alerts = rows.select(F.col("sold_at").alias("timestamp"), "priority", F.when(F.col("sale_id") % 2 == 0, "EU").otherwise("US|UK").alias("jurisdiction"), F.col("status").alias("source"), F.format_string("sale %d", "sale_id").alias("summary"), none.alias("reference"), none.alias("url"), "sale_id")
    return sinks.bulletin_rows(alerts, order=("sale_id",))


@query("q115_nominations", "WITH n AS (SELECT DISTINCT client_id, status FROM sales WHERE client_id IS NOT NULL AND status IS NOT NULL) SELECT 2 AS place, '- client ' || client_id || ': ' || status AS line FROM n UNION ALL SELECT 0, '## Due (' || count(*) || ')' FROM n UNION ALL SELECT 1, ''")
def q115(t, spark):
    rows = t("sales").filter("client_id IS NOT NULL AND status IS NOT NULL").select("client_id", "status").distinct()
    return sinks.nominations(rows.select(F.format_string("client %d", "client_id").alias("name"), F.col("status").alias("reason")), "Due")


@query("q116_containing", "WITH a AS (SELECT DISTINCT lower(name) AS a FROM items WHERE name <> ''), b AS (SELECT DISTINCT lower(split_part(name, ' ', 2)) AS b FROM items WHERE split_part(name, ' ', 2) <> '' UNION SELECT DISTINCT lower(name) || 's' FROM items WHERE item_id % 2 = 0 AND name <> '' UNION SELECT 'e') SELECT a, b FROM a, b WHERE contains(a, b) OR contains(b, a)")
def q116(t, spark):
    items = t("items").filter("name <> ''")
    word = items.select(F.lower(F.split_part("name", F.lit(" "), F.lit(2))).alias("b"))
    other = word.union(items.filter("item_id % 2 = 0").select(F.concat(F.lower("name"), F.lit("s")))).union(spark.createDataFrame([("e",)], "b string"))
    return reports.containing(items.select(F.lower("name").alias("a")), "a", other, "b")


#: Lines of several kinds told of sales: an author's note, a DOI, a time of day, a count of comments, a caption, and sentences that are none of these.
TOLD = "CASE sale_id % 7 WHEN 0 THEN concat('DOI: 10.1000/', sale_id) WHEN 1 THEN concat('See all comments (', sale_id, ')') WHEN 2 THEN concat('Figure ', sale_id, ': The layout of the hall') WHEN 3 THEN concat('Figure ', sale_id, ': Sales rose 12% in May') WHEN 4 THEN 'She covered the tech industry for over 12 years' WHEN 5 THEN concat('It took 12:45 to sell ', sale_id, ' of them') ELSE concat('Updated Mon May 6, 2024 at ', 1 + sale_id % 9, ':15pm') END"


@query("q117_furniture", "SELECT sale_id, sale_id % 7 NOT IN (3, 5) AS furniture FROM sales")
def q117(t, spark):
    return t("sales").select("sale_id", T.is_furniture(F.expr(TOLD)).alias("furniture"))


@query("q118_alert_totals", "SELECT count(*) AS alerts, count(*) FILTER (priority = 1) AS p1, count(*) FILTER (priority = 2) AS p2, count(*) FILTER (sale_id % 3 = 0) AS duties FROM sales")
def q118(t, spark):
    return reports.urgent_counts(t("sales").select("priority", (F.col("sale_id") % 3 == 0).alias("is_duty")))


@query("q119_outcomes", "SELECT coalesce(nullif(status, ''), '(not scored)') AS outcome, count(*) AS n FROM sales GROUP BY 1")
def q119(t, spark):
    return reports.outcome_histogram(t("sales"), "status")


@query("q120_severity", "SELECT sale_id, CAST(CASE WHEN a = b AND b = c THEN 3 WHEN a <> b AND b <> c AND a <> c THEN 0 ELSE 2 END AS INTEGER) AS severity FROM (SELECT sale_id, sale_id % 2 AS a, sale_id % 3 AS b, sale_id % 5 AS c FROM sales)")
def q120(t, spark):
    i = F.col("sale_id")
    return t("sales").select("sale_id", L.severity(L.verdict(F.array(i % 2, i % 3, i % 5))).alias("severity"))


@query("q121_tiers_and_sources", "SELECT sale_id, CAST(min(vendor_id % 5) AS INTEGER) AS min_tier, CAST(max(vendor_id % 5) AS INTEGER) AS max_tier FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY sale_id")
def q121(t, spark):
    lines = t("sale_lines").filter("sale_id IS NOT NULL").groupBy("sale_id").agg(F.collect_set((F.col("vendor_id") % 5).cast("int")).alias("tiers"))
    sources = F.transform("tiers", lambda x: F.struct(x.alias("source_tier")))
    return lines.select("sale_id", reports.tier_range(sources).alias("t")).select("sale_id", "t.*")
