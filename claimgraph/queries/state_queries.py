"""Time, ranking, stateful merges, markets, alerts, integrity, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgraph.functions import dates as D
from claimgraph.functions import text as T
from claimgraph.operators import board, packing, state
from claimgraph.operators import relational as R
from claimgraph.operators import rules as L
from claimgraph.queries.common import query
from claimgraph.queries.text_queries import NOTE_SPARK, NOTE_SQL
from claimgraph.sources import readers, sinks
from claimgraph.streaming import sweep

NOW = "2024-02-01"
ONE = "*"


@query("q17_label_carry", """WITH i AS (SELECT doc_id, 2 AS s, sha256(coalesce(text, '')) AS c FROM documents), l AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 2 END AS s, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(coalesce(text, '')) END AS c, CASE WHEN doc_id % 3 = 0 THEN 'human' ELSE 'machine' END AS who FROM labels JOIN documents USING (doc_id))
SELECT i.doc_id, CASE WHEN who IS NULL THEN 'none' WHEN who = 'machine' AND i.s = l.s AND i.c = l.c AND i.c <> '' THEN 'machine' WHEN who = 'human' AND (i.c = '' OR l.c = '' OR i.c = l.c) THEN 'human' ELSE 'stale' END AS carried FROM i LEFT JOIN l USING (doc_id)""")
def q17(t, spark):
    items = t("documents").select("doc_id", T.content_hash(F.col("text")).alias("c"))
    d = F.col("doc_id")
    store = items.join(t("labels").select("doc_id"), "doc_id").select("doc_id", F.when(d % 7 == 0, 1).otherwise(2).alias("s"), F.when(d % 5 == 0, "").when(d % 11 == 0, "old").otherwise(F.col("c")).alias("sc"), F.when(d % 3 == 0, "human").otherwise("machine").alias("who"))
    return items.join(store, "doc_id", "left").select("doc_id", state.carry_label(F.lit(2), F.col("c"), F.col("c"), F.col("s"), F.col("sc"), F.col("sc"), F.col("who")).alias("carried"))


LIMITS = [("click", 10), ("view", 20), ("purchase", 5)]


@query("q26_freshness_by_type", f"SELECT event_type, count(*) AS kept FROM events LEFT JOIN (VALUES {', '.join(map(str, LIMITS))}) l(event_type, days) USING (event_type) WHERE NOT (date_diff('day', CAST(ts AS DATE), DATE '{NOW}') > coalesce(days, 30)) GROUP BY event_type")
def q26(t, spark):
    rows = t("events").select("event_type", F.datediff(F.lit(NOW).cast("date"), F.col("ts").cast("date")).alias("age")).join(R.dim(spark, LIMITS, "event_type string, days int"), "event_type", "left")
    return rows.filter(~D.too_old(F.col("age"), F.coalesce("days", F.lit(30)))).groupBy("event_type").agg(F.count(ONE).alias("kept"))


@query("q27_top6_per_feed", "SELECT event_type, event_id, CAST(r AS INTEGER) AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, value ORDER BY event_id) AS d FROM events) WHERE d = 1) WHERE r <= 6")
def q27(t, spark):
    fresh = R.keep_first(t("events"), ["user_id", "value"], ["event_id"])
    return R.top_per(fresh, ["event_type"], ["ts", "event_id"], 6).select("event_type", "event_id", "rank")


@query("q29_release_earliest", "SELECT user_id, arg_min(event_id, event_id) AS first_event, arg_min(event_type, event_id) AS kind FROM events WHERE event_type NOT LIKE '%error' GROUP BY user_id")
def q29(t, spark):
    first = F.min_by(F.struct("event_id", "event_type"), "event_id")
    return t("events").filter(~F.col("event_type").rlike("error$")).groupBy("user_id").agg(first.alias("m")).select("user_id", F.col("m.event_id").alias("first_event"), F.col("m.event_type").alias("kind"))


@query("q30_release_merge", "WITH s AS (SELECT s_suppkey AS id, s_nationkey AS nation, 'supplier' AS src FROM supplier), c AS (SELECT c_custkey AS id, c_nationkey AS nation, 'customer' AS src FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)), u AS (SELECT * FROM s UNION ALL SELECT * FROM c) SELECT nation, count(*) AS total, count(*) FILTER (src = 'supplier') AS suppliers FROM u GROUP BY nation")
def q30(t, spark):
    s = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("src"))
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("src")).join(s, "id", "left_anti")
    return s.unionByName(c).groupBy("nation").agg(F.count(ONE).alias("total"), F.count_if(F.col("src") == "supplier").alias("suppliers"))


DAILY = "SELECT event_type AS symbol, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS price FROM events GROUP BY ALL"
CHANGE = f"SELECT *, round(100 * (price / lag(price) OVER (PARTITION BY symbol ORDER BY day) - 1), 2) AS change FROM ({DAILY})"


def daily(t):
    prices = t("events").groupBy(F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("day")).agg(F.count(ONE).cast("double").alias("price"))
    was = F.lag("price").over(Window.partitionBy("symbol").orderBy("day"))
    return prices.withColumn("change", F.round(F.lit(100) * (F.col("price") / was - 1), 2))


@query("q31_daily_change", f"SELECT symbol, CAST(day AS VARCHAR) AS day, price, change FROM ({CHANGE})")
def q31(t, spark):
    return daily(t).withColumn("day", F.col("day").cast("string"))


@query("q32_market_bands", f"SELECT band, count(*) AS n, max(change) AS most, min(change) AS least FROM (SELECT *, CASE WHEN change >= 10 THEN 'breakout' WHEN change >= 5 THEN 'surge' WHEN change <= -5 THEN 'critical' WHEN change <= -3 THEN 'warning' END AS band FROM ({CHANGE})) WHERE band IS NOT NULL GROUP BY band")
def q32(t, spark):
    return daily(t).withColumn("band", L.market_band(F.col("change"))).filter("band is not null").groupBy("band").agg(F.count(ONE).alias("n"), F.max("change").alias("most"), F.min("change").alias("least"))


@query("q33_vintage", "SELECT event_type, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS asof, CASE WHEN max(CAST(ts AS DATE)) < (SELECT max(CAST(ts AS DATE)) FROM events WHERE event_type = 'click') THEN strftime(max(CAST(ts AS DATE)), '%m-%d') ELSE '' END AS mark FROM events GROUP BY event_type")
def q33(t, spark):
    e = t("events")
    ref = e.filter("event_type = 'click'").agg(F.max(F.col("ts").cast("date"))).scalar()
    last = e.groupBy("event_type").agg(F.max(F.col("ts").cast("date")).alias("asof"))
    return last.select("event_type", F.col("asof").cast("string").alias("asof"), F.when(F.col("asof") < ref, F.date_format("asof", "MM-dd")).otherwise("").alias("mark"))


@query("q34_carry_forward", f"WITH d AS ({DAILY}), n AS (SELECT symbol, price FROM d WHERE day = DATE '2024-01-20' AND symbol <> 'click'), o AS (SELECT symbol, price FROM d WHERE day = DATE '2024-01-19') SELECT symbol, coalesce(n.price, o.price) AS price, n.price IS NULL AS stale FROM n FULL JOIN o USING (symbol)")
def q34(t, spark):
    d = daily(t)
    new, old = d.filter("day = '2024-01-20' and symbol <> 'click'").select("symbol", F.col("price").alias("p")), d.filter("day = '2024-01-19'").select("symbol", F.col("price").alias("q"))
    return new.join(old, "symbol", "full").select("symbol", F.coalesce("p", "q").alias("price"), F.col("p").isNull().alias("stale"))


@query("q35_history_retention", f"WITH d AS ({DAILY}) SELECT symbol, count(*) AS days, CAST(min(day) AS VARCHAR) AS since FROM d WHERE day IN (SELECT DISTINCT day FROM d ORDER BY day DESC LIMIT 12) GROUP BY symbol")
def q35(t, spark):
    return sinks.keep_last_dates(daily(t), "day", 12).groupBy("symbol").agg(F.count(ONE).alias("days"), F.min("day").cast("string").alias("since"))


@query("q36_archive_upsert", """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS first_seen, o_orderstatus AS status, o_orderpriority AS claim, o_orderstatus = 'F' AS reviewed FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, DATE '2024-02-01' AS first_seen, 'seen' AS status, 'none' AS claim FROM orders WHERE o_orderkey % 2 = 0)
SELECT k, CAST(coalesce(o.first_seen, n.first_seen) AS VARCHAR) AS first_seen, coalesce(n.status, o.status) AS status, CASE WHEN coalesce(o.reviewed, false) THEN o.claim ELSE coalesce(n.claim, o.claim) END AS claim FROM o FULL JOIN n USING (k)""")
def q36(t, spark):
    o = t("orders")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("first_seen"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("claim"), (F.col("o_orderstatus") == "F").alias("reviewed"))
    new = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit(NOW).cast("date").alias("first_seen"), F.lit("seen").alias("status"), F.lit("none").alias("claim"))
    return R.upsert(old, new, "k", ["first_seen"], ["status", "claim"], F.col("o.reviewed"), ["claim"]).withColumn("first_seen", F.col("first_seen").cast("string"))


CLAIMS = "CASE o_orderstatus WHEN 'F' THEN 'announced' WHEN 'O' THEN 'target' ELSE 'unclassified' END"
TODAY = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"


def claims(t):
    o = t("orders")
    today = o.agg(F.max(F.col("o_orderdate").cast("date"))).scalar()
    claim = F.when(F.col("o_orderstatus") == "F", "announced").when(F.col("o_orderstatus") == "O", "target").otherwise("unclassified")
    return o.select("o_orderkey", claim.alias("claim"), F.datediff(today, F.col("o_orderdate").cast("date")).alias("days"), F.when(F.col("o_orderkey") % 4 == 0, "kept").otherwise("").alias("outcome"), (F.col("o_totalprice") > 200000).cast("int").alias("big"), F.col("o_orderpriority").startswith("1").cast("int").alias("urgent"))


@query("q37_due_queue", f"SELECT o_orderkey, age, score FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), {TODAY}) AS age, CAST(3 * (o_totalprice > 200000)::INT + 2 * starts_with(o_orderpriority, '1')::INT AS INTEGER) AS score, {CLAIMS} AS claim FROM orders WHERE o_orderkey % 4 <> 0) WHERE age >= CASE claim WHEN 'announced' THEN 90 WHEN 'target' THEN 180 END ORDER BY score DESC, age, o_orderkey LIMIT 25".replace("SELECT o_orderkey, age,", "SELECT o_orderkey, CAST(age AS INTEGER) AS age,", 1))
def q37(t, spark):
    rows = state.due(claims(t), "claim", F.col("days"), "outcome").withColumn("score", F.col("big") * 3 + F.col("urgent") * 2)
    return rows.orderBy(F.desc("score"), "age", "o_orderkey").limit(25).select("o_orderkey", "age", "score")


@query("q38_archive_stats", f"SELECT {CLAIMS} AS claim, count(*) AS n, count(*) FILTER (o_orderkey % 4 = 0) AS scored, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_seen, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_seen FROM orders GROUP BY 1")
def q38(t, spark):
    o = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.when(F.col("o_orderstatus") == "F", "announced").when(F.col("o_orderstatus") == "O", "target").otherwise("unclassified").alias("claim"))
    return o.groupBy("claim").agg(F.count(ONE).alias("n"), F.count_if(F.col("o_orderkey") % 4 == 0).alias("scored"), F.min("d").cast("string").alias("first_seen"), F.max("d").cast("string").alias("last_seen"))


@query("q39_method_histograms", "SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS kind, coalesce(lang, source) AS value, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def q39(t, spark):
    # Two histograms in one scan.
    rows = t("documents").groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count(ONE).alias("n"), F.grouping("lang").alias("g"))
    return rows.select(F.when(F.col("g") == 0, "lang").otherwise("source").alias("kind"), F.coalesce("lang", "source").alias("value"), "n")


@query("q40_source_mix", "SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct FROM documents GROUP BY source")
def q40(t, spark):
    docs = t("documents")
    whole = docs.agg(F.count(ONE)).scalar()
    return docs.groupBy("source").agg(F.count(ONE).alias("n")).select("source", "n", F.round(F.lit(100.0) * F.col("n") / whole, 3).alias("pct"))


@query("q41_entity_counts", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE coalesce(lang, '') <> '' GROUP BY lang")
def q41(t, spark):
    return t("documents").filter(F.coalesce("lang", F.lit("")) != "").groupBy("lang").agg(F.count(ONE).alias("n"), F.countDistinct("source").alias("sources"))


@query("q42_day_buckets", f"SELECT heading, count(*) AS n FROM (SELECT CASE WHEN age <= 0 THEN 'Today' WHEN age = 1 THEN 'Yesterday' WHEN age < 7 THEN 'Earlier this week' WHEN age < 31 THEN 'Earlier this month' ELSE 'Older' END AS heading FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), {TODAY}) AS age FROM orders)) GROUP BY heading")
def q42(t, spark):
    return claims(t).groupBy(D.day_bucket(F.col("days")).alias("heading")).agg(F.count(ONE).alias("n"))


@query("q43_date_formats", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN NULL ELSE CAST(CASE WHEN o_orderkey % 9 = 6 THEN date_trunc('month', o_orderdate) WHEN o_orderkey % 9 = 3 THEN o_orderdate + INTERVAL 5 HOUR ELSE o_orderdate END AS VARCHAR) END AS at FROM orders")
def q43(t, spark):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 9
    forms = ["yyyy-MM-dd", "MMMM d, yyyy", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "d MMM yyyy HH:mm:ss 'EST'", "d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM", "yyyy-MM-dd HH:mm"]
    told = F.coalesce(*[F.when(k == i, F.date_format(d, f)) for i, f in enumerate(forms)], F.lit("some day"))
    return t("orders").select("o_orderkey", F.date_format(D.parse_date(told), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("q45_reconcile", "SELECT status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 2) AS pct FROM (SELECT CASE WHEN p_brand IN ('Brand#11', 'Brand#22') THEN 'filing' WHEN contains(lower(p_name), 'a') OR contains('a', lower(p_name)) THEN 'mapped' WHEN p_size > 25 THEN 'private' ELSE 'unclassified' END AS status FROM part) GROUP BY status")
def q45(t, spark):
    part = t("part")
    name, whole = F.lower("p_name"), part.agg(F.count(ONE)).scalar()
    status = F.when(F.col("p_brand").isin("Brand#11", "Brand#22"), "filing").when(name.contains("a") | F.lit("a").contains(name), "mapped").when(F.col("p_size") > 25, "private").otherwise("unclassified")
    return part.groupBy(status.alias("status")).agg(F.count(ONE).alias("n")).select("status", "n", F.round(F.lit(100.0) * F.col("n") / whole, 2).alias("pct"))


@query("q46_entity_quote", "SELECT c_custkey, CASE WHEN n_name IS NULL THEN 'no entity' WHEN n_regionkey = 0 THEN 'uncovered' WHEN n_regionkey = 1 THEN 'private' ELSE r_name END AS quote FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def q46(t, spark):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.select("c_custkey", F.when(F.col("n_name").isNull(), "no entity").when(F.col("n_regionkey") == 0, "uncovered").when(F.col("n_regionkey") == 1, "private").otherwise(F.col("r_name")).alias("quote"))


@query("q47_alert_sweep", "WITH p AS (SELECT page_id, sha256(page_id || '_' || url) AS hash, url FROM pages), s AS (SELECT hash FROM p WHERE page_id % 3 = 0) SELECT page_id, hash, CASE WHEN contains(url, 'https') THEN 2 ELSE 4 END AS priority FROM p WHERE hash NOT IN (SELECT hash FROM s)")
def q47(t, spark):
    pages = t("pages").select("page_id", sweep.digest(F.col("page_id").cast("string"), "url").alias("hash"), "url")
    return pages.join(pages.filter("page_id % 3 = 0").select("hash"), "hash", "left_anti").select("page_id", "hash", F.when(F.col("url").contains("https"), 2).otherwise(4).alias("priority"))


@query("q48_alert_bank", "SELECT event_id, badge FROM (SELECT event_id, 'P' || (1 + event_id % 5) AS badge, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS age FROM events ORDER BY age, event_id DESC LIMIT 250)")
def q48(t, spark):
    e = t("events").select("event_id", F.concat(F.lit("P"), (F.col("event_id") % 5 + 1).cast("string")).alias("badge"))
    return sinks.bank(e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0"), [F.desc("event_id")])


@query("q49_model_agreement", "SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (quality = toxic) AS agree_a, count(*) FILTER (quality = (doc_id % 2)) AS agree_b, round(avg(doc_id % 90), 4) AS mean_sec FROM labels")
def q49(t, spark):
    return t("labels").agg(F.count(ONE).alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("agree_a"), F.count_if(F.col("quality") == F.col("doc_id") % 2).alias("agree_b"), F.round(F.avg(F.col("doc_id") % 90), 4).alias("mean_sec"))


@query("q50_reader_verdict", "WITH r AS (SELECT doc_id, unnest([quality, toxic, CAST(doc_id % 3 AS INTEGER)]) AS v FROM labels), c AS (SELECT doc_id, v, count(*) AS c FROM r GROUP BY ALL), m AS (SELECT doc_id, max(c) AS top, count(*) AS kinds FROM c GROUP BY doc_id) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN kinds = 1 THEN 'unanimous' WHEN top * 2 > 3 THEN 'majority' ELSE 'split' END AS verdict FROM m) GROUP BY verdict")
def q50(t, spark):
    rows = t("labels").select(L.verdict(F.array(F.col("quality"), F.col("toxic"), (F.col("doc_id") % 3).cast("int"))).alias("verdict"))
    return rows.groupBy("verdict").agg(F.count(ONE).alias("n"))


@query("q51_integrity", "SELECT doc_id, rule FROM (SELECT doc_id, unnest([CASE WHEN coalesce(text, '') = '' THEN 'no text' END, CASE WHEN n_chars <> length(text) THEN 'wrong size' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'unknown topic' END, CASE WHEN n > 1 THEN 'duplicate' END]) AS rule FROM (SELECT *, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents)) WHERE rule IS NOT NULL")
def q51(t, spark):
    docs = t("documents").withColumn("h", F.md5("text"))
    often = docs.groupBy("h").agg(F.count(ONE).alias("n"))
    rules = {"no text": F.coalesce("text", F.lit("")) == "", "wrong size": F.col("n_chars") != F.length("text"), "unknown topic": ~F.col("lang").isin("en", "de"), "duplicate": F.col("n") > 1}
    return state.violations(rules, docs.join(often, "h", "left"), "doc_id")


#: The rule that the item of a document breaks, by doc_id modulo 20; items of 0, 18 and 19 break none, and 18 has no source.
BROKEN = ["", "unknown source type", "tier mismatch", "duplicate URL", "invalid coverage", "n/a with spans", "label without article", "partial coverage", "missing content hash", "stale content hash", "missing evidence hash", "stale evidence hash", "unassessed with spans read", "unknown topics", "ambiguous anchor", "anchor not in topics", "unresolved claim tier", "stale evidence tier", "", ""]


def derived_board(docs):
    """items, spans and evidence, one of each for a document, that break BROKEN."""
    i = F.col("doc_id")
    k = i % 20
    by = lambda usual, **other: F.coalesce(*[F.when(k == int(n[1:]), v) for n, v in other.items()], usual)
    n = (i % 3 + 1).cast("int")
    url = by(F.concat(F.lit("https://example.com/"), i.cast("string")), _3=F.concat(F.lit("HTTPS://www.Example.com/"), (i - 1).cast("string"), F.lit("/?utm_source=x#top")))
    tier = by(F.lit(2), _2=F.lit(3))
    held = F.struct(url.alias("url"), by(F.lit("press"), _1=F.lit("blog")).alias("source_type"), tier.alias("source_tier"))
    digest = F.md5(i.cast("string"))
    items = docs.select(
        "doc_id",
        F.when(k == 18, F.slice(F.array(held), 1, 0)).otherwise(F.array(held)).alias("sources"),
        by(F.lit("rule"), _4=F.lit("person"), _5=F.lit("person"), _12=F.lit("unassessed"), _18=F.lit("person")).alias("evidence_method"),
        by(F.lit("Y"), _5=F.lit("n/a")).alias("denominator_stated"),
        F.struct(by(n, _4=n + 1, _6=F.lit(0), _7=F.lit(0), _18=F.lit(0)).alias("seen"), by(n, _6=F.lit(0)).alias("total")).alias("evidence_coverage"),
        by(digest, _8=F.lit("")).alias("content_hash"),
        by(digest, _10=F.lit("")).alias("evidence_hash"),
        by(F.array(F.lit("chips")), _13=F.array(F.lit("chips"), F.lit("moon"))).alias("topics"),
        F.struct(by(F.lit("chips"), _15=F.lit("power")).alias("topic")).alias("anchor"),
        (k == 14).alias("anchor_ambiguous"),
    )
    spans = docs.select(url.alias("url"), by(F.lit("ok"), _6=F.lit("http-404")).alias("fetch"), F.sequence(F.lit(1), n).alias("spans"), by(digest, _9=F.lit("old")).alias("content_hash"), by(digest, _11=F.lit("old")).alias("evidence_hash"))
    evidence = docs.select(url.alias("url"), F.lit(4).alias("claim_tier"), by(F.lit("stake"), _16=F.lit("unresolved")).alias("claim_relationship"), by(tier, _17=F.lit(5)).alias("source_tier"))
    return items, spans, evidence


@query("q73_board_integrity", f"SELECT doc_id, rule FROM (SELECT doc_id, {BROKEN}[CAST(doc_id % 20 AS INTEGER) + 1] AS rule FROM documents) WHERE rule <> '' AND (rule <> 'duplicate URL' OR doc_id - 1 IN (SELECT doc_id FROM documents))")
def q73(t, spark):
    items, spans, evidence = derived_board(t("documents").select("doc_id"))
    return board.board_violations(items, spans, evidence, ["chips", "power"], {"press": 2}, "doc_id").select("doc_id", "rule")


#: A first sentence without an event, and a second that names one for some orders; the years are 30 later than the orders'.
HEARING = "concat('Filed in ', CAST(year(o_orderdate) + 30 AS {s}), '. The ', CASE WHEN o_orderstatus = 'O' THEN 'hearing' ELSE 'meeting' END, ' is on March 5, ', CAST(year(o_orderdate) + 31 AS {s}), '.')"


@query("q52_nominations", f"""SELECT o_orderkey, 'deflation' AS kind, unnest(list_transform(regexp_extract_all({NOTE_SQL}, '(?i){T.STRONG}'), lambda x: trim(x))[1:3]) AS span FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('4', '5') AND o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'calendar', 'The hearing is on March 5, ' || (year(o_orderdate) + 31) || '.' FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) BETWEEN 1995 AND 1997""")
def q52(t, spark):
    claims = L.deflation_spans(T.figures(F.expr(NOTE_SPARK)), F.substring("o_orderpriority", 1, 1).cast("int"), F.when(F.col("o_orderstatus") == "F", "N").otherwise("Y"))
    said = t("orders").select("o_orderkey", claims.alias("claims"), L.first_scheduled(F.expr(HEARING.format(s="STRING")), (2026, 2027, 2028)).alias("event"))
    both = F.concat(F.transform("claims", lambda x: F.struct(F.lit("deflation").alias("kind"), x.alias("span"))), F.filter(F.array(F.struct(F.lit("calendar").alias("kind"), F.col("event").alias("span"))), lambda x: x["span"].isNotNull()))
    return said.select("o_orderkey", F.inline(both))


@query("q54_model_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 4 <> 3")
def q54(t, spark):
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("Sure.\n```json\n"), "props", F.lit("\n```"))).when(k == 3, "no object {here").otherwise(F.concat(F.lit("The answer: "), "props", F.lit(" done")))
    return t("events").select("event_id", F.get_json_object(readers.json_block(said), "$.k").cast("int").alias("k")).filter("k is not null")


@query("q55_change_detection", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0")
def q55(t, spark):
    new = t("documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    old = new.filter("doc_id % 5 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("hash")))
    return R.changed(old, new, "doc_id", "hash")


@query("q57_prompt_packing")
def q57(t, spark):
    return packing.pack(t("documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 8, 12_000)


@query("q59_stale_announcements", f"SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), {TODAY}) AS INTEGER) AS days FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), {TODAY}) > 90 AND o_orderstatus = 'P'")
def q59(t, spark):
    return claims(t).filter("days > 90 and claim = 'unclassified'").select("o_orderkey", "days")


@query("q60_xml_feeds", "SELECT page_id, CAST(page_id AS VARCHAR) AS title, 'p' || page_id AS link, CASE WHEN page_id % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS pub FROM pages")
def q60(t, spark):
    i = F.col("page_id").cast("string")
    rss = F.concat(F.lit("<rss><channel><item><title>"), i, F.lit("</title><link>p"), i, F.lit("</link><pubDate>2024-01-01</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>"), i, F.lit("</title><link href='p"), i, F.lit("'/><updated>2024-01-02</updated></entry></feed>"))
    return t("pages").select("page_id", F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("xml")).select("page_id", F.inline(readers.feed_items(F.col("xml")))).select("page_id", "title", "link", F.col("pubDate").alias("pub"))


@query("q61_json_documents", "SELECT p_partkey, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part")
def q61(t, spark):
    doc = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("results")))
    return t("part").select("p_partkey", F.inline(F.from_json(doc, "results array<struct<name string, size bigint>>")["results"]))


@query("q65_display_labels", "SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS money, CASE WHEN o_orderstatus = 'F' THEN 'Final' WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'Other' END AS label FROM orders")
def q65(t, spark):
    return t("orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("money"), F.when(F.col("o_orderstatus") == "F", "Final").when(F.col("o_orderstatus") == "O", "Open").otherwise("Other").alias("label"))


@query("q68_ratings_text", "SELECT n_nationkey, lower(n_name) AS pattern, 'region ' || n_regionkey AS note FROM nation")
def q68(t, spark):
    line = F.concat(F.lit("- "), F.lower("n_name"), F.lit(" :: region "), F.col("n_regionkey").cast("string"))
    return t("nation").select("n_nationkey", readers.ratings(line).alias("r")).select("n_nationkey", "r.pattern", "r.note")


@query("q56_stream_seen_set", "SELECT DISTINCT sha256(event_type || '_' || user_id) AS hash FROM events")
def q56(t, spark):
    events = t("events")
    at, name = events.inputFiles()[0].rsplit("/", 1)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", name if name == "events.parquet" else "*.parquet").parquet(at)
    return sweep.drain(sweep.unseen(stream, sweep.digest("event_type", F.col("user_id").cast("string"))).select("hash"))


#: Sales by age, newest first; a sale's heading is its age's, and runs of one status within are told apart.
RUN = "CASE WHEN sold_at IS NULL THEN 'Date not stated' ELSE CAST(CAST(sold_at AS DATE) AS {s}) END || ' ' || coalesce(status, 'none')"


@query("q105_headings", f"""WITH s AS (SELECT sale_id, sold_at, {RUN.format(s='VARCHAR')} AS heading FROM sales), l AS (SELECT *, lag(heading) OVER (ORDER BY sold_at DESC NULLS LAST, sale_id) AS before, row_number() OVER (ORDER BY sold_at DESC NULLS LAST, sale_id) AS n FROM s)
SELECT sale_id, heading FROM l WHERE n = 1 OR heading <> before""")
def q105(t, spark):
    return R.opening(t("sales").select("sale_id", "sold_at", "status"), F.expr(RUN.format(s="STRING")), [F.desc_nulls_last("sold_at"), "sale_id"]).select("sale_id", "heading")


#: Feeds of vendors, each line of a sale an item: some without a url, some without a title, some of a url that stands twice.
SLOT_URL, SLOT_TITLE = "CASE WHEN item_id % 11 = 0 THEN NULL ELSE 'https://a.example/' || (item_id % 40) END AS url", "CASE WHEN place % 13 = 0 THEN '' ELSE 'item ' || item_id END AS title"
SLOT = f"vendor_id AS feed, place, {SLOT_URL}, {SLOT_TITLE}"
PLACED = "SELECT vendor_id, item_id, sale_id * 100 + line_no AS place FROM sale_lines WHERE vendor_id IS NOT NULL AND item_id IS NOT NULL AND sale_id IS NOT NULL AND line_no IS NOT NULL"


@query("q106_feed_slots", f"""WITH RECURSIVE one AS (SELECT vendor_id, min(item_id) AS item_id, place FROM ({PLACED}) GROUP BY vendor_id, place), i AS (SELECT {SLOT} FROM one),
f AS (SELECT feed, row_number() OVER (ORDER BY feed) AS nth, list(struct_pack(place := place, url := url, title := title) ORDER BY place) AS xs FROM i GROUP BY feed),
r AS (SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS BIGINT) AS feed, CAST([] AS STRUCT(place BIGINT, url VARCHAR, title VARCHAR)[]) AS taken
UNION ALL SELECT f.nth, list_concat(r.seen, list_transform(list_filter(list_filter(f.xs, lambda x: x.url IS NULL OR NOT list_contains(r.seen, x.url))[1:6], lambda x: x.url IS NOT NULL AND x.title <> ''), lambda x: x.url)), CAST(f.feed AS BIGINT), list_filter(f.xs, lambda x: x.url IS NULL OR NOT list_contains(r.seen, x.url))[1:6] FROM r JOIN f ON f.nth = r.nth + 1),
g AS (SELECT feed, unnest(taken) AS x FROM r WHERE feed IS NOT NULL), n AS (SELECT feed, x.place AS place, x.url AS url, row_number() OVER (PARTITION BY feed, x.url ORDER BY x.place) AS k FROM g WHERE x.title <> '')
SELECT feed, place, url FROM n WHERE url IS NULL OR k = 1""")
def q106(t, spark):
    lines = t("sale_lines").filter("vendor_id IS NOT NULL AND item_id IS NOT NULL AND sale_id IS NOT NULL AND line_no IS NOT NULL").selectExpr("vendor_id", "item_id", "sale_id * 100 + line_no AS place")
    items = lines.groupBy("vendor_id", "place").agg(F.min("item_id").alias("item_id")).selectExpr("CAST(vendor_id AS BIGINT) AS feed", "place", SLOT_URL, SLOT_TITLE)
    return R.feed_slots(items, "feed", "place", "url", "title").select("feed", "place", "url")
