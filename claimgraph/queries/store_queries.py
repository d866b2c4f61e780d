"""Stores kept up over several runs: archive, labels, quotes. Items are told from sales, clients being what they are about."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimgraph.functions import text as T
from claimgraph.operators import archive, keyed_store, sentence_view
from claimgraph.queries.common import query
from claimgraph.storage import shared_folder


def new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


URL = "concat('https://a.example/', client_id)"
ITEM = f"""client_id, sale_id, {URL} AS url, concat(status, ' sale') AS headline, concat('client ', client_id) AS entity, CASE WHEN sale_id % 5 = 0 THEN 'some day' ELSE CAST(CAST(sold_at AS DATE) AS {{s}}) END AS date,
CASE priority WHEN 1 THEN 'target' WHEN 2 THEN 'announced' END AS claim_type, CASE WHEN sale_id % 3 = 0 THEN 'three' ELSE 'other' END AS topic, sale_id % 7 = 0 AS reviewed, sale_id % 3 = 0 AS auto_labelled, priority"""
FIRST, SECOND = "sale_id % 2 = 0", "sale_id % 2 = 1 AND client_id % 3 <> 0"

OBSERVED = """SELECT url, arg_max(struct_pack(headline, auto_labelled, priority, entity, claim_type, topic), sale_id) AS l, arg_max(struct_pack(entity, claim_type, topic), sale_id) FILTER (reviewed) AS r, arg_min(struct_pack(date), sale_id) AS f, bool_or(reviewed) AS reviewed FROM i WHERE {which} GROUP BY url"""


@query("q101_archive_captures", f"""WITH i AS (SELECT {ITEM.format(s='VARCHAR')} FROM sales WHERE client_id IS NOT NULL), a AS ({OBSERVED.format(which=FIRST)}), b AS ({OBSERVED.format(which=SECOND)}),
j AS (SELECT coalesce(a.url, b.url) AS url, a.url IS NOT NULL AS was, b.url IS NOT NULL AS again, a.l AS al, a.r AS ar, a.f AS af, coalesce(a.reviewed, false) AS av, b.l AS bl, b.r AS br, b.f AS bf, coalesce(b.reviewed, false) AS bv FROM a FULL JOIN b ON a.url = b.url),
k AS (SELECT *, CASE WHEN again THEN bl ELSE al END AS l, CASE WHEN bv THEN br WHEN av THEN ar END AS r, CASE WHEN was THEN af ELSE bf END AS f FROM j)
SELECT url, coalesce(l.headline, '') AS headline, CASE WHEN av OR bv THEN coalesce(r.claim_type, 'unclassified') ELSE coalesce(l.claim_type, 'unclassified') END AS claim_type, CASE WHEN av OR bv THEN r.topic ELSE l.topic END AS topic, CAST(nullif(l.priority, 0) AS INTEGER) AS min_tier,
av OR bv AS reviewed, l.auto_labelled AS auto_labelled, CASE WHEN again THEN '2024-06-02' ELSE '2024-06-01' END AS last_seen, CASE WHEN f.date <> 'some day' THEN f.date WHEN was THEN '2024-06-01' ELSE '2024-06-02' END AS first_seen, CASE WHEN was THEN '2024-06-01' ELSE '2024-06-02' END AS captured,
CASE WHEN was AND CAST(split_part(url, '/', 4) AS BIGINT) IN (SELECT client_id FROM clients WHERE client_id % 4 = 0) THEN 'delivered' ELSE '' END AS outcome FROM k""")
def q101(t, spark):
    sales = t("sales").filter("client_id IS NOT NULL").selectExpr(*[x for x in split_top(ITEM.format(s="STRING"))])
    items = sales.withColumn("denominator_stated", F.lit(None).cast("string")).withColumn("sources", F.array(F.struct(F.lit("ledger").alias("name"), "url", F.col("priority").alias("source_tier"))))
    store = keyed_store.created(spark, new_folder(spark, "archive"), ["url"], archive.ARCHIVE)
    store = archive.capture(store, items.filter(FIRST), "2024-06-01", ["sale_id"])
    store = archive.settle(store, t("clients").filter("client_id % 4 = 0").select(F.expr(URL).alias("url"), F.lit("delivered").alias("outcome"), F.lit("").alias("outcome_note"), F.lit("2024-06-01").cast("date").alias("outcome_date")))
    store = archive.capture(store, items.filter(SECOND), "2024-06-02", ["sale_id"])
    as_text = lambda c: F.col(c).cast("string").alias(c)
    return store.rows().select("url", "headline", "claim_type", "topic", "min_tier", "reviewed", "auto_labelled", as_text("last_seen"), as_text("first_seen"), as_text("captured"), "outcome")


def split_top(select: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[at:i])
            at = i + 1
    return [*out, select[at:]]


LABELS = "url string, topic string, denominator_stated string, label_schema_version int, reviewed boolean, label_source string"
#: What the store has at first, by client; and what items say.
HELD = "CASE client_id % 5 WHEN 0 THEN 'human' WHEN 1 THEN 'machine' WHEN 2 THEN 'unattributed' ELSE '' END"
SAID = "CASE sale_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN '' END"


@query("q102_review_store", f"""WITH h AS (SELECT client_id, nullif({HELD}, '') AS held FROM clients WHERE client_id % 5 <> 4), i AS (SELECT client_id, sale_id, sale_id % 11 = 0 AS human, sale_id % 11 <> 0 AND sale_id % 3 = 0 AS auto, nullif({SAID}, '') AS said FROM sales WHERE client_id IS NOT NULL AND (sale_id % 11 = 0 OR sale_id % 3 = 0)),
n AS (SELECT client_id, arg_min(CASE WHEN human THEN coalesce(said, 'unattributed') ELSE 'machine' END, sale_id) AS start, max(sale_id) FILTER (human) AS by_human, max(sale_id) AS latest, arg_max(human, sale_id) AS ended_human, bool_or(auto) AS some_auto FROM i GROUP BY client_id),
j AS (SELECT coalesce(h.client_id, n.client_id) AS client_id, h.client_id IS NOT NULL AS was, n.client_id IS NOT NULL AS now, held, coalesce(held, start) AS label, by_human, latest, ended_human, some_auto FROM h FULL JOIN n ON h.client_id = n.client_id),
k AS (SELECT *, CASE WHEN NOT now OR (label IN ('human', 'unattributed') AND by_human IS NULL) THEN 'old' WHEN label IN ('human', 'unattributed') THEN 'human' WHEN ended_human THEN 'over' ELSE 'machine' END AS what FROM j)
SELECT 'https://a.example/' || client_id AS url, CASE what WHEN 'old' THEN 'old topic' WHEN 'human' THEN 'topic ' || by_human WHEN 'over' THEN 'topic ' || latest END AS topic, CASE what WHEN 'old' THEN 'Y' WHEN 'human' THEN 'N' WHEN 'over' THEN 'N' ELSE 'N' END AS denominator_stated,
CAST(CASE what WHEN 'machine' THEN 2 WHEN 'old' THEN 1 END AS INTEGER) AS label_schema_version, CASE what WHEN 'old' THEN held = 'human' WHEN 'machine' THEN false ELSE true END AS reviewed, CASE what WHEN 'old' THEN CASE WHEN was THEN coalesce(held, '') END WHEN 'human' THEN label WHEN 'over' THEN CASE WHEN some_auto THEN 'machine' ELSE label END ELSE 'machine' END AS label_source FROM k""".replace("held = 'human' WHEN", "coalesce(held, '') = 'human' WHEN"))
def q102(t, spark):
    store = keyed_store.created(spark, new_folder(spark, "labels"), ["url"], LABELS)
    held = t("clients").filter("client_id % 5 <> 4").select(F.expr(URL).alias("url"), F.lit("old topic").alias("topic"), F.lit("Y").alias("denominator_stated"), F.lit(1).alias("label_schema_version"), F.expr(f"{HELD} = 'human'").alias("reviewed"), F.expr(HELD).alias("label_source"))
    store = store.merge(held, lambda old, new: new)
    items = t("sales").filter("client_id IS NOT NULL").select(F.expr(URL).alias("url"), "sale_id", F.format_string("topic %d", "sale_id").alias("topic"), F.lit("N").alias("denominator_stated"), F.lit(2).alias("label_schema_version"), F.expr("sale_id % 11 = 0").alias("reviewed"), F.expr("sale_id % 3 = 0").alias("auto_labelled"), F.expr(SAID).alias("label_source"))
    return archive.keep_reviews(store, items, ["sale_id"]).rows()


QUOTES = "SELECT CAST(sold_at AS DATE) AS date, status AS symbol, round(max(total), 2) AS price FROM sales WHERE sold_at IS NOT NULL AND status IS NOT NULL AND total IS NOT NULL GROUP BY ALL"


@query("q103_quote_history", f"""WITH q AS ({QUOTES}), a AS (SELECT * FROM q WHERE date < DATE '2024-04-01'), b AS (SELECT date, symbol, price + 1 AS price FROM q WHERE date >= DATE '2024-03-20' AND symbol <> 'open'),
kept AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.date = a.date AND b.symbol = a.symbol))
SELECT CAST(date AS VARCHAR) AS date, symbol, price FROM kept WHERE date IN (SELECT DISTINCT date FROM kept ORDER BY date DESC LIMIT 60)""")
def q103(t, spark):
    quotes = t("sales").filter("sold_at IS NOT NULL AND status IS NOT NULL AND total IS NOT NULL").groupBy(F.col("sold_at").cast("date").alias("date"), F.col("status").alias("symbol")).agg(F.round(F.max("total"), 2).alias("price"))
    store = keyed_store.created(spark, new_folder(spark, "history"), ["date", "symbol"], archive.HISTORY, buckets=16)
    store = archive.keep_quotes(store, quotes.filter("date < DATE '2024-04-01'").withColumn("stale", F.lit(False)), 60)
    later = quotes.filter("date >= DATE '2024-03-20'").select("date", "symbol", (F.col("price") + 1).alias("price"), (F.col("symbol") == "open").alias("stale"))
    return archive.keep_quotes(store, later, 60).rows().withColumn("date", F.col("date").cast("string"))


@query("q104_sentence_view", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id % 10 <> 0),
k AS (SELECT doc_id, lower(trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g'))) AS key, min(i) AS i FROM l GROUP BY ALL), often AS (SELECT key FROM k GROUP BY key HAVING count(*) > 1)
SELECT d.doc_id, count(k.i) FILTER (k.key NOT IN (SELECT key FROM often)) AS kept, count(k.i) FILTER (k.key IN (SELECT key FROM often)) AS dropped, coalesce(string_agg(CAST(k.i - 1 AS VARCHAR), ',' ORDER BY k.i) FILTER (k.key NOT IN (SELECT key FROM often)), '') AS places
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 10 <> 0) d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def q104(t, spark):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("sentence"), i.alias("offset")))
    pages = t("documents").select(F.col("doc_id").cast("string").alias("url"), "doc_id", T.content_hash(F.col("text")).alias("content_hash"), lines.alias("spans"))
    view = sentence_view.created(spark, new_folder(spark, "sentences"))
    # Some articles come with another text first, and some go again.
    early = pages.filter("doc_id % 2 = 0 OR doc_id % 9 = 0").withColumn("spans", F.when(F.col("doc_id") % 9 == 0, F.reverse("spans")).otherwise(F.col("spans")))
    view = sentence_view.update(view, early)
    view = sentence_view.update(view, pages.filter("doc_id % 2 = 1 OR doc_id % 9 = 0"), pages.filter("doc_id % 10 = 0").select("url"))
    view = sentence_view.update(view, removed=pages.filter("doc_id % 10 = 0").select("url"))
    return view.evidence().select(F.col("url").cast("long").alias("doc_id"), F.size("spans").cast("long").alias("kept"), F.col("dropped").cast("long").alias("dropped"), F.array_join(F.transform("spans", lambda s: s["offset"].cast("string")), ",").alias("places"))
