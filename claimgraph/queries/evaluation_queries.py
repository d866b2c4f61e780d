"""Findings, labels and bulletins."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgraph.operators import evaluate as E
from claimgraph.queries.common import query
from claimgraph.sources import sinks

#: Notices told from orders, in a form that both engines build.
TITLE = "concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'Final rule on ' WHEN '2-HIGH' THEN 'Meeting notice for ' ELSE 'Update of ' END, lower(o_orderpriority))"
SUMMARY = "CASE WHEN o_orderstatus = 'F' THEN concat('A fee of $', CAST(o_custkey % 9 + 1 AS {s})) ELSE 'No change | none' END"
ROUTINE = "meeting notice"


@query("q69_evaluation", rf"""WITH n AS (SELECT o_orderkey, {TITLE} AS title, {SUMMARY.format(s='VARCHAR')} AS summary FROM orders),
d AS (SELECT *, contains(lower(title), '{ROUTINE}') AS noise, regexp_matches(title || summary, '{E.DUTY}') AS duty FROM n)
SELECT o_orderkey, NOT noise AND duty AS is_duty, CASE WHEN NOT noise AND duty THEN 'transparency' ELSE 'none' END AS duty_type, NOT noise AND regexp_matches(summary, '{E.QUANTITY}') AS quantity,
CASE WHEN noise THEN 'n/a' ELSE 'partial' END AS denominator, CAST(CASE WHEN noise THEN 5 WHEN duty THEN 2 ELSE 4 END AS INTEGER) AS priority FROM d""")
def q69(t, spark):
    notices = t("orders").select("o_orderkey", F.expr(TITLE).alias("title"), F.expr(SUMMARY.format(s="STRING")).alias("summary"))
    done = E.evaluated(notices, "title", "summary", F.lower("title").contains(ROUTINE))
    return done.select("o_orderkey", "finding.*").drop("reference")


@query("q70_answer_lists", """SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 7 WHEN event_id % 4 = 1 THEN event_id % 5 END AS INTEGER) AS i, CASE WHEN event_id % 4 = 0 THEN 'N' WHEN event_id % 4 = 1 THEN 'Y' END AS denominator FROM events""")
def q70(t, spark):
    k = lambda m: F.concat(F.lit('[{"i":'), (F.col("event_id") % m).cast("string"), F.lit(',"denominator":"'), F.lit("N" if m == 7 else "Y"), F.lit('"}]'))
    told = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('<think>maybe [{"i":99}]</think> So: [] then '), k(7))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("First [1, 2 and not closed. "), F.lit('[{"i":0,"denominator":"?"}] but finally '), k(5))).when(F.col("event_id") % 4 == 2, "none []").otherwise("[broken")
    first = F.get(E.labels(told), F.lit(0))
    return t("events").select("event_id", first["i"].alias("i"), first["denominator"].alias("denominator"))


@query("q71_label_ladder", """WITH i AS (SELECT o_orderkey, o_orderstatus <> 'P' AS fetched, o_orderkey % 4 AS spans, o_orderkey % 3 AS based, o_custkey AS chars, substr('YNn', CAST(o_orderkey % 3 AS INTEGER) + 1, 1) AS said FROM orders)
SELECT o_orderkey, CASE WHEN NOT fetched OR chars > 1200 THEN '?' WHEN spans = 0 THEN 'n/a' WHEN based = spans THEN 'Y' WHEN said IN ('Y', 'N') THEN said ELSE '?' END AS denominator,
CASE WHEN NOT fetched OR chars > 1200 THEN 'unassessed' WHEN spans = 0 OR based = spans THEN 'rule' WHEN said IN ('Y', 'N') THEN 'model' ELSE 'unassessed' END AS method,
CAST(CASE WHEN NOT fetched OR chars > 1200 THEN 0 WHEN spans = 0 OR based = spans OR said IN ('Y', 'N') THEN spans ELSE 0 END AS INTEGER) AS seen, CAST(CASE WHEN fetched THEN spans ELSE 0 END AS INTEGER) AS total FROM i""")
def q71(t, spark):
    key = F.col("o_orderkey")
    label = E.label_ladder(F.col("o_orderstatus") != "P", key % 4, key % 3, F.col("o_custkey"), 1200, F.substr(F.lit("YNn"), (key % 3 + 1).cast("int"), F.lit(1)))
    return t("orders").select("o_orderkey", label.alias("l")).select("o_orderkey", "l.*")


@query("q72_bulletin_rows", f"""SELECT CAST(place AS INTEGER) AS place, '| ' || left(CAST(o_orderdate AS VARCHAR), 16) || ' | P' || (1 + o_orderkey % 5) || ' | ' || o_orderpriority || ' | ' || replace(summary, '|', '/') || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN '[Link](' || o_orderkey || ')' ELSE 'Primary' END || ' |' AS line
FROM (SELECT *, {SUMMARY.format(s='VARCHAR')} AS summary, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 50""")
def q72(t, spark):
    # A top-50 report.
    alerts = t("orders").select(F.col("o_orderdate").alias("timestamp"), (1 + F.col("o_orderkey") % 5).alias("priority"), F.col("o_orderpriority").alias("source"), F.expr(SUMMARY.format(s="STRING")).alias("summary"), F.lit(None).cast("string").alias("reference"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("url"), "o_orderkey")
    return sinks.bulletin_rows(alerts, order=("o_orderkey",))
