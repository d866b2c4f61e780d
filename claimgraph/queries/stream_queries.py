"""Sweeps over tables as streams: what was seen first and when, and the alerts that come of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.operators import evaluate as E
from claimgraph.queries.common import query
from claimgraph.sources import web
from claimgraph.storage import shared_folder
from claimgraph.streaming import ledger, sweep
from claimgraph.streaming.first_seen import first_seen, seen_times, state_store


def streamed(spark: SparkSession, table: DataFrame) -> DataFrame:
    """A table's files as a stream."""
    at, name = table.inputFiles()[0].rsplit("/", 1)
    return spark.readStream.schema(table.schema).option("pathGlobFilter", name if at.rpartition(".")[2] != "parquet" else "*.parquet").parquet(at)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("q98_first_seen", "SELECT sha256(event_type || '_' || user_id) AS hash, CAST(min(ts) AS VARCHAR) AS first_seen FROM events GROUP BY 1")
def q98(t, spark):
    folder = new_folder(spark, "first-seen")
    seen = first_seen(streamed(spark, t("events")).select("event_type", "user_id", "ts"), sweep.digest("event_type", F.col("user_id").cast("string")), F.col("ts"))
    with state_store(spark):
        done = seen.writeStream.format("parquet").option("path", f"{folder}/items").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return seen_times(spark, f"{folder}/state").select("hash", F.col("first_seen").cast("string").alias("first_seen"))


#: Notices told of sales: one for each client and status.
NOTICE = {"title": "concat(CASE status WHEN 'done' THEN 'Final order for ' ELSE 'Update of ' END, client_id)", "summary": "concat('client ', client_id, ' has a sale of state ', status)"}


@query("q99_alert_sweep", f"""WITH n AS (SELECT DISTINCT client_id, status, {NOTICE['title']} AS title, {NOTICE['summary']} AS summary FROM sales WHERE client_id IS NOT NULL AND status IS NOT NULL)
SELECT sha256(client_id || '_' || status) AS hash, 'Gazette' AS source, title, CAST(CASE WHEN regexp_matches(title || summary, '{E.DUTY}') THEN 2 ELSE 4 END AS INTEGER) AS priority, regexp_matches(title || summary, '{E.DUTY}') AS is_duty FROM n""")
def q99(t, spark):
    book = ledger.Ledger(spark, new_folder(spark, "sweep"))
    notices = streamed(spark, t("sales")).filter("client_id IS NOT NULL AND status IS NOT NULL").select("client_id", "status", "sold_at", *[F.expr(e).alias(c) for c, e in NOTICE.items()])
    items = notices.select("client_id", "status", "sold_at", "title", "summary", F.lit("Gazette").alias("source"), F.lit(None).cast("string").alias("jurisdiction"), F.lit(None).cast("string").alias("url"), F.lit(1).alias("base"))
    ledger.sweep(items, sweep.digest(F.col("client_id").cast("string"), "status"), F.col("sold_at"), ledger.alert_rows, book).awaitTermination()
    return book.alerts().select("hash", "source", "title", "priority", "is_duty")


class Gone(Exception):
    """An answer of a server that has nothing."""

    def __init__(self, code: int):
        super().__init__(code)
        self.code = code


def stand_in(url: str) -> tuple[str, bytes]:
    """The network, as far as the query goes: hosts of example.org are down, those beginning with m. forbid /en/, and files named .html are no HTML."""
    host, _, path = url.partition("://")[2].partition("/")
    if host.endswith("example.org"):
        raise Gone(503)
    if path == "robots.txt":
        if not host.startswith("m."):
            raise Gone(404)
        return "text/plain", b"User-agent: *\nDisallow: /en/\n"
    return ("application/pdf", b"") if ".html" in path else ("text/html; charset=utf-8", f"<title>{url}</title>".encode())


@query("q100_page_source", """WITH u AS (SELECT DISTINCT url, split_part(url, '/', 3) AS host FROM pages WHERE url IS NOT NULL),
s AS (SELECT url, CASE WHEN host LIKE 'm.%' AND host NOT LIKE '%example.org' AND split_part(url, '/', 4) = 'en' AND contains(substr(url, 9), '/en/') THEN 'robots-disallowed' WHEN host LIKE '%example.org' THEN 'http-503' WHEN contains(url, '.html') THEN 'not-html' ELSE 'ok' END AS status FROM u)
SELECT url, status, CASE WHEN status = 'ok' THEN '<title>' || url || '</title>' ELSE '' END AS html FROM s""")
def q100(t, spark):
    folder = new_folder(spark, "spool")
    web.spool(t("pages").select("url"), folder)
    spark.dataSource.register(web.page_source(stand_in, "stand_in_pages", delay=0.0))
    return spark.read.format("stand_in_pages").option("folder", folder).load().select("url", "status", "html")
