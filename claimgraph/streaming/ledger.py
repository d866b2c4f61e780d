"""What a sweep has found, written batch by batch so that a death between two writes neither loses nor repeats an alert."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimgraph.operators import evaluate
from claimgraph.storage import names_in, put_once, remove, text_at
from claimgraph.streaming.first_seen import first_seen, state_store

DIGITS = 12
Send = Callable[[str, str], None]


class Ledger:
    """A folder with the alerts, the log and the bank of a sweep, and a record for each batch that is whole.

    A batch is written in this order: its alerts, its lines of the log, the bank after it, its record; then the stream
    commits, and with it what it has seen. Each of the first three is a folder of the batch's own, written anew if the
    batch is run again. Readers take no batch beyond the last record. So a batch that dies before its record is run again
    as if it had never been, and one that dies after it is passed over when it is run again.
    """

    def __init__(self, spark: SparkSession, folder: str, order: Sequence[tuple[str, bool]] = (("timestamp", True), ("hash", False)), keep: int = 250):
        """``order``: columns by which a batch's alerts stand in the bank, and whether from the largest down."""
        self.spark, self.folder, self.order, self.keep = spark, folder.rstrip("/"), tuple(order), keep

    def last(self) -> int:
        """The number of the last batch that is whole; -1 if there is none."""
        whole = [n for n in names_in(self.spark, f"{self.folder}/records") if n.endswith(".json")]
        return int(whole[-1][:DIGITS]) if whole else -1

    def record(self, number: int) -> dict:
        return json.loads(text_at(self.spark, f"{self.folder}/records/{number:0{DIGITS}d}.json"))

    def _whole(self, part: str) -> DataFrame | None:
        """The batches of a part up to the last record, without those that a death has left."""
        last = self.last()
        if last < 0:
            return None
        return self.spark.read.option("basePath", f"{self.folder}/{part}").parquet(f"{self.folder}/{part}").filter(F.col("batch") <= last).drop("batch")

    def alerts(self) -> DataFrame | None:
        """All alerts; None before the first batch."""
        return self._whole("alerts")

    def bank(self) -> DataFrame | None:
        """The newest ``keep`` alerts."""
        last = self.last()
        return None if last < 0 else self.spark.read.parquet(f"{self.folder}/bank/batch={last}")

    def log(self) -> DataFrame | None:
        """The log's lines, one for each alert, as text."""
        last = self.last()
        return None if last < 0 else self.spark.read.option("basePath", f"{self.folder}/log").text(f"{self.folder}/log").filter(F.col("batch") <= last).drop("batch")

    def write_alerts(self, alerts: DataFrame, number: int) -> DataFrame:
        at = f"{self.folder}/alerts/batch={number}"
        alerts.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(alerts.schema).parquet(at)

    def write_log(self, alerts: DataFrame, number: int) -> None:
        alerts.select(F.to_json(F.struct("*")).alias("line")).write.mode("overwrite").text(f"{self.folder}/log/batch={number}")

    def write_bank(self, alerts: DataFrame, number: int) -> None:
        """New alerts before old ones, the first ``keep``; a batch's alerts stand in the order given."""
        old = self.bank()
        aged = alerts.select(F.lit(0).alias("age"), F.struct("*").alias("row"))
        if old is not None:
            aged = aged.union(old.select(F.lit(1).alias("age"), F.struct(*alerts.columns).alias("row")))
        row = F.col("row")
        by = [row[name].desc_nulls_last() if falling else row[name].asc_nulls_last() for name, falling in self.order]
        aged.orderBy("age", *by).limit(self.keep).select("row.*").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/bank/batch={number}")

    def commit(self, alerts: DataFrame, number: int) -> bool:
        """Writes a batch; False if it is there already, and then only runs it, as the state that it leaves must come to be."""
        before = self.last()
        if number <= before:
            alerts.write.format("noop").mode("overwrite").save()
            return False
        held = self.write_alerts(alerts, number)
        self.write_log(held, number)
        self.write_bank(held, number)
        if not put_once(self.spark, f"{self.folder}/records/{number:0{DIGITS}d}.json", json.dumps({"batch": number, "alerts": held.count(), "before": before})):
            raise RuntimeError(f"another sweep has recorded batch {number} of {self.folder}")
        # Of the banks, the one before is kept for whoever is reading it.
        for name in names_in(self.spark, f"{self.folder}/bank"):
            if name.startswith("batch=") and int(name[6:]) < before:
                remove(self.spark, f"{self.folder}/bank/{name}")
        return True


def alert_rows(items: DataFrame, evaluator: evaluate.Evaluator | None = None, noise: Column | None = None) -> DataFrame:
    """hash, timestamp, source, jurisdiction, title, url, priority, is_duty, duty_type, reference, summary, denominator of items (hash, first_seen, source, jurisdiction, title, summary, url, base).

    The priority is what the evaluation says, else the source's base: the two are never combined.
    """
    found = evaluate.evaluated(items, "title", "summary", F.lit(False) if noise is None else noise, evaluator)
    f = F.col("finding")
    return found.select("hash", F.col("first_seen").alias("timestamp"), "source", F.coalesce("jurisdiction", F.lit("Global")).alias("jurisdiction"), "title", "url", evaluate.priority(f["priority"], F.col("base")).alias("priority"), f["is_duty"].alias("is_duty"), f["duty_type"].alias("duty_type"), f["reference"].alias("reference"), F.substring("summary", 1, 200).alias("summary"), f["denominator"].alias("denominator"))


def sweep(stream: DataFrame, key: Column, at: Column, alerts: Callable[[DataFrame], DataFrame], ledger: Ledger, every: str | None = None, send: Send | None = None) -> StreamingQuery:
    """Starts a sweep: each item that was never seen becomes an alert in the ledger, once.

    ``every``, as "30 minutes", polls for good; without it, what is there now is swept and the query ends. Its state is
    in the ledger's folder, so a sweep that is started again goes on where the last one stopped. ``send``(title, source)
    is called for urgent duties of a batch once that is recorded: after a death at that very point they aren't sent again.
    """

    def write(df: DataFrame, number: int) -> None:
        if ledger.commit(alerts(df), number) and send is not None:
            urgent = ledger.spark.read.parquet(f"{ledger.folder}/alerts/batch={number}").filter("priority <= 2 AND is_duty")
            for r in urgent.orderBy("priority", "title").select("title", "source").toLocalIterator():
                send(r["title"], r["source"])

    rows = first_seen(stream, key, at)
    when = {"processingTime": every} if every else {"availableNow": True}
    with state_store(ledger.spark):
        return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{ledger.folder}/state").trigger(**when).start()
