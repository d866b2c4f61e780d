"""First sight and its time over restarts, and a sweep that dies between two writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import evaluate
from claimgraph.streaming import ledger, sweep
from claimgraph.streaming.first_seen import first_seen, seen_times, state_store

SCHEMA = "source string, title string, summary string, url string, jurisdiction string, base int, at timestamp_ntz"


def notice(title, day, summary="nothing", base=3):
    return ("Gazette", title, summary, None, None, base, None if day is None else dt.datetime(2024, 1, day))


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n}")


def stream(spark, folder, files=1000):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def test_first_seen_over_restarts(spark, tmp_path):
    def run():
        seen = first_seen(stream(spark, tmp_path), sweep.digest("title"), F.col("at"))
        with state_store(spark):
            query = seen.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        times = {r.hash: r.first_seen for r in seen_times(spark, f"{tmp_path}/state").collect()}
        out = spark.read.parquet(f"{tmp_path}/out")
        return {r.title: times[r.hash] for r in out.collect()}, [r.title for r in out.collect()]

    day = lambda n: dt.datetime(2024, 1, n)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put(spark, tmp_path, 1, [notice("a", 5), notice("a", 3), notice("b", 9), notice("undated", None), *[notice("hot", d % 20 + 2) for d in range(500)]])
    held, out = run()
    assert held == {"a": day(3), "b": day(9), "undated": None, "hot": day(2)} and len(out) == 4
    # A restart: what was seen doesn't pass again; an earlier time that comes late mends the one held, a later one doesn't.
    put(spark, tmp_path, 2, [notice("a", 1), notice("b", 20), notice("undated", 7), notice("c", None), notice("c", 4)])
    held, out = run()
    assert held == {"a": day(1), "b": day(9), "undated": day(7), "c": day(4), "hot": day(2)} and len(out) == 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


class Killed(ledger.Ledger):
    """Dies once, in the batch and at the write that are named."""

    def __init__(self, *args, at, batch, **more):
        super().__init__(*args, **more)
        self.at, self.batch, self.died = at, batch, False

    def die(self, at, number):
        if (at, number) == (self.at, self.batch) and not self.died:
            self.died = True
            raise RuntimeError(f"killed at {at}")

    def write_log(self, alerts, number):
        self.die("log", number)
        super().write_log(alerts, number)

    def write_bank(self, alerts, number):
        self.die("bank", number)
        super().write_bank(alerts, number)
        self.die("record", number)

    def commit(self, alerts, number):
        done = super().commit(alerts, number)
        self.die("commit", number)
        return done


@pytest.mark.parametrize("at", ["log", "bank", "record", "commit"])
def test_killed_and_restarted(spark, tmp_path, at):
    put(spark, tmp_path, 1, [notice("Order one", 1, "a rule"), notice("two", 2)])
    book = Killed(spark, f"{tmp_path}/book", at=at, batch=1, keep=3)
    start = lambda b, told: ledger.sweep(stream(spark, tmp_path), sweep.digest("title"), F.col("at"), ledger.alert_rows, b, send=lambda *x: told.append(x))
    told: list = []
    start(book, told).awaitTermination()
    assert told == [("Order one", "Gazette")]
    put(spark, tmp_path, 2, [notice("two", 3), notice("three", 4), notice("Final rule on it", 5)])
    with pytest.raises(Exception, match="killed"):
        start(book, told).awaitTermination()
    assert book.died
    # What a reader sees meanwhile is whole batches.
    assert sorted(r.title for r in book.alerts().collect()) == (["Final rule on it", "Order one", "three", "two"] if at == "commit" else ["Order one", "two"])
    again = ledger.Ledger(spark, f"{tmp_path}/book", keep=3)
    start(again, told).awaitTermination()
    assert sorted(r.title for r in again.alerts().collect()) == ["Final rule on it", "Order one", "three", "two"]
    assert again.log().count() == 4
    assert [r.title for r in again.bank().collect()] == ["Final rule on it", "three", "two"]
    assert again.last() == 1 and again.record(1)["alerts"] == 2
    assert told.count(("Order one", "Gazette")) == 1 and told.count(("Final rule on it", "Gazette")) == (0 if at == "commit" else 1)


def test_polls(spark, tmp_path):
    put(spark, tmp_path, 1, [notice("one", 1)])
    book = ledger.Ledger(spark, f"{tmp_path}/book")
    query = ledger.sweep(stream(spark, tmp_path), sweep.digest("title"), F.col("at"), ledger.alert_rows, book, every="1 second")
    try:
        query.processAllAvailable()
        put(spark, tmp_path, 2, [notice("one", 2), notice("two", 2)])
        query.processAllAvailable()
        assert sorted(r.title for r in book.alerts().collect()) == ["one", "two"]
    finally:
        query.stop()


def test_priority(spark):
    rows = spark.createDataFrame([(None, 1), (0, 2), (4, 1), (2, 5)], "score int, base int")
    assert [r[0] for r in rows.select(evaluate.priority(F.col("score"), F.col("base"))).collect()] == [1, 2, 4, 2]
