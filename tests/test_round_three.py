"""Queries against their SQL on rows that the test tables lack."""

import datetime as dt
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import claimgraph.queries as Q
from claimgraph.operators import phrases
from claimgraph.streaming.first_seen import STATE, first_seen, seen_times, state_store
from tests.oracle import compare


def held(spark, tmp_path, name, table, rows, schema):
    """The query's rows on one small table, against its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    compare(Q.QUERIES[name](spark, str(tmp_path)), Q.ORACLES[name], con)


@pytest.mark.parametrize("name", ["q05_readable_text", "q06_page_title"])
def test_references_cut_short(spark, tmp_path, name):
    """a title cut in the middle of a reference, a name that isn't among the few, a number, a reference of a reference, none at all."""
    said = ["a &amp", "a &copy; b &#65; c &#39; d", "&amp;lt; &lt &lt;", "plain", "", "&amp;amp;lt; &quot;x&quot;&nbsp;y"]
    rows = [(i, "u", f"<title>{x}</title><h1>{x}</h1><p>{x}</p>") for i, x in enumerate(said)]
    held(spark, tmp_path, name, "pages", [*rows, (len(rows), "u", None), (len(rows) + 1, "u", "&amp")], "page_id long, url string, html string")


def test_changes_at_a_half(spark, tmp_path):
    """changes that end in 5 round as binary numbers do, and their order goes by what is rounded."""
    rows = [(i, f"n{i}", None, "k", size, price) for i, (size, price) in enumerate([(48, 0.75), (48, 0.65), (48, 0.7), (49, 1.75), (49, 1.65), (48, 0.85), (1, 58.45), (1, 58.35), (1, 58.25), (2, 59.15), (3, None), (None, 1.0)])]
    held(spark, tmp_path, "q111_market_digest", "items", rows, "item_id long, name string, brand string, kind string, size int, price double")


def test_first_sight_by_buckets(spark, tmp_path):
    """F4, F8: the state is called by bucket, however many keys there are; first times and what passes stay the same, also with more mended times than keys."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)

    def run(n, rows):
        spark.createDataFrame(rows, "k int, bucket int, at timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("k int, bucket int, at timestamp_ntz").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        with state_store(spark):
            first_seen(stream, F.col("k").cast("string"), F.col("at"), 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    for n in range(4):
        run(n, [(k, -k, day(40 - 10 * n + k % 5)) for k in range(100)] + [(k, -k, day(99)) for k in range(n, 101 + n)])
    state = spark.read.format("statestore").option("stateVarName", STATE).load(f"{tmp_path}/state")
    assert state.select("key").distinct().count() <= 3
    assert {int(r.hash): r.first_seen for r in seen_times(spark, f"{tmp_path}/state").collect()} == {k: day(10 + k % 5) if k < 100 else day(99) for k in range(104)}
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 104 and out.filter("bucket <> -k").count() == 0
    assert {r.k: r.first_seen for r in out.collect()} == {k: day(40 + k % 5) if k < 100 else day(99) for k in range(104)}


def test_batch_of_texts_in_small_parts():
    """beside the batch, a part of its texts and the hits as numbers are held, not all of them as objects."""
    texts = [f"word{i} and the other " + "x" * 2000 for i in range(8000)]
    column = pa.array([texts[i : i + 4] for i in range(0, len(texts), 4)])
    m = phrases.Matcher([phrases.Pattern("and"), phrases.Pattern("the")])
    tracemalloc.start()
    found = phrases.spots(m, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(map(len, texts)) / 4
    assert found.to_pylist()[7][2] == {"text": 1, "n": 0, "at": len("word29 ")} and len(found) == 2000


def test_pages_are_read_once(spark):
    """pages are dealt over tasks before they are made, and a page's date doesn't stand in the plan once for each use of it."""
    plan = lambda name: Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan("q78_link_kinds") and plan("q107_fresh_items").count("datePublished") < 4
