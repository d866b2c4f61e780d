"""Pages as a data source: hosts apart, pauses, prohibitions, failures as rows, and the spool as a stream."""

import os
import time

from pyspark.sql import functions as F

from claimgraph.sources import web

LOG = "{folder}/log"


class Down(Exception):
    code = 503


def network(folder):
    def transport(url):
        with open(f"{folder}/log", "a") as f:
            f.write(f"{os.getpid()} {time.time()} {url}\n")
        if "down.example" in url:
            raise Down()
        if url == "https://shy.example/robots.txt":
            return "text/plain", b"User-agent: *\nDisallow: /private/\n"
        if url.endswith("/robots.txt"):
            raise TimeoutError()
        if url.endswith("broken"):
            raise ConnectionResetError()
        return "text/html; charset=latin-1", "é".encode("latin-1") * 3

    return transport


URLS = ["https://slow.example/1", "https://slow.example/2", "https://slow.example/3", "https://slow.example/3", "https://down.example/a", "https://down.example/b", "https://shy.example/private/x", "https://shy.example/open", "https://other.example/broken", 'https://other.example/q?a="b"', None]


def rows(df):
    return {r.url: (r.status, r.html) for r in df.collect()}


def test_batch(spark, tmp_path):
    folder = f"file://{tmp_path}/spool"
    spark.dataSource.register(web.page_source(network(tmp_path), "test_pages", delay=0.3))
    read = lambda: spark.read.format("test_pages").option("folder", folder).load()
    assert read().count() == 0
    web.spool(spark.createDataFrame([(u,) for u in URLS], "url string"), folder, files=4)
    got = rows(read())
    assert got == {u: ("ok", "ééé") for u in URLS[:3]} | {u: ("http-503", "") for u in URLS[4:6]} | {URLS[6]: ("robots-disallowed", ""), URLS[7]: ("ok", "ééé"), URLS[8]: ("connectionreseterror", ""), URLS[9]: ("ok", "ééé")}
    asked = [line.split(" ", 2) for line in (tmp_path / "log").read_text().splitlines()]
    slow = [(pid, float(at)) for pid, at, url in asked if "slow.example" in url and "robots" not in url]
    assert len({pid for pid, _ in slow}) == 1 and all(b[1] - a[1] >= 0.29 for a, b in zip(slow, slow[1:], strict=False))
    # One host's rules are asked for once.
    assert sum("shy.example/robots.txt" in url for *_, url in asked) == 1
    assert read().rdd.getNumPartitions() <= 4


def test_stream(spark, tmp_path):
    folder = f"{tmp_path}/spool"
    spark.dataSource.register(web.page_source(network(tmp_path), "test_stream_pages", delay=0.0))

    def run():
        stream = spark.readStream.format("test_stream_pages").option("folder", folder).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.read.parquet(f"{tmp_path}/out").groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok")).orderBy("batch").collect()

    df = lambda urls: spark.createDataFrame([(u,) for u in urls], "url string")
    web.spool(df(URLS[:6]), folder, 0)
    assert [tuple(r) for r in run()] == [(0, 5, 3)]
    web.spool(df(URLS[6:]), folder, 1)
    os.mkdir(f"{folder}/batch=000000000002")  # one that is being written
    assert [tuple(r) for r in run()] == [(0, 5, 3), (1, 4, 2)]
