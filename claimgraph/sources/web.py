"""Pages of the network as a data source, read in parallel by host and politely within one.

URLs are spooled: written, dealt by host, as files of lines in the shared folder, a batch at a time. A file is a
partition of the source, so a host is read by one task, which can leave a pause between its pages, and the driver sees
names of files and never a URL. The same spool is read as a batch or as a stream; a stream's offset is the last batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from claimgraph.functions.urls import hostname
from claimgraph.sources.adapters import Transport, page

SCHEMA = "url string, html string, status string, batch long"
DIGITS = 12


def spool(urls: DataFrame, folder: str, batch: int = 0, files: int | None = None) -> None:
    """Puts each distinct url of ``urls`` into a batch of the spool; the urls of a host come into one file. A batch that is put in again is replaced."""
    n = files or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = urls.filter("url IS NOT NULL").select("url").distinct().withColumn("host", F.coalesce(hostname(F.col("url")), F.lit("")))
    dealt = named.repartition(n, "host").sortWithinPartitions("host", "url")
    dealt.select(F.to_json(F.struct("url")).alias("value")).write.mode("overwrite").text(f"{folder.rstrip('/')}/batch={batch:0{DIGITS}d}")


class Robots:
    """What hosts let a reader see. Rules that can't be fetched forbid nothing."""

    def __init__(self, transport: Transport, agent: str):
        self.transport, self.agent, self.rules = transport, agent, {}

    def allow(self, url: str) -> bool:
        parts = urlsplit(url)
        root = f"{parts.scheme}://{parts.netloc}"
        if root not in self.rules:
            try:
                rules = RobotFileParser()
                rules.parse(self.transport(f"{root}/robots.txt")[1].decode("utf-8", "replace").splitlines())
                self.rules[root] = rules
            except Exception:  # noqa: BLE001 - no rules, no prohibition
                self.rules[root] = None
        return self.rules[root] is None or self.rules[root].can_fetch(self.agent, url)


@dataclass
class SpoolFile(InputPartition):
    path: str
    batch: int


class Spool:
    """The files of a spool, in any file system that Arrow knows."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.at = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

    def batches(self) -> list[int]:
        """The numbers of the batches that are whole."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.at, allow_not_found=True))
        return sorted(int(f.base_name[6:]) for f in found if f.base_name.startswith("batch=") and self.fs.get_file_info(f"{f.path}/_SUCCESS").is_file)

    def files(self, batch: int) -> list[SpoolFile]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.at}/batch={batch:0{DIGITS}d}"))
        return [SpoolFile(f.path, batch) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.size and f.base_name.startswith("part-")]

    def urls(self, file: SpoolFile) -> Iterator[str]:
        import io

        with self.fs.open_input_stream(file.path) as raw:
            for line in io.TextIOWrapper(io.BufferedReader(raw), "utf-8", newline="\n"):
                yield json.loads(line)["url"]


def fetched(spool: Spool, file: SpoolFile, transport: Transport, agent: str, delay: float) -> Iterator[tuple]:
    """(url, html, status, batch) for each url of a file, whatever becomes of it; ``delay`` seconds lie between two pages of a host."""
    robots, last = Robots(transport, agent), {}
    for url in spool.urls(file):
        host = urlsplit(url).netloc
        if not robots.allow(url):
            yield url, "", "robots-disallowed", file.batch
            continue
        time.sleep(max(0.0, last.get(host, -delay) + delay - time.monotonic()))
        html, status = page(url, transport)
        last[host] = time.monotonic()
        yield url, html, status, file.batch


def page_source(transport: Transport, kind: str = "pages", agent: str = "claimgraph", delay: float = 1.5) -> type[DataSource]:
    """A data source to register with a session; then ``spark.read.format(kind).option("folder", spool).load()``, or ``readStream``.

    Rows have url, html, status ("ok", "robots-disallowed", "not-html", "http-<code>", or the error's name) and batch.
    A page that fails is a row, and doesn't touch the rest. A batch of a stream that is run again asks for its pages again.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["folder"])

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self.options["folder"])

    class Reader(DataSourceReader):
        def __init__(self, folder: str):
            self.folder = folder

        def partitions(self) -> list[InputPartition]:
            spool = Spool(self.folder)
            return [f for b in spool.batches() for f in spool.files(b)] or [SpoolFile("", -1)]

        def read(self, partition: SpoolFile) -> Iterator[tuple]:
            return fetched(Spool(self.folder), partition, transport, agent, delay) if partition.path else iter(())

    class StreamReader(DataSourceStreamReader):
        def __init__(self, folder: str):
            self.folder = folder

        def initialOffset(self) -> dict:
            return {"batch": -1}

        def latestOffset(self) -> dict:
            return {"batch": max(Spool(self.folder).batches(), default=-1)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            spool = Spool(self.folder)
            return [f for b in spool.batches() if start["batch"] < b <= end["batch"] for f in spool.files(b)] or [SpoolFile("", -1)]

        def read(self, partition: SpoolFile) -> Iterator[tuple]:
            return fetched(Spool(self.folder), partition, transport, agent, delay) if partition.path else iter(())

    return Pages
