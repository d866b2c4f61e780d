"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, else the folder given to setCheckpointDir; a temporary folder only if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"file://{tempfile.gettempdir()}"


class Table:
    """A DataFrame written to the shared folder, and what was read back; ``drop`` deletes it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/claimgraph-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` by way of a table in the shared folder, so that its lineage is cut and its size known to the planner."""
    return Table(df).df


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_once(spark: SparkSession, path: str, body: str) -> bool:
    """Puts a small text at ``path`` by one rename, so that it is there whole or not at all; False if something is there already."""
    fs, place = _at(spark, path)
    _, draft = _at(spark, f"{path.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(body.encode()))
    out.close()
    if not fs.exists(place) and fs.rename(draft, place):
        return True
    fs.delete(draft, False)
    return False


def text_at(spark: SparkSession, path: str) -> str:
    """A small text, whole."""
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if it isn't there."""
    fs, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)
