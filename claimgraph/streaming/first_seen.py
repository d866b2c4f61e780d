"""Items of a stream by first sight, with the time at which each was first seen."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from claimgraph.operators.relational import unused

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "first"


@contextmanager
def state_store(spark: SparkSession):
    """Streams that are started herein keep their state in RocksDB, on disk and in the checkpoint; the session's own setting comes back."""
    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, held) if held else spark.conf.unset(PROVIDER)


def earliest(rows: pd.DataFrame) -> pd.DataFrame:
    """The first row of each hash by time, those without a time last; of equal times the first there is."""
    return rows.sort_values("first_seen", kind="stable", na_position="last").drop_duplicates("hash")


def combined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        yield earliest(rows)


def plain(value):
    """A value of a frame as Python has it; None if there is none."""
    return None if pd.isna(value) else value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


class FirstSeen(StatefulProcessor):
    """Holds the first time of each hash of a bucket, as a list of hashes and times; the least time of a hash counts. A hash passes once; a row that comes later but is of an earlier time mends the time that is held."""

    def __init__(self, kind: str, columns: list[str]):
        self.kind, self.columns = kind, columns

    def init(self, handle) -> None:
        self.first = handle.getListState(STATE, f"hash string, at {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            best = earliest(part if best is None else pd.concat([best, part], ignore_index=True))
        held, entries = {}, 0
        for name, at in self.first.get():
            name, at, entries = plain(name), plain(at), entries + 1
            before = held.get(name)
            held[name] = at if before is None else before if at is None else min(at, before)
        fresh, more = [], []
        for name, at in zip(map(plain, best["hash"]), map(plain, best["first_seen"]), strict=True):
            fresh.append(name not in held)
            if fresh[-1] or at is not None and (held[name] is None or at < held[name]):
                held[name] = at
                more.append((name, at))
        if entries + len(more) > 2 * len(held) + 16:  # mostly times that were mended
            self.first.put(list(held.items()))
        elif more:
            self.first.appendList(more)
        if any(fresh):
            yield best[fresh][self.columns]

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: Column, at: Column, buckets: int = 1 << 12) -> DataFrame:
    """hash, first_seen, and the columns of ``stream``: each key's first row, once and for good.

    The times are kept for good, as an undated item must not come back. Of one batch's rows of a key the earliest by
    ``at`` passes, those without a time last. Rows of one key are brought down to one before the shuffle, so that a hot
    key costs what a task's share of it costs. Columns named as the two results are replaced; columns are of plain types.
    Start the query within ``state_store``.

    The state is held by ``buckets`` of hashes, as calling Python and reading its state costs milliseconds each time: a
    batch has at most so many calls, however many keys it has. A bucket's times are read whole when one of its keys
    comes. The number stays as it is for a checkpoint's life.
    """
    others = [c for c in stream.columns if c not in ("hash", "first_seen")]
    rows = stream.select(key.alias("hash"), at.alias("first_seen"), *[F.col(f"`{c}`") for c in others])
    kind = rows.schema["first_seen"].dataType
    bucket = unused("bucket", rows)
    keyed = rows.mapInPandas(combined, rows.schema).withColumn(bucket, F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int"))
    return keyed.groupBy(bucket).transformWithStateInPandas(FirstSeen(kind.simpleString(), rows.columns), rows.schema, "Append", "none")


def seen_times(spark: SparkSession, checkpoint: str) -> DataFrame:
    """hash, first_seen: all that a stream of ``first_seen`` has seen, from the state in its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.select("list_element.*").groupBy("hash").agg(F.min("at").alias("first_seen"))
