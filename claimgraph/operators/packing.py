"""Greedy packing of items into prompts under a count and a budget of characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame


def pack(df: DataFrame, key: str, size: str, most: int, budget: int) -> DataFrame:
    """df's key and size with batch: rows of a partition in turn, at most ``most`` and ``budget`` characters a batch; an oversized row has a batch to itself.

    A batch's number tells its partition (the upper bits) and its place there, so no two batches share one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, count, chars = TaskContext.get().partitionId() << 40, 0, 0
        for part in parts:
            out = []
            for n in part[size]:
                if count and (count >= most or chars + n > budget):
                    batch, count, chars = batch + 1, 0, 0
                count, chars = count + 1, chars + int(n)
                out.append(batch)
            yield part.assign(batch=pd.array(out, dtype="int64"))

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {size} {df.schema[size].dataType.simpleString()}, batch long"
    return df.select(key, size).mapInPandas(run, schema)
