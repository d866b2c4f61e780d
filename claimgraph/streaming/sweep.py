"""A sweep over a growing source as a stream: items not seen before pass once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.storage import shared_folder


def digest(*parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("_", *parts), 256)


def unseen(stream: DataFrame, key: Column) -> DataFrame:
    """The stream's rows by first sight of their digest. The seen-set is kept for good, as undated items must not return."""
    return stream.withColumn("hash", key).dropDuplicates(["hash"])


def drain(stream: DataFrame, name: str = "sweep") -> DataFrame:
    """One sweep: all there is now, written to the shared folder, exactly once by the checkpoint; read back."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
