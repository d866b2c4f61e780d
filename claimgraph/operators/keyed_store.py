"""A table of rows by key in a folder, merged a part at a time.

Keys are dealt to buckets by a hash. A merge reads and writes the buckets that the new rows touch, into folders of its
own version, and then puts a manifest in place that says which version of each bucket counts; other buckets' files stay
as they are. A job that dies before that leaves the old state, and a second writer of one version is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.storage import Table, names_in, put_once, remove, text_at

DIGITS = 8
#: (old row, new row), structs of which one may be null, to the row that stays; null if none does. A third is what stands beside the new row.
Combine = Callable[..., Column]


@dataclass(frozen=True)
class Arriving:
    """Rows for a merge that are read from tables as they are, so that they needn't be written down first. ``beside`` tells more of keys that they have, one row each: it meets them in the merge itself, and ``combine`` has it as a third row, null where there is none."""

    rows: DataFrame
    beside: DataFrame | None = None


@dataclass(frozen=True)
class KeyedStore:
    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    schema: T.StructType
    buckets: int
    files: int
    version: int = 0
    #: The folder in which each bucket was written last; buckets that never had a row are missing.
    at: dict[int, str] = field(default_factory=dict)
    #: The keys that a bucket goes by; all if none are named.
    by: tuple[str, ...] = ()

    def path(self, bucket: int) -> str:
        return f"{self.folder}/data/{self.at[bucket]}/bucket={bucket}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.by or self.keys]), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of the buckets, of all if none are named."""
        paths = [self.path(b) for b in (sorted(self.at) if buckets is None else buckets) if b in self.at]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def part(self, wanted: DataFrame, columns: Sequence[Column] | None = None) -> DataFrame:
        """The rows of the keys in ``wanted``, which has the columns that a bucket goes by; buckets of none of them aren't read. ``columns``: what of the rows is taken beside those columns, all if nothing is named."""
        names = list(self.by or self.keys)
        one = wanted.select(*[F.col(f"`{k}`") for k in names]).distinct()
        buckets = sorted(r["part"] for r in one.select(self.bucket().alias("part")).distinct().collect() if r["part"] is not None)
        rows = self.rows(buckets)
        return (rows if columns is None else rows.select(*[F.col(f"`{k}`") for k in names], *columns)).join(one, names, "left_semi")

    def merge(self, new: DataFrame | Arriving, combine: Combine) -> KeyedStore:
        """The store after each key of ``new``, of which ``new`` has one row, is combined with what the store has of it.

        Rows without a key, or with a null in it, are passed over. Keys that ``new`` doesn't have keep their rows, and
        buckets of which it has no key their files. ``new`` is written down first, as it is read twice, unless it
        says otherwise.
        """
        beside, written, new = (new.beside, False, new.rows) if isinstance(new, Arriving) else (None, True, new)
        name = self.schema.names
        keyed = lambda df, at: df.select(F.struct(*[F.col(f"`{k}`") for k in self.keys]).alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(at), self.bucket().alias("bucket"))
        arriving = keyed(new, "new").filter(" AND ".join(f"key.`{k}` IS NOT NULL" for k in self.keys))
        table = Table(arriving) if written else None
        incoming = table.df if table else arriving
        touched = sorted(r["bucket"] for r in incoming.select("bucket").distinct().collect())
        if not touched:
            if table:
                table.drop()
            return self
        file = F.pmod(F.xxhash64("key.*"), F.lit(self.buckets * self.files)).alias("file")
        parts = ["old", "new"] if beside is None else ["old", "new", "beside"]
        both = keyed(self.rows(touched).select(*name), "old").unionByName(incoming, allowMissingColumns=True)
        if beside is not None:
            both = both.unionByName(keyed(beside, "beside"), allowMissingColumns=True)
        both = both.select("key", *parts, "bucket", file)
        # Rows go where they will be written and meet there, so that they are sent once.
        met = both.repartition("bucket", "file").groupBy("bucket", "file", "key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts])
        kept = F.when(F.col("new").isNull(), F.col("old")).otherwise(combine(*map(F.col, parts)))
        after = self.version + 1
        dealt = met.select("bucket", kept.cast(self.schema).alias("row")).filter("row IS NOT NULL").select("bucket", "row.*")
        own = f"v={after:0{DIGITS}d}-{uuid.uuid4().hex[:8]}"  # whoever writes the same version writes elsewhere
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/data/{own}")
        there = {int(n[7:]) for n in names_in(self.spark, f"{self.folder}/data/{own}") if n.startswith("bucket=")}
        at = {b: v for b, v in self.at.items() if b not in touched} | dict.fromkeys(there, own)
        done = KeyedStore(self.spark, self.folder, self.keys, self.schema, self.buckets, self.files, after, at, self.by)
        try:
            done._publish()
        except RuntimeError:
            remove(self.spark, f"{self.folder}/data/{own}")
            raise
        for b in touched:
            if b in self.at:
                remove(self.spark, self.path(b))
        if table:
            table.drop()
        return done

    def _publish(self) -> None:
        body = {"keys": self.keys, "schema": self.schema.json(), "buckets": self.buckets, "files": self.files, "by": self.by, "at": {str(b): v for b, v in self.at.items()}}
        if not put_once(self.spark, f"{self.folder}/manifest-{self.version:0{DIGITS}d}.json", json.dumps(body)):
            raise RuntimeError(f"another writer has put version {self.version} of {self.folder} in place")


def created(spark: SparkSession, folder: str, keys: Sequence[str], schema: T.StructType | str, buckets: int = 64, files: int = 1, by: Sequence[str] = ()) -> KeyedStore:
    """An empty store. Buckets go by the keys named in ``by``, or by all. ``buckets`` is how finely merges are told apart, ``files`` how many files a bucket is written in; both stay as they are."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    store = KeyedStore(spark, folder.rstrip("/"), tuple(keys), kind, buckets, files, by=tuple(by))
    store._publish()
    return store


def opened(spark: SparkSession, folder: str) -> KeyedStore:
    """The store in a folder, as its last manifest has it."""
    found = [n for n in names_in(spark, folder) if n.startswith("manifest-")]
    if not found:
        raise FileNotFoundError(f"no manifest in {folder}")
    body = json.loads(text_at(spark, f"{folder.rstrip('/')}/{found[-1]}"))
    return KeyedStore(spark, folder.rstrip("/"), tuple(body["keys"]), T.StructType.fromJson(json.loads(body["schema"])), body["buckets"], body["files"], int(found[-1][9 : 9 + DIGITS]), {int(b): v for b, v in body["at"].items()}, tuple(body["by"]))
