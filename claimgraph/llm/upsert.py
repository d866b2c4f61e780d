"""Copy-on-write upsert into sorted Parquet files by key.

A store is a folder of Parquet files, each sorted and following on the one before, and a manifest of them: path, first
key, number of rows. A key's home is the last file that begins at or below it, else the first. An upsert reduces the
changes to one for each key, cogroups each home's rows with its changes by a secondary sort, and runs two pointers over
both: they meet as neighbours of one sorted stream, so a task holds a batch and never a home. Only homes that differ
afterwards are written anew, by one task a file; the driver sees a line for each file and no more.

New files are written beside the old ones, then the next manifest is put in place by one rename, then the old files go:
whoever reads by the manifest sees one version or the other, and a job that dies on the way leaves the old one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.llm.common import quoted, whole
from claimgraph.storage import Table, shared_folder

SET, DELETE = 1, 2
#: The low bits of monotonically_increasing_id number the rows of a partition.
ROW_BITS = 33


@dataclass(frozen=True)
class DataFile:
    path: str
    first: int | str
    rows: int
    rewritten: bool = False


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    folder: str
    key: str
    most: int
    schema: T.StructType
    files: tuple[DataFile, ...]
    version: int = 0

    def rows(self, files: Sequence[DataFile] | None = None) -> DataFrame:
        """The rows of the files, all if none are named, and ``_metadata`` on demand."""
        paths = [f.path for f in (self.files if files is None else files)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _publish(store: Store) -> Store:
    """Puts the store's manifest in place; raises if this version is there already."""
    body = json.dumps({"key": store.key, "most": store.most, "schema": store.schema.json(), "files": [asdict(f) for f in store.files]})
    fs, draft = _hadoop(store.spark, f"{store.folder}/_manifest-draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(body.encode()))
    out.close()
    _, place = _hadoop(store.spark, f"{store.folder}/_manifest-{store.version:08d}.json")
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has put version {store.version} of {store.folder} in place")
    return store


def opened(spark: SparkSession, folder: str) -> Store:
    """The store in a folder, as its last manifest has it."""
    fs, at = _hadoop(spark, folder)
    names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(at)) if n.startswith("_manifest-") and n.endswith(".json"))
    if not names:
        raise FileNotFoundError(f"no manifest in {folder}")
    _, place = _hadoop(spark, f"{folder}/{names[-1]}")
    stream = fs.open(place)
    body = json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    stream.close()
    files = tuple(DataFile(**f) for f in body["files"])
    return Store(spark, folder, body["key"], body["most"], T.StructType.fromJson(json.loads(body["schema"])), files, int(names[-1][10:18]))


def _listed(spark: SparkSession, folder: str, key: str, schema: T.StructType, known: set[str]) -> list[DataFile]:
    """The files of a folder that aren't known yet, in order of their rows."""
    rows = spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col(quoted(key)).alias("key"))
    found = rows.groupBy("path").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("rows")).collect()
    return [DataFile(r["path"], r["first"], r["rows"]) for r in sorted(found, key=lambda r: (r["first"], r["last"], r["path"])) if r["path"] not in known]


def _write(rows: DataFrame, files: int, folder: str) -> None:
    """(no, key, row): each number's rows as one sorted file, by one task."""
    placed = rows.repartitionById(files, F.col("no").cast("int")).sortWithinPartitions("no", "key").select("row.*")
    placed.write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)


def create(df: DataFrame, key: str, most: int, folder: str | None = None) -> Store:
    """A new store of the rows of ``df``, sorted by ``key`` (a whole number or a string), ``most`` rows to a file, the last file the rest.

    Rows are counted by ranges of the key, so no task holds more than a range or a file. Keys are meant to be unique;
    rows that repeat one all stay. Rows without a key have no place and are left out. Other columns may have any names
    and types, also nulls. An empty table makes a store without files.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    rows = df.select(F.col(quoted(key)).alias("key"), whole(df).alias("row")).filter(F.col("key").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = Table(rows.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", ROW_BITS).cast("int")
    counts = {r["part"]: r["n"] for r in table.df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    _hadoop(spark, folder)[0].mkdirs(_hadoop(spark, folder)[1])
    if total:
        rank = F.lit(before)[part] + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        _write(table.df.select(F.floor(rank / F.lit(most)).alias("no"), "key", "row"), -(-total // most), folder)
    table.drop()
    files = _listed(spark, folder, key, df.schema, set()) if total else []
    return _publish(Store(spark, folder, key, most, df.schema, tuple(files)))


def reduced(changes: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """(key, change): the row of each key that is highest by ``version``; of rows alike in that, the highest by the other columns that can be compared."""
    others = [f.name for f in changes.schema.fields if f.name not in version and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    height = F.struct(*[F.col(quoted(c)) for c in [*version, *others]])
    keyed = changes.select(F.col(quoted(key)).alias("key"), whole(changes).alias("change"), height.alias("height")).filter(F.col("key").isNotNull())
    return keyed.groupBy("key").agg(F.max_by("change", "height").alias("change"))


def _homes(firsts: list) -> Callable[[Column], Column]:
    """The number of the last file that begins at or below a key, else 0; the list has an entry for each file, as the driver's manifest."""
    begins = np.array(firsts, np.int64 if all(isinstance(x, int) for x in firsts) else object)

    @F.pandas_udf("int")
    def home(keys):
        import pandas as pd

        return pd.Series(np.maximum(np.searchsorted(begins, keys.to_numpy(begins.dtype), "right") - 1, 0).astype(np.int32))

    return home


def _differs(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Where two columns differ; nulls are equal, and so are NaNs."""
    if not len(a):
        return np.zeros(0, bool)
    try:
        unequal = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(a.type):
            unequal = pc.and_(unequal, pc.invert(pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))))
        return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy()
    except pa.ArrowNotImplementedError:
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])


class _Merge:
    """Two pointers over (home, key, side): a key's change comes before its rows. State: the home, the rows it has given, whether it differs."""

    def __init__(self, columns: list[str], sets: list[str], schema: pa.Schema):
        self.columns, self.sets, self.schema = columns, sets, schema
        self.home, self.n, self.dirty = None, 0, False

    def end(self) -> pa.Table:
        """A line for the home that is done: its number of rows, and whether it differs."""
        one = {"home": [self.home], "rank": [None], "n": [self.n], "dirty": [self.dirty]}
        return pa.table({f.name: pa.array(one.get(f.name, [None]), f.type) for f in self.schema}, self.schema)

    def step(self, t: pa.Table) -> Iterator[pa.Table]:
        """Rows of whole keys."""
        home, side, act = (t[c].to_numpy() for c in ("home", "side", "act"))
        first = np.ones(len(t), bool)
        first[1:] = (home[1:] != home[:-1]) | pc.not_equal(t["key"].slice(1), t["key"].slice(0, len(t) - 1)).to_numpy()
        begin = np.flatnonzero(first)[np.cumsum(first) - 1]  # of each row's key
        last = np.append(first[1:], True)
        verdict = np.where(side[begin] == 0, act[begin], 0)
        insert = (side == 0) & (act == SET) & last
        own, updated = side == 1, (side == 1) & (verdict == SET)
        changed = np.zeros(len(t), bool)
        at = np.flatnonzero(updated)
        for c in self.sets:
            changed[at] |= _differs(t[c].take(pa.array(at)), t[c].take(pa.array(begin[at])))
        dirty = changed | insert | (own & (verdict == DELETE))
        keep = np.flatnonzero(insert | (own & (verdict != DELETE)))
        source = np.where(updated, begin, np.arange(len(t)))[keep]
        starts = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        for i, j in zip(starts, np.append(starts[1:], len(t)), strict=True):
            if home[i] != self.home:
                if self.home is not None:
                    yield self.end()
                self.home, self.n, self.dirty = int(home[i]), 0, False
            a, b = np.searchsorted(keep, (i, j))
            self.dirty |= bool(dirty[i:j].any())
            if a < b:
                rows, values = pa.array(keep[a:b]), pa.array(source[a:b])
                none = pa.nulls(b - a)
                out = {"home": t["home"].take(rows), "rank": pa.array(np.arange(self.n, self.n + b - a)), "n": none, "dirty": none, "key": t["key"].take(rows)}
                out |= {c: t[c].take(values if c in self.sets else rows) for c in self.columns}
                yield pa.table({f.name: out[f.name].cast(f.type) for f in self.schema}, self.schema)
            self.n += int(b - a)


def _merger(columns: list[str], sets: list[str], out: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        held: list[pa.Table] = []
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            if schema is None:
                own = to_arrow_schema(out)
                schema = pa.schema([pa.field(f.name, t.schema.field(f.name).type if f.name in t.schema.names else f.type) for f in own])
                merge = _Merge(columns, sets, schema)
            # The last key may go on in the next batch.
            edge = pc.or_(pc.not_equal(t["home"], t["home"][-1]), pc.not_equal(t["key"], t["key"][-1])).to_numpy()
            cut = int(np.flatnonzero(edge)[-1]) + 1 if edge.any() else 0
            if cut:
                for x in merge.step(pa.concat_tables([*held, t.slice(0, cut)])):
                    yield from x.combine_chunks().to_batches()
                held = [t.slice(cut)]
            elif held and (held[-1]["home"][-1] != t["home"][-1] or held[-1]["key"][-1] != t["key"][-1]):
                for x in merge.step(pa.concat_tables(held)):
                    yield from x.combine_chunks().to_batches()
                held = [t]
            else:
                held.append(t)
        if held:
            for x in merge.step(pa.concat_tables(held)):
                yield from x.combine_chunks().to_batches()
        if schema is not None and merge.home is not None:
            yield from merge.end().combine_chunks().to_batches()

    return run


def folded(files: Sequence[DataFile], done: dict[int, int], most: int) -> tuple[list[DataFile | int], dict[int, tuple[int, int, list[int]]]]:
    """The manifest after an upsert: (old files, and the numbers of rows of new ones, in order; by home the larger size less one, how many are larger, and the new files' numbers).

    ``done`` has the rows of each home that differs. They make the fewest files of ``most`` rows, sizes at most one
    apart, larger first; then, ascending, each new file joins the one left of it if that is new too and both fit one file.
    """
    out: list[DataFile | int] = []
    where: dict[int, tuple[int, int, list[int]]] = {}
    new = 0
    for home, file in enumerate(files):
        if home not in done:
            out.append(file)
            continue
        pieces = -(-done[home] // most)
        size, larger = divmod(done[home], pieces) if pieces else (0, 0)
        numbers = []
        for p in range(pieces):
            n = size + (p < larger)
            if out and isinstance(out[-1], int) and out[-1] + n <= most:
                out[-1] += n
            else:
                out.append(n)
                new += 1
            numbers.append(new - 1)
        where[home] = (size, larger, numbers)
    return out, where


def upsert(store: Store, changes: DataFrame, sets: Sequence[str], version: Sequence[str], decide: Callable[[DataFrame], Column]) -> Store:
    """The store after ``changes``, and its folder brought to that state.

    Of each key's changes the highest by ``version`` wins (nulls are lowest; rows alike in it are told apart by their
    other columns). ``decide`` makes of the winning rows, beside ``first`` (their home's first key) and ``change`` (the
    row), a column: SET takes over the columns ``sets``, nulls too, and adds a row of an absent key with the other
    columns null; DELETE removes; null or any other value leaves the change out. Changes without a key are left out, and
    of a store without files, which has no homes, all are. A home whose rows come out equal, nulls and NaNs being equal,
    keeps its file. Repeats of one change count once; columns of ``changes`` that aren't named have no effect.
    """
    spark, names = store.spark, [f.name for f in store.schema.fields]
    if not store.files:
        return store
    firsts = [f.first for f in store.files]
    homed = reduced(changes, store.key, version).withColumn("home", _homes(firsts)("key")).withColumn("first", F.lit(firsts)[F.col("home")])
    wins = Table(homed.withColumn("act", decide(homed).cast("byte")).filter(F.col("act").isin(SET, DELETE)).select("home", "key", "act", "change"))
    touched = sorted(r["home"] for r in wins.df.select("home").distinct().collect())
    if not touched:
        wins.drop()
        return store
    plain = {c: f"c{i}" for i, c in enumerate(names)}  # no name of the store's can clash
    of_change = [F.col(f"change.{quoted(c)}").cast(store.schema[c].dataType) if c in sets else F.col("key").cast(store.schema[c].dataType) if c == store.key else F.lit(None).cast(store.schema[c].dataType) for c in names]
    left = wins.df.select("home", "key", F.lit(0).cast("byte").alias("side"), "act", *[v.alias(plain[c]) for c, v in zip(names, of_change, strict=True)])
    # A line for each touched file, of which the driver's manifest has one as well.
    numbers = F.broadcast(spark.createDataFrame([(h, store.files[h].path) for h in touched], "home int, path string"))
    held = store.rows([store.files[h] for h in touched]).select(F.col("_metadata.file_path").alias("path"), F.col(quoted(store.key)).alias("key"), *[F.col(quoted(c)).alias(plain[c]) for c in names])
    right = held.join(numbers, "path").select("home", "key", F.lit(1).cast("byte").alias("side"), F.lit(0).cast("byte").alias("act"), *plain.values())
    both = left.withColumn("key", F.col("key").cast(store.schema[store.key].dataType)).unionByName(right).repartition("home").sortWithinPartitions("home", "key", "side")
    fields = [T.StructField(plain[c], store.schema[c].dataType) for c in names]
    schema = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("n", T.LongType()), T.StructField("dirty", T.BooleanType()), T.StructField("key", store.schema[store.key].dataType), *fields])
    merged = Table(both.mapInArrow(_merger(list(plain.values()), [plain[c] for c in sets], schema), schema))
    done = {r["home"]: r["n"] for r in merged.df.filter("rank IS NULL AND dirty").select("home", "n").collect()}
    manifest, where = folded(store.files, done, store.most)
    sizes = [x for x in manifest if isinstance(x, int)]
    if sizes:
        lines = F.broadcast(spark.createDataFrame([(h, *w) for h, w in where.items() if w[2]], "home int, size long, larger long, numbers array<int>"))
        edge = F.col("larger") * (F.col("size") + 1)
        piece = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (F.col("size") + 1))).otherwise(F.col("larger") + F.floor((F.col("rank") - edge) / F.col("size"))).cast("int")
        row = F.struct(*[F.col(plain[c]).alias(c) for c in names])
        _write(merged.df.filter("rank IS NOT NULL").join(lines, "home").select(F.col("numbers")[piece].alias("no"), "key", row.alias("row")), len(sizes), store.folder)
    new = _listed(spark, store.folder, store.key, store.schema, {f.path for f in store.files}) if sizes else []
    if [f.rows for f in new] != sizes:
        raise RuntimeError("the files written are not those of the manifest")
    fresh = iter(new)
    files = tuple(DataFile((f := next(fresh)).path, f.first, f.rows, True) if isinstance(x, int) else x for x in manifest)
    after = _publish(Store(spark, store.folder, store.key, store.most, store.schema, files, store.version + 1))
    for home in done:
        fs, path = _hadoop(spark, store.files[home].path)
        fs.delete(path, False)
    for table in (wins, merged):
        table.drop()
    return after


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by path and place: for each path its first id, and digests of its rows in order."""
    path, first, n, cents, crc, ids = None, 0, 0, 0, 0, None
    done: list[tuple] = []
    for b in batches:
        paths = b["path"].to_pylist()
        starts = [0, *[i for i in range(1, len(paths)) if paths[i] != paths[i - 1]], len(paths)]
        for i, j in zip(starts, starts[1:], strict=False):
            if i == j:
                continue
            own = b["id"].slice(i, j - i).to_pylist()
            if paths[i] != path:
                if path is not None:
                    done.append((path, first, n, cents, crc, ids.hexdigest()))
                path, first, n, cents, crc, ids = paths[i], own[0], 0, 0, 0, hashlib.sha256()
            ids.update(((b"," if n else b"") + ",".join(map(str, own)).encode()))
            n += j - i
            cents += pc.sum(b["cents"].slice(i, j - i)).as_py()
            crc += pc.sum(b["crc"].slice(i, j - i)).as_py()
    if path is not None:
        done.append((path, first, n, cents, crc, ids.hexdigest()))
    names = ["path", "first_id", "n_rows", "cents", "rows_crc", "ids_sha256"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)


def op11(clients: DataFrame, changes: DataFrame, least_files: int = 1500) -> DataFrame:
    """The columns of the contract, a row for each file that the folder has after the upsert."""
    spark = clients.sparkSession
    digest = lambda c: F.crc32(c.cast("string"))
    store = create(clients.filter(digest(F.col("client_id")) % 7 > 3), "client_id", 1 + clients.count() // least_files, f"{shared_folder(spark)}/op11-{uuid.uuid4().hex}")
    h = digest(F.col("first")) % 10
    removes = F.coalesce(F.col("change.op") == "D", F.lit(False)) | F.coalesce(digest(F.col("change.change_id")) % 8 < h, F.lit(False))
    after = upsert(store, changes, ["source", "segment", "city", "balance"], ["seq", "change_id"], lambda _: F.when(h > 7, None).when(removes, DELETE).otherwise(SET))
    if not after.files:
        return spark.createDataFrame([], "path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, rewritten boolean")
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source", "segment", "city")])
    cents = F.when(F.isnan("balance"), 0).otherwise(F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0)))
    rows = after.rows().select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"), F.col("client_id").alias("id"), cents.cast("long").alias("cents"), F.crc32(text).alias("crc"))
    found = rows.repartition("path").sortWithinPartitions("path", "place").select("path", "id", "cents", "crc").mapInArrow(_digested, "path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string")
    # Files of one writing have one schema, which is read from one of them.
    columns = {k: ",".join(spark.read.parquet(next(f.path for f in after.files if f.rewritten == k)).columns) for k in {f.rewritten for f in after.files}}
    lines = spark.createDataFrame([(f.path, columns[f.rewritten], f.rewritten) for f in after.files], "path string, columns string, rewritten boolean")
    return found.join(F.broadcast(lines), "path")
