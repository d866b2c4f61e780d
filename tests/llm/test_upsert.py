"""Copy-on-write upsert against plain Python, and at its edges."""

import os

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimgraph.llm import upsert
from claimgraph.llm.queries import QUERIES
from claimgraph.llm.upsert import DELETE, SET, DataFile, folded
from tests.llm.brute_upsert import COLUMNS, brute, crc

CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGE = "change_id long, client_id long, seq long, op string, source string, segment string, city string, balance double"


def held(got, want):
    got = sorted((r.asDict() for r in got), key=lambda r: r["first_id"])
    assert [{k: g[k] for k in w} for g, w in zip(got, want, strict=True)] == want
    files = {g["path"].removeprefix("file:").replace("///", "/") for g in got}
    if files:
        folder = os.path.dirname(next(iter(files)))
        assert {f"{folder}/{f}" for f in os.listdir(folder) if not f.startswith((".", "_"))} == files
    return got


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = held(QUERIES["op11_upsert"](spark, d).collect(), brute(d))
    assert 0 < sum(g["rewritten"] for g in got) < len(got)
    # What the files hold, read by other means.
    for g in got[:3]:
        t = pq.ParquetFile(g["path"].removeprefix("file:")).read()
        assert t.column_names == COLUMNS and t["client_id"].to_pylist() == sorted(t["client_id"].to_pylist()) and t["client_id"][0].as_py() == g["first_id"]


def test_large_files_and_many_inserts(spark):
    clients = [(i, i, "crm", None, None, None, "x", 1, None if i % 5 == 0 else "retail", None if i % 7 == 0 else i / 8) for i in range(0, 6000, 3)]
    changes = [(n, (n * 37) % 9000 - 50, n % 4, "D" if n % 6 == 0 else "U", "web", None if n % 3 else "retail", "y", n / 16) for n in range(3000)]
    # A hot key, repeats, a change that changes nothing, and inserts by the hundred beyond the last file.
    changes += [(5000 + n, 9, n, "U", "hot", None, None, None) for n in range(2000)] * 2 + [(9000 + n, 20_000 + n, 0, "I", "new", "s", "c", 1.0) for n in range(500)]
    held(upsert.op11(spark.createDataFrame(clients, CLIENT), spark.createDataFrame(changes, CHANGE)).collect(), brute(clients=[dict(zip(COLUMNS, c, strict=True)) for c in clients], changes=[dict(zip(("change_id", "client_id", "seq", "op", "source", "segment", "city", "balance"), c, strict=True)) for c in changes]))


def test_edges(spark):
    empty, none = spark.createDataFrame([], CLIENT), spark.createDataFrame([], CHANGE)
    some = spark.createDataFrame([(i, 0, None, None, None, None, None, None, None, float("nan")) for i in range(40)], CLIENT).select("*", F.lit(1).alias("key"), F.lit(2).alias("a.b"))
    assert upsert.op11(empty, none).count() == 0
    assert upsert.op11(empty, spark.createDataFrame([(1, 1, 1, "I", None, None, None, None)], CHANGE)).count() == 0
    kept = upsert.op11(some, none).collect()
    assert sum(r.n_rows for r in kept) == sum(crc(i) % 7 > 3 for i in range(40)) and not any(r.rewritten for r in kept) and kept[0].columns.endswith("balance,key,a.b")
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None), (None, 3, None, None, None, None, None, None)], CHANGE)
    assert upsert.op11(some, nulls).count() > 0


def test_operator_keeps_names_and_types(spark, tmp_path):
    """Columns named as the operator's own, nested ones, string keys; a change without effect keeps the file; NaN is equal to NaN."""
    rows = spark.range(20).select(F.format_string("k%02d", "id").alias("home"), F.array(F.col("id"), F.lit(None)).alias("rank"), F.create_map(F.lit("m"), F.col("id")).alias("a.b"), F.lit(float("nan")).alias("act"), F.struct(F.col("id").alias("x")).alias("side"))
    store = upsert.create(rows, "home", 6, f"file://{tmp_path}/s")
    assert [(f.first, f.rows) for f in store.files] == [("k00", 6), ("k06", 6), ("k12", 6), ("k18", 2)]
    same = rows.filter("home = 'k07'").withColumn("v", F.lit(1))
    decide = lambda _: F.when(F.col("change.v") < 0, DELETE).otherwise(SET)
    unchanged = upsert.upsert(store, same, ["rank", "act"], ["v"], decide)
    assert unchanged.files == store.files
    with pytest.raises(RuntimeError, match="another writer"):
        upsert.upsert(store, same, ["rank", "act"], ["v"], decide)
    more = same.select(F.lit("k08").alias("home"), F.array(F.lit(1).cast("long")).alias("rank"), F.lit(1.5).alias("act"), "v").union(same.select(F.lit("zz"), "rank", "act", F.lit(-1)))
    after = upsert.upsert(unchanged, more, ["rank", "act"], ["v"], decide)
    assert [f.rewritten for f in after.files] == [False, True, False, False]
    row = after.rows().filter("home = 'k08'").collect()[0]
    assert row["rank"] == [1] and row["act"] == 1.5 and row["a.b"] == {"m": 8} and row["side"].x == 8
    again = upsert.opened(spark, store.folder)
    assert again.files == after.files and again.version == 2 and again.schema == after.schema
    gone = upsert.upsert(again, rows.select("home", "rank", "act", F.lit(-1).alias("v")), ["rank", "act"], ["v"], decide)
    assert not gone.files and gone.rows().count() == 0


def test_a_death_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = upsert.create(spark.range(30).withColumn("v", F.lit(0)), "id", 10, f"file://{tmp_path}/s")
    changes = spark.range(3).withColumn("v", F.lit(7))

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(upsert, "_publish", die)
        with pytest.raises(RuntimeError, match="killed"):
            upsert.upsert(store, changes, ["v"], ["v"], lambda _: F.lit(SET))
    old = upsert.opened(spark, store.folder)
    assert old.files == store.files and old.rows().filter("v = 7").count() == 0 and old.rows().count() == 30


@given(st.lists(st.one_of(st.none(), st.integers(0, 40)), max_size=12), st.integers(1, 10))
@settings(max_examples=300, deadline=None)
def test_fold(done, most):
    """None: a file that stays, of 5 rows."""
    files = [DataFile(str(i), i, 5) for i in range(len(done))]
    out, where = folded(files, {i: n for i, n in enumerate(done) if n is not None}, most)
    sizes = [x for x in out if isinstance(x, int)]
    assert sum(sizes) == sum(n for n in done if n) and all(0 < x <= most for x in sizes)
    assert not any(isinstance(a, int) and isinstance(b, int) and a + b <= most for a, b in zip(out, out[1:], strict=False))
    per = [0] * len(sizes)
    for home, (size, larger, numbers) in where.items():
        assert numbers == sorted(numbers)
        for p, n in enumerate(numbers):
            per[n] += size + (p < larger)
        assert sum(size + (p < larger) for p in range(len(numbers))) == done[home]
    assert per == sizes
