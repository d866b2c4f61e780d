"""Long benchmark items: what a fingerprint carries doesn't grow with them."""

from pyspark.sql import functions as F

from claimgraph.llm import decontam


def test_long_items(spark):
    item = [f"w{i}" for i in range(3000)]
    cuts = [(0, 10), (0, 9), (1, 11), (3, 14), (1500, 1509), (1500, 1510), (2990, 3000), (2991, 3000), (100, 400)]
    docs = spark.createDataFrame([(i, " ".join(["x", *item[a:b], "y"])) for i, (a, b) in enumerate(cuts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "a b c")], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontam.op10(docs, bench).collect()}
    assert got == {i: b - a if b - a >= 10 else 0 for i, (a, b) in enumerate(cuts)}
    assert decontam.items_of(bench).agg(F.max(F.size("iw"))).first()[0] <= 14
    apart = decontam.decontaminate(docs, bench, most_broadcast=0)  # fingerprints that are too many to broadcast
    assert {r.doc_id: r.n_hit for r in apart.collect()} == got
