"""Previous rows over ranges, and the slots of feeds, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

import claimgraph.queries as Q
from claimgraph.functions import html as H
from claimgraph.operators import evidence, reports
from claimgraph.operators import relational as R
from claimgraph.sources import catalogues


def test_previous_row(spark):
    random.seed(2)
    rows = [(i, random.choice([None, 1, 1, 1, 2, 3]), random.choice("abc") if random.random() < 0.8 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k int, row string").repartition(7)
    got = R.with_previous(df, F.col("row"), [F.desc_nulls_last("k"), "i"]).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    by = {r.i: r for r in got}
    assert len(got) == 500 and [by[r[0]].previous for r in want] == [None, *[r[2] for r in want[:-1]]]
    assert [by[r[0]].is_first for r in want] == [True, *[False] * 499]
    opens = {r.i for r in R.opening(df, F.col("row"), [F.desc_nulls_last("k"), "i"]).collect()}
    assert opens == {b[0] for a, b in zip([(None, None, object()), *want], want, strict=False) if a[2] != b[2]}
    assert R.with_previous(df.filter("false"), F.col("row"), ["i"]).count() == 0


def test_no_task_has_all_rows(spark):
    df = Q.QUERIES["q105_headings"](spark, "/root/testdata/sf0.01")
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def taken(items, most):
    seen, out = set(), []
    for feed in sorted({i[0] for i in items}):
        rows = [i for i in sorted(items, key=lambda i: i[1]) if i[0] == feed]
        for i in [i for i in rows if not i[2] or i[2] not in seen][:most]:
            if not i[3] or (i[2] and i[2] in seen):
                continue
            if i[2]:
                seen.add(i[2])
            out.append(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_feed_slots(spark, seed):
    random.seed(seed)
    items = [(random.randrange(8), p, random.choice([None, "", *[f"u{n}" for n in range(12)]]), random.choice(["", None, "t", "t", "t"])) for p in range(120)]
    df = spark.createDataFrame(items, "feed int, place int, url string, title string")
    for most in (1, 3, 6):
        assert sorted(map(tuple, R.feed_slots(df, "feed", "place", "url", "title", most).collect()), key=str) == sorted(taken(items, most), key=str)


def test_feeds_that_wait_for_each_other(spark):
    """Each feed's second item counts only if the feed before gave its own first one."""
    items = [(f, 2 * f + k, f"u{f + k}", "t") for f in range(9) for k in (0, 1)]
    df = spark.createDataFrame(items, "feed int, place int, url string, title string")
    assert sorted(map(tuple, R.feed_slots(df, "feed", "place", "url", "title", 1).collect())) == sorted(taken(items, 1))
    assert R.feed_slots(df.filter("false"), "feed", "place", "url", "title").count() == 0


def test_linked_data(spark):
    deep = '{"@graph": ' * 60 + '{"keywords": "deep"}' + "}" * 60
    pages = {
        '[{"keywords": "a, b"}, {"keywords": ["c", 4]}]': ["c", "4", "a", "b"],
        '{"about": [{"name": "x"}, {"name": ""}, "y"], "keywords": "k"}': ["k", "x"],
        '{"@graph": [[{"keywords": "in"}], {"@graph": {"about": [{"name": "one"}]}}], "keywords": "top"}': ["top", "one", "in"],
        '{"@graph": {"keywords": "Top"}, "about": {"name": "no"}}': ["Top"],
        "not json": [],
        "[1, null]": [],
        deep: ["deep"],
    }
    df = spark.createDataFrame([(i, f'<script type="application/ld+json"> {b} </script><script type="application/ld+json">{{"keywords": "LAST"}}</script>') for i, b in enumerate(pages)], "i int, h string")
    assert [r.t for r in df.select("i", H.publisher_tags(F.col("h")).alias("t")).orderBy("i").collect()] == [[*w, "LAST"] for w in pages.values()]
    assert spark.createDataFrame([(None,), ("",)], "h string").select(H.publisher_tags(F.col("h")).alias("t")).filter("size(t) > 0").count() == 0


def test_sorted_map(spark):
    held = spark.range(1).select(reports.sorted_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("m"))
    assert held.select(F.to_json("m")).first()[0] == '{"a":2,"b":1}'


def test_observations(spark):
    rows = [("a", "2024-01-03", "."), ("a", "2024-01-02", "3"), ("a", "2024-01-01", "2"), ("b", "2024-01-01", "5"), ("c", "2024-01-01", "."), ("z", "2024-01-02", "1"), ("z", "2024-01-01", "0"), ("d", "2024-01-01", "1"), ("d", "2024-01-01", "4"), ("e", None, "4")]
    got = catalogues.last_observations(spark.createDataFrame(rows, "s string, d string, v string"), "s", "d", "v").collect()
    assert {r.series: (r.asof, r.value, r.change_pct) for r in got} == {"a": ("2024-01-02", 3.0, 50.0), "b": ("2024-01-01", 5.0, None), "z": ("2024-01-02", 1.0, None), "d": ("2024-01-01", 4.0, None)}


def test_rails(spark):
    rows = [(1, "My  Story", "my story"), (1, "My Story", "Other &amp; story"), (1, "My Story", "A line"), (2, "other & story", "OTHER & Story"), (2, None, None)]
    df = spark.createDataFrame(rows, "row int, own string, line string")
    kept = evidence.without_headlines(df, "line", "own", df.select("own")).collect()
    assert sorted((r["row"], r.line) for r in kept if r.line) == [(1, "A line"), (1, "my story"), (2, "OTHER & Story")]
