"""The phrase matcher against one regular expression for each phrase, and its cost by the number of phrases."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimgraph.operators import rules as L
from claimgraph.operators.phrases import Matcher, Pattern, spotted

PIECES = ["chip", "Chips", "es", "s", "data center", "data", " ", "-", "_", ".net", "c++", "é", "K", "İ", "1", "\n", "power", "po"]
PHRASES = ["chip", "data center", "data", ".net", "c++", "power", "po", "chips", "1", "s"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.lists(st.sampled_from(PHRASES), min_size=1, max_size=6, unique=True))
@settings(max_examples=600, deadline=None)
def test_as_one_regex_each(text, phrases):
    for joined, before in (("", "a-z0-9"), ("_", "a-z0-9_")):
        patterns = [Pattern(p, plural=i % 2 == 0) for i, p in enumerate(phrases)] + [Pattern(regex=r"da.a\b"), Pattern(regex="chip|net")]
        want = {}
        for n, p in enumerate(patterns):
            m = re.search(p.regex or rf"(?<![{before}]){re.escape(p.phrase)}{'(?:s|es)?' if p.plural else ''}(?![{before}])", text, re.I)
            if m:
                want[n] = m.start()
        assert Matcher(patterns, joined).places(text) == want


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_whole_words(text):
    patterns = [Pattern(p, plural=False) for p in ("chip", "data center", "power", "1")]
    want = {n: m.start() for n, p in enumerate(patterns) if (m := re.search(rf"\b{p.phrase}\b", text, re.I))}
    assert Matcher(patterns, "word").places(text) == want


def test_nulls_and_columns(spark):
    df = spark.createDataFrame([(["A chip", None, "", "no chips, chips"],), (None,), ([],), (["power"],)], "t array<string>").coalesce(1)
    got = df.select(spotted(F.col("t"), [Pattern("chip"), Pattern("power")]).alias("x")).collect()
    assert [[tuple(p) for p in r.x] for r in got] == [[(0, 0, 2), (3, 0, 3)], [], [], [(0, 1, 0)]]


def test_trends(spark):
    df = spark.createDataFrame([("New DATA CENTER power, 5G",), ("superpower",), (None,)], "t string")
    got = df.select(L.trend_matches(F.col("t"), {"energy": ["power", "grid"], "build": ["data center", "power"], "radio": ["5g"]}).alias("m")).collect()
    assert [(r.m.categories, r.m.keywords) for r in got] == [(["energy", "build", "radio"], ["power", "data center", "5g"]), ([], []), ([], [])]


def test_cost_is_flat(spark):
    """A thousand phrases more that stand nowhere cost next to nothing: topics of 10 and of 1,000 phrases."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(8).cache()
    docs.count()

    def took(n):
        topics = [{"topic": "t", "rules": [{"phrase": "und", "score": 2}, {"phrase": "the", "score": 2}]}]
        topics += [{"topic": f"n{i}", "rules": [{"phrase": f"zq{i}x{j} word", "score": 1} for j in range(8)], "exclude": [f"not{i}"]} for i in range(n // 9)]
        best = 1e9
        for _ in range(3):
            start = time.time()
            found = L.topic_candidates(docs, "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(None).cast("array<string>"), F.split("text", "\n"), topics)
            rows = found.count()
            best = min(best, time.time() - start)
        return best, rows

    few, many = took(10), took(1000)
    assert few[1] == many[1] and many[0] < 2 * few[0] + 1, (few, many)
    print(few, many)
