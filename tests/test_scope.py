"""Scopes, facets and mentions on cases written out by hand."""

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import rules, scope


@pytest.mark.parametrize(("title", "feed", "gazette"), [
    ("OPENAI ships", True, True), ("A chatbot", True, False), ("deepfake law", False, True), ("deepfakes", False, False), ("Automated decision", True, True),
    ("Paint, chairs", False, False), ("data centers", False, False), ("data center", True, False), ("Data centre", True, True), ("Algorithmique", True, True), ("éalgorithm", False, False), (None, False, False),
])
def test_vocabularies(spark, title, feed, gazette):
    df = spark.createDataFrame([(title,)], "title string").select(scope.in_feed_scope(F.col("title")), scope.in_gazette_scope(F.col("title"), F.lit(None)))
    assert tuple(df.first()) == (feed, gazette)


def test_routine_notices(spark):
    rows = [("introduction to the unified agenda", None), (None, "on Purple Heart Day"), ("Unified", "Agenda of Federal Regulatory"), ("Purple hearts", "day"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select(scope.is_routine(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [True, True, True, False, False]  # title and summary are read as one


def test_scope_comes_before_the_limit(spark):
    items = spark.createDataFrame([("f", i, "rain" if i < 8 else "a chatbot") for i in range(10)], "feed string, at int, title string")
    assert [r["at"] for r in scope.scoped_top(items, "feed", "title", F.lit(True), ["at"]).orderBy("rank").collect()] == [8, 9]
    assert scope.scoped_top(items, "feed", "title", F.lit(None).cast("boolean"), ["at"]).count() == 6


def test_facets(spark):
    rows = [(1, "Energy use", ["a"], [1], True), (2, "a model", [], [2, 5], False), (3, "cost of energy", None, [], None), (4, None, ["b"], [5], None)]
    board = spark.createDataFrame(rows, "id int, search string, topics array<string>, tiers array<int>, conflict boolean")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(scope.faceted(board)) == [1, 2, 4]
    assert ids(scope.chip(board, "hardware")) == [1] and ids(scope.chip(board, "all", topics=["a"])) == [1, 2, 4]
    assert ids(scope.faceted(board, topics=[""])) == [2] and ids(scope.faceted(board, topics=[])) == []
    assert ids(scope.faceted(board, tiers=[5])) == [2, 4] and ids(scope.faceted(board, conflicts_only=True)) == [1]


def test_mentions(spark):
    registry = {"First": ["one"], "Second": ["two words", "two"], "Third": ["c++"], "Own": ["my paper"]}
    rows = [("One, ONE; two words. Two", "x.org"), ("my paper says one", "www.mypaper.com"), ("someone, tone", None), (None, None), ("two one", "a.b")]
    got = spark.createDataFrame(rows, "text string, host string").select(rules.mentions(F.col("text"), F.col("host"), registry).alias("m")).collect()
    assert [[tuple(m) for m in r.m] for r in got] == [[("Second", 3), ("First", 2)], [("First", 1)], [], [], [("First", 1), ("Second", 1)]]
    capped = spark.createDataFrame(rows[:1], "text string, host string").select(rules.mentions(F.col("text"), F.col("host"), registry, most=1).alias("m")).first()
    assert [m.name for m in capped.m] == ["Second"]
