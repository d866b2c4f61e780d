"""The integrity rules of a board, one broken at a time, and what stops publishing."""

import pytest
from pyspark.sql import functions as F

from claimgraph.functions.urls import canonical_url
from claimgraph.operators import board, state

SOURCE = "sources array<struct<url:string,source_type:string,source_tier:int>>"
ITEM = f"i int, {SOURCE}, evidence_method string, denominator_stated string, evidence_coverage struct<seen:int,total:int>, content_hash string, evidence_hash string, topics array<string>, anchor struct<topic:string>, anchor_ambiguous boolean"
SPAN = "url string, fetch string, spans array<string>, content_hash string, evidence_hash string"
EVIDENCE = "url string, claim_tier int, claim_relationship string, source_tier int"
TYPES = {"press": 2, "filing": 1, "other": 3}


class Board:
    def __init__(self):
        self.items, self.spans, self.evidence = [], [], []

    def add(self, span=None, ev=None, **change):
        i = len(self.items)
        url = f"https://example.com/{i}"
        item = {"i": i, "sources": [(url, "press", 2)], "evidence_method": "rule", "denominator_stated": "Y", "evidence_coverage": (2, 2), "content_hash": "c", "evidence_hash": "e", "topics": ["chips"], "anchor": ("chips",), "anchor_ambiguous": False} | change
        self.items.append(item)
        if span != "no":
            self.spans.append({"url": url, "fetch": "ok", "spans": ["a", "b"], "content_hash": "c", "evidence_hash": "e"} | (span or {}))
        if ev != "no":
            self.evidence.append({"url": url, "claim_tier": 4, "claim_relationship": "stake", "source_tier": 2} | (ev or {}))

    def args(self, spark):
        make = lambda rows, schema: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
        return make(self.items, ITEM), make(self.spans, SPAN), make(self.evidence, EVIDENCE), ["chips", "power"], TYPES, "i"


BREAKS = [
    ({}, []),
    ({"sources": [("https://example.com/1", "blog", 2)]}, ["unknown source type"]),
    ({"sources": [("https://example.com/2", "press", 2), (None, "filing", 2), ("x", None, None)]}, ["tier mismatch", "tier mismatch"]),
    ({"sources": [("HTTPS://www.example.com:443/0/?utm_source=a&gclid=1#x", "press", 2)], "evidence_method": "person"}, ["duplicate URL"]),
    ({"evidence_coverage": (3, 2), "evidence_method": "person"}, ["invalid coverage"]),
    ({"evidence_coverage": (-1, 0), "evidence_method": None}, ["invalid coverage"]),
    ({"denominator_stated": "n/a"}, ["n/a with spans"]),
    ({"span": {"fetch": "http-404"}, "evidence_coverage": None}, ["label without article"]),
    ({"span": "no", "evidence_method": "local-model"}, ["label without article", "missing content hash", "missing evidence hash", "partial coverage"]),
    ({"evidence_coverage": (1, 2)}, ["partial coverage"]),
    ({"content_hash": None}, ["missing content hash"]),
    ({"span": {"content_hash": "old"}}, ["stale content hash"]),
    ({"span": {"evidence_hash": ""}}, ["missing evidence hash"]),
    ({"evidence_hash": "old"}, ["stale evidence hash"]),
    ({"evidence_method": "unassessed", "evidence_coverage": (1, 2)}, ["unassessed with spans read"]),
    ({"topics": ["chips", "moon", None]}, ["unknown topics"]),
    ({"anchor_ambiguous": True}, ["ambiguous anchor"]),
    ({"anchor": None, "anchor_ambiguous": True}, []),
    ({"anchor": ("power",)}, ["anchor not in topics"]),
    ({"ev": {"claim_relationship": None}}, ["unresolved claim tier"]),
    ({"ev": {"claim_relationship": "unresolved", "claim_tier": None}}, []),
    ({"ev": {"source_tier": 3}}, ["stale evidence tier"]),
    ({"sources": None, "evidence_method": "person"}, []),
    ({"sources": [("", "press", 2)], "evidence_method": "person"}, []),
]


def test_each_rule(spark):
    made = Board()
    for change, _ in BREAKS:
        made.add(**change)
    got = {}
    for r in board.board_violations(*made.args(spark)).collect():
        got.setdefault(r.i, []).append(r.rule)
    assert {i: sorted(x) for i, x in got.items()} == {i: want for i, (_, want) in enumerate(BREAKS) if want}
    assert len({rule for _, want in BREAKS for rule in want}) == 17


def test_identity(spark):
    same = [("http://www.a.example/x/", "http://A.example:80/x"), ("https://a.example/?b=1&a=%41", "https://a.example?a=A&b=1&utm_x=2"), ("https://youtu.be/Ab?t=1", "https://www.youtube.com/watch?v=Ab&t=9"), ("https://m.youtube.com/shorts/Ab/", "https://youtu.be/Ab"), (" plain ", "plain")]
    other = [("http://a.example/x", "https://a.example/x"), ("https://a.example/?a=1", "https://a.example/?a=2"), ("https://youtu.be/Ab", "https://youtu.be/ab")]
    df = spark.createDataFrame(same + other, "a string, b string").select(canonical_url(F.col("a")).alias("a"), canonical_url(F.col("b")).alias("b"))
    assert [r.a == r.b for r in df.collect()] == [True] * len(same) + [False] * len(other)


def test_publishable(spark):
    made = Board()
    made.add()
    args = made.args(spark)
    assert board.publishable(*args) is args[0]
    for _ in range(25):
        made.add(anchor_ambiguous=True)
    with pytest.raises(state.IntegrityError, match="ambiguous anchor.*and 5 more"):
        board.publishable(*made.args(spark))
