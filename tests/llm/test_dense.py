"""Texts dense with spans, and what the helpers over spans say against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from claimgraph.llm import pii
from tests.llm.test_brute_force import base_spans

SPANS = "array<struct<kind:string,s:int,e:int,m:string>>"


def in_brackets(text, spans):
    out, at = [], 0
    for s, _, e, kind in sorted((s, -e, e, kind) for kind, s, e in spans):
        if s >= at:
            out.append(text[at:s] + f"[{kind.upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def test_one_text_of_many_addresses(spark):
    """1.2 MB of log lines in one text: the same spans as plain Python, in time that doesn't grow with their square."""
    text = "\n".join(f"é\U0001f600 {i} user{i}@mail.example.org 10.0.{i % 256}.{i % 200}" for i in range(25_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    at = time.time()
    row = pii.op1(docs).first()
    took = time.time() - at
    want = base_spans(text)
    assert row.n_email == row.n_ip == 25_000
    assert row.spans.split(",") == [":".join(map(str, x)) for x in want]
    model = pii.SpanModel({}, 0.5, {}, -1.0)
    assert pii.redacted(docs, model).first().text == in_brackets(text, want)
    assert took < 120, took  # squares would take some twenty minutes


@pytest.fixture(scope="module")
def cases():
    """(text, base spans that are in order and apart within a kind, other spans)."""
    rng, out = random.Random(5), []
    for n in [0, 1, 2, 3, 7, 40, 300]:
        size = 10 + 12 * n
        text = "".join(rng.choice("abé\U0001f600 ") for _ in range(size))
        base = []
        for kind in pii.KINDS:
            cuts = sorted(rng.sample(range(size), min(size, 2 * rng.randint(0, n) // 2 * 2)))
            base += [(kind, a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        loose = [("phone", a, a + rng.randint(1, 9)) for a in rng.sample(range(size - 9), min(n + 1, size - 9))]
        out.append((text, base, loose))
    return out


def test_spans_apart_and_redacted(spark, cases):
    put = lambda spans, text: [(k, s, e, text[s:e]) for k, s, e in spans]
    rows = [(i, t, put(b, t), put(x, t)) for i, (t, b, x) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, text string, base {SPANS}, loose {SPANS}")
    told = pii.described(F.col("text"), F.col("loose"), F.col("base"), False)
    done = df.select("i", pii.apart(F.col("loose"), F.col("base")).alias("apart"), pii.redact(F.col("text"), F.concat("base", "loose")).alias("clean"), told.alias("told"))
    for r in done.collect():
        text, base, loose = cases[r.i]
        assert [tuple(x)[:3] for x in r.apart] == [x for x in loose if not any(x[1] < e and s < x[2] for _, s, e in base)]
        assert r.clean == in_brackets(text, base + loose)
        near = ["+" if any(s != x[1] and abs(s - x[1]) < 200 for _, s, _ in base) else "0" for x in loose]
        assert [x.pattern.split("|")[1][4] for x in r.told] == near
