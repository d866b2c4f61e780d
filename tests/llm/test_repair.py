"""Structure repair against plain recursion and against all edits there are."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from claimgraph.llm import repair
from claimgraph.llm.queries import QUERIES
from tests.llm.brute_repair import brute, cheapest, judged

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query(spark):
    d = "/root/testdata/sf0.01"
    convs: dict = {}
    for c, *row in duckdb.sql(f"SELECT conv_id, turn, role, text FROM read_parquet('{d}/conversations.parquet')").fetchall():
        convs.setdefault(c, []).append(tuple(row))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_repair"](spark, d).collect()}
    assert got == {c: brute(c, rows) for c, rows in convs.items()}


def all_edits(codes):
    """The cheapest audit, by trying everything with up to two rows put in at a place."""
    row = [[("D", 2, "")] + ([] if c == "x" else [("K", 5 * c.isupper(), c.lower()), ("R", 1 + 5 * c.isupper(), "u"), ("R", 1 + 5 * c.isupper(), "a")]) for c in codes]
    put = [("I" * n, 5 * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = (10**9, "")
    for way in itertools.product(*[p for r in row for p in (put, r)], put):
        if re.fullmatch("(s?(ua)+)?", "".join(w[2] for w in way)):
            best = min(best, (sum(w[1] for w in way), "".join(w[0] for w in way)))
    return best


def test_all_edits():
    random.seed(5)
    codes = ["".join(random.choice("xsuaoSUAO") for _ in range(n)) for n in (0, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 3)] + ["x", "uu", "aa", "sA", "Au"]
    signatures = sorted({c[::-1] for c in codes})
    trie = repair.Trie()
    for s in signatures:
        assert trie.insert(s) == all_edits(s[::-1]), s


def test_trie_shares_prefixes():
    random.seed(6)
    codes = sorted("".join(random.choice("xsuaoUA") for _ in range(random.randint(0, 9))) for _ in range(500))
    trie = repair.Trie()
    for s in codes:
        roles = [repair.ROLES.get(c.lower(), "tool") for c in s[::-1]]
        found = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in s[::-1]]
        assert trie.insert(s) == cheapest(roles, found)[:2], s
    shared = sum(len(a) for a in codes)
    nodes = len({s[: n + 1] for s in codes for n in range(len(s))})
    assert trie.made == nodes < shared / 1.4


def test_long_signature():
    trie = repair.Trie()
    cost, audit = trie.insert("au" * 50_000)
    assert cost == 0 and audit == "K" * 100_000
    assert trie.insert("au" * 50_000) == (0, audit) and trie.made == 100_000


EDGE = [
    (None, 0, "user", "a."), (None, None, "user", "b"), (1, 0, None, None), (1, 1, "user", "x."), (1, 1, "user", "x."), (2, None, "assistant", "y!"), (2, None, "user", "x?"),
    (3, 5, "user", "x" * 300_000), (3, 9, "assistant", "é."), (4, 1, "", "x."), (4, 2, "system", "a\n."), (4, 3, "tool", "."), (5, 7, "sys", "s."), (5, 8, "user", "q. \t"), (5, 9, "assistant", "!"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("place", "side", "audit", "digest", "a.b", "signature")])


def test_edges(spark, edge):
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(edge, spark.createDataFrame([(77, "x"), (1, "x")], "conv_id long, audit string")).collect()}
    convs: dict = {}
    for c, t, r, x in EDGE:
        convs.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    assert set(got) == {*convs, 77} and got[77] == (0, 0, 0, 0, 0, 0, "")
    import hashlib

    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        assert got[c] == judged(rows)[:-1], (c, got[c])


def test_repaired_rows(spark, edge):
    reported = repair.report(edge)
    rows = repair.repaired(edge, reported).collect()
    for c in {r.conv_id for r in rows}:
        mine = [r for r in rows if r.conv_id == c]
        assert [r.place for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert all(r.turn is None and r.text == "" for r in mine if r.edit == "I")
    # A repaired conversation asks for nothing but what its put-in rows, which are blank, ask for.
    fine = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], SCHEMA)
    assert [(r.cost, r.audit) for r in repair.report(fine).collect()] == [(0, "KK")]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(none).count() == 0 and repair.op13(none).count() == 0
    assert repair.repaired(none, repair.report(none)).count() == 0


def test_hot_signature_and_rows(spark):
    """Half of all conversations alike, and a conversation with a third of all rows."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in range(300) for t in range(4)] + [(999, t, "user" if t % 2 == 0 else "assistant", f"{t // 3}.") for t in range(600)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[c] for c in range(300)} == {(0, 0, 0, 0, 0, 0, "KKKK")}
    assert got[999] == judged([(t, r, x) for c, t, r, x in rows if c == 999])[:-1]
