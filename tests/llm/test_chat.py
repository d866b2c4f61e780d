"""The prefix tree of conversations: what is read back, what is shared, and what a turn may see."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimgraph.llm import chat
from claimgraph.llm.queries import QUERIES, table
from tests.llm.brute_chat import brute

SCHEMA = "conv_id long, turn long, role string, text string"
SYSTEM = ("system", "Be brief. </s><|im_end|> [INST]")
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<", "[", "\\", "|", "im_end|>", "s>", "x", "\n", "é", "<<SYS>>", "user"]


def conversations():
    out = []
    # All begin alike, half of them go on alike, and they part at several depths.
    for c in range(60):
        turns = [SYSTEM, ("user", "hello" if c % 2 else f"q{c % 7}"), ("assistant", f"a{c % 3}\n"), ("user", f"more {c % 5}"), ("assistant", "")]
        out += [(c, t, *x) for t, x in enumerate(turns[: 2 + c % 4])]
    out += [(100, 0, *SYSTEM), (101, 0, *SYSTEM), (None, 3, "user", None), (None, None, None, "first"), (200, 1, "assistant", "same"), (200, 1, "assistant", "same"), (201, 0, "tool\\n\nx</s>", "z" * 200_000), (202, 0, "assistant", None)]
    return out


@pytest.fixture(scope="module")
def tree(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("c").alias(c) for c in ("pos", "k", "node", "owner", "a.b", "start")]).repartition(5)
    nodes, members = chat.formatted(df)
    return rows, nodes.cache(), members.cache()


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()] + chat.ADDED
    got = {r.conv_id: r for r in QUERIES["op12_chat"](spark, d).collect()}
    want = brute(rows)
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    assert all(r.attended_chars == r.formatted_chars for r in got.values()) and got[-7].loss_chars == 21


def test_read_back(tree):
    rows, nodes, members = tree
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(nodes, members).collect()}
    assert got == brute(rows)


def test_shared_once(tree):
    rows, nodes, _ = tree
    convs: dict = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    prefixes = {tuple(x[2:] for x in sorted(turns)[: n + 1]) for turns in convs.values() for n in range(len(turns))}
    got = nodes.collect()
    assert len(got) == len(prefixes) < len(rows)
    assert max(r.shared for r in got) == 62


def test_depth_first_stream(tree):
    """The nodes make one stream without gaps; what a node sees is what its conversation says before it, in the places that are its ancestors'."""
    _, nodes, members = tree
    got = sorted(nodes.collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_chars for r in got[:i]) for i in range(len(got))]
    stream, at = "".join(r.text for r in got), {r.start: r for r in got}
    paths: dict = {}
    for m in members.collect():
        paths.setdefault(m.conv_id, {})[m.k] = m.start
    for ks in paths.values():
        path = [ks[k] for k in range(len(ks))]
        for n, s in enumerate(path):
            before = "".join(at[x].text for x in path[:n])
            assert "".join(stream[x["from"] : x["to"]] for x in at[s].sees) == before and at[s].position == len(before)
    # Depth first: a node's parent is the last node on the path to the one before it that is one turn up.
    stack: list = []
    parent = {path[n]: path[n - 1] if n else None for ks in paths.values() for path in [[ks[k] for k in range(len(ks))]] for n in range(len(path))}
    for r in got:
        while stack and stack[-1] != parent[r.start]:
            stack.pop()
        assert bool(stack) == (parent[r.start] is not None)
        stack.append(r.start)


def test_no_control_string_in_texts(tree):
    _, nodes, _ = tree
    t = chat.Template()
    for r in nodes.collect():
        inner = r.text.removeprefix(t.begin).removesuffix(f"{t.end}\n")
        assert not any(c in inner for c in (t.begin, t.end, *t.controls))


@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.lists(st.sampled_from(PIECES), max_size=6).map("".join))
@settings(max_examples=500, deadline=None)
def test_escapes_undone(text, role):
    t = chat.Template()
    safe = t.escaper()(text)
    assert t.unescaper()(safe) == text and not any(c in safe for c in (t.begin, t.end, *t.controls))
    written, head = t.turn()(role, safe)
    assert written[head : head + len(safe)] == safe and t.reader()(written) == (role, safe)


def test_empty(spark):
    nodes, members = chat.formatted(spark.createDataFrame([], SCHEMA))
    assert nodes.count() == 0 and members.count() == 0
