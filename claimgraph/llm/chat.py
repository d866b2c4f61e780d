"""Formatting of conversations as a prefix tree, in which turns that conversations begin with in common stand once.

A node is a turn after the same turns before it. Conversations are sorted by the digests of their nodes, dealt by
ranges, so that those of one subtree follow on each other however many there are; the first of them owns the node and
has it written. In that order, which is depth first, the nodes make one stream of characters. A node knows its place in
the stream, the position of its first character in any conversation that has it, and the intervals of the stream where
its ancestors stand: what attention may see besides the node's own characters before it. Ancestors of one owner stand
together, so there are as many intervals as the path has branches that begin later than their siblings.

Texts move twice, to their conversation and to their node's line; all else is done on digests, places and lengths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.storage import Table

ROW_BITS = 33
#: The role whose texts are learnt.
LEARNT = "assistant"


@dataclass(frozen=True)
class Template:
    """How a turn is written. ``controls`` are the strings that may stand in no text as they are: the template's own, and those that tokenizers know.

    In a text, a backslash is put after a control string's first character; one that already has backslashes there gets
    one more. That can be undone, and leaves no control string.
    """

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>")

    def family(self) -> str:
        heads = "".join(sorted({re.escape(c[0]) for c in (self.begin, self.end, *self.controls)}))
        rests = "|".join(re.escape(c[1:]) for c in sorted({self.begin, self.end, *self.controls}, key=len, reverse=True))
        return rf"([{heads}])(\\*)({rests})"

    def escaper(self):
        family = re.compile(self.family())
        return lambda text: family.sub(r"\1\2\\\3", text)

    def unescaper(self):
        family = re.compile(self.family())
        return lambda text: family.sub(lambda m: m[1] + m[2][1:] + m[3], text)

    def turn(self):
        """A function of (role, escaped text): the turn, and where its text begins."""
        escape = self.escaper()

        def written(role: str, text: str) -> tuple[str, int]:
            head = f"{self.begin}{role_out(escape(role))}\n"
            return f"{head}{text}{self.end}\n", len(head)

        return written

    def reader(self):
        """A function of a written turn: (role, escaped text)."""
        turn = re.compile(rf"{re.escape(self.begin)}([^\n]*)\n(.*){re.escape(self.end)}\n", re.DOTALL)
        unescape = self.unescaper()

        def read(written: str) -> tuple[str, str]:
            m = turn.fullmatch(written)
            return unescape(role_in(m[1])), m[2]

        return read


def role_out(role: str) -> str:
    """A role on one line."""
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def role_in(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line)


def _turned(template: Template):
    """Rows in order to written turns (conv_id, k, node, at, n, role, text, loss_from, loss_to), and at the end of each conversation a line with its nodes (path)."""
    names = ["conv_id", "k", "node", "at", "n", "role", "text", "loss_from", "loss_to", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape, write = template.escaper(), template.turn()
        now, begun, node, at, path = None, False, b"", 0, []
        kind = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        for batch in batches:
            out: list[tuple] = []
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if not begun or conv != now:
                    if begun:
                        out.append((now, *[None] * 8, path))
                    now, begun, node, at, path = conv, True, b"", 0, []
                said = role.encode()
                node = hashlib.blake2b(node + len(said).to_bytes(4, "big") + said + text.encode(), digest_size=16).digest()
                safe = escape(text)
                written, head = write(role, safe)
                loss = (head, head + len(safe)) if role == LEARNT else (head, head)
                out.append((conv, len(path), node, at, len(written), role, written, *loss, None))
                at += len(written)
                path.append(node)
            if out:
                yield batch_of(out)
        if begun:
            yield batch_of([(now, *[None] * 8, path)])

    return run


def formatted(conversations: DataFrame, template: Template | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of ``conversations`` (conv_id, turn, role, text).

    nodes: start (place of the first character in the stream), n_chars, position (of the first character in its
    conversations), role, text (as written), loss_from, loss_to (what is learnt, from the node's first character on;
    empty but for assistants), sees (array<struct<from, to>>: the ancestors' places in the stream, in order), shared (the
    number of conversations). members: conv_id, k (from 0), start: the nodes of each conversation.

    Rows stand by turn (nulls first), then role and text; repeated rows are turns of their own. Null texts and roles are
    empty. A null conv_id is a conversation of its own. Conversations that are equal, or of which one begins the other,
    share all nodes. Of an empty table both results are empty. Other columns are not looked at. A task holds one
    conversation's digests, 16 bytes a turn, and never its texts or a tree.
    """
    spark, kind = conversations.sparkSession, conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = f"conv_id {kind}, k long, node binary, at long, n long, role string, text string, loss_from long, loss_to long, path array<binary>"
    turns = Table(dealt.mapInArrow(_turned(template or Template()), schema)).df
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_path = turns.filter("path IS NOT NULL").select("conv_id", "path").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    order = Table(by_path.select("conv_id", F.monotonically_increasing_id().alias("pos")))
    placed = order.df.withColumnRenamed("conv_id", "of")
    light = turns.filter("k IS NOT NULL").select("conv_id", "k", "node", "at", "n")
    named = Table(light.join(placed, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of"))
    # Written first: a join right after the aggregation would take over its partitions, and a hot node's rows couldn't be split.
    owners = Table(named.df.groupBy("node").agg(F.min("pos").alias("owner"), F.count(F.lit(1)).alias("shared")))
    owned = Table(named.df.join(owners.df, "node").drop("node"))
    for table in (order, named, owners):
        table.drop()
    # By conversation: where the part begins that is its own, and how long that is; then where it begins in the stream.
    part = F.shiftright("pos", ROW_BITS).cast("int")
    mine = owned.df.groupBy("pos").agg(F.min(F.when(F.col("owner") == F.col("pos"), F.col("at"))).alias("own_at"), F.max(F.col("at") + F.col("n")).alias("ends"))
    convs = Table(mine.select("pos", "own_at", F.coalesce(F.col("ends") - F.col("own_at"), F.lit(0)).alias("length"), part.alias("part")))
    totals = {r["part"]: r["n"] for r in convs.df.groupBy("part").agg(F.sum("length").alias("n")).collect()}  # a number for each range
    before, total = [], 0
    for p in range(max(totals, default=-1) + 1):
        before.append(total)
        total += totals.get(p, 0)
    running = F.sum("length").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    starts = convs.df.filter("own_at IS NOT NULL").select(F.col("pos").alias("owner"), (F.lit(before or [0])[F.col("part")] + F.coalesce(running, F.lit(0)) - F.col("own_at")).alias("shift"))
    # A path is made of runs of nodes of one owner; such a run is one interval of the stream.
    runs = owned.df.groupBy("pos", "owner").agg(F.min("at").alias("run_at"), F.max(F.col("at") + F.col("n")).alias("run_to"))
    spans = Table(runs.join(starts, "owner").select("pos", "owner", "run_at", (F.col("shift") + F.col("run_at")).alias("from"), (F.col("shift") + F.col("run_to")).alias("to")))
    convs.drop()
    members = Table(owned.df.join(spans.df, ["pos", "owner"]).select("conv_id", "k", "pos", "owner", "at", "n", "shared", "from", (F.col("from") + F.col("at") - F.col("run_at")).alias("start"))).df
    paths = spans.df.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("run_at", "from", "to"))).alias("runs"))
    ancestors = F.transform(F.filter("runs", lambda r: r["from"] != F.col("from")), lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to")))
    own = F.when(F.col("start") > F.col("from"), F.array(F.struct(F.col("from"), F.col("start").alias("to")))).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>"))
    lines = members.filter("owner = pos").join(paths, "pos").select(F.col("conv_id").alias("of"), F.col("k").alias("kth"), "start", F.col("n").alias("n_chars"), F.col("at").alias("position"), F.concat(ancestors, own).alias("sees"), "shared")
    texts = turns.filter("k IS NOT NULL").select("conv_id", "k", "role", "text", "loss_from", "loss_to")
    nodes = texts.join(lines, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("k") == F.col("kth"))).select("start", "n_chars", "position", "role", "text", "loss_from", "loss_to", "sees", "shared")
    return nodes, members.select("conv_id", "k", "start")


def _read_back(template: Template):
    """Written turns in order to a line for each conversation: what they say, and what of it is learnt."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attended_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, unescape = template.reader(), template.unescaper()
        now, said, kind = None, None, pa.int64()
        of = lambda: (now, n, said.hexdigest(), learnt, loss.hexdigest(), chars, attended)
        for batch in batches:
            out: list[tuple] = []
            kind = batch.schema.field("conv_id").type
            columns = [batch[c].to_pylist() for c in ("conv_id", "k", "text", "loss_from", "loss_to", "position", "seen")]
            for conv, k, text, start, stop, position, seen in zip(*columns, strict=True):
                if k == 0:
                    if said is not None:
                        out.append(of())
                    now, said, loss, n, learnt = conv, hashlib.sha256(), hashlib.sha256(), 0, 0
                role, safe = read(text)
                said.update(f"{role}\n{unescape(safe)}\n".encode())
                plain = unescape(text[start:stop])
                loss.update(plain.encode())
                n, learnt, chars, attended = n + 1, learnt + len(plain), position + len(text), seen + len(text)
            yield batch_of(out, kind)
        if said is not None:
            yield batch_of([of()], kind)

    def batch_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return run


def read_back(nodes: DataFrame, members: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, and attended_chars (what the last turn may see and has), from the result of ``formatted``."""
    seen = F.aggregate("sees", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    rows = members.join(nodes.select("start", "text", "loss_from", "loss_to", "position", seen.alias("seen")), "start")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "k")
    kind = members.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(_read_back(template or Template()), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attended_chars long")


#: A conversation whose texts look like a template's own.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12(conversations: DataFrame) -> DataFrame:
    """The columns of the contract, a row for each conversation and the added one."""
    more = conversations.sparkSession.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return read_back(*formatted(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))
