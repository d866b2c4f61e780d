"""Repair of a conversation's structure at the least cost, by dynamic programs shared in a trie.

A conversation's rows make a signature, a letter for each row: its role and what is wrong with it. The cheapest repair
depends on the signature alone. Signatures are read from the last row to the first, sorted over the cluster by ranges
and run through a prefix trie, of which only the path to the present signature is held: neighbours share a prefix, and
the layers of the dynamic program over it are worked out once and kept on a stack. A layer says for each state of the
role pattern what is left to pay; reading backwards is what makes the first of several equal audits choosable step by
step, since putting one letter before two audits keeps their order. A conversation's answer is read off the stack when
its signature ends, so a hot signature is dealt over several tasks and solved once in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.storage import Table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 1, 2, 5, 5
#: What is blank at the ends of a text.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: The pattern s?(ua)+ or nothing, as states: 0 at the start, 1 after s, 2 after u, 3 after a. Where a kept role leads, and which role can be put in.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PUT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
#: After the last row: what is to be put in yet. Costs by state, and the letters.
END = ((0, 2 * COST_INSERT, COST_INSERT, 0), (("", 0), (2 * INSERT, 3), (INSERT, 3), ("", 3)))
GONE = "x"


def edits(code: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, next state) of what can be done with a row of this code in a state."""
    yield COST_DELETE, DELETE, state
    if code != GONE:
        extra = COST_TRUNCATED if code.isupper() else 0
        if (to := STEP.get((state, code.lower()))) is not None:
            yield extra, KEEP, to
        yield COST_REROLE + extra, REROLE, PUT[state][1]


class Trie:
    """The path to the present signature, with a layer (base cost, costs by state above it, moves by state) for each of its prefixes."""

    def __init__(self):
        self.path = ""
        costs, moves = END
        self.layers = [(0, costs, moves)]
        self.known: dict[tuple, tuple] = {}
        self.made = 0

    def layer(self, code: str, costs: tuple) -> tuple:
        """The layer before a row; layers differ by their base alone if what follows does, and are few then."""
        if (code, costs) not in self.known:
            best = []
            for state in range(4):
                options, at, put = [], state, 0
                while put <= 2:  # a third one would come back to a state already had
                    options += [(put * COST_INSERT + cost + costs[to], INSERT * put + letter, to) for cost, letter, to in edits(code, at)]
                    at, put = PUT[at][1], put + 1
                best.append(min(options))
            least = min(b[0] for b in best)
            self.known[code, costs] = least, tuple(b[0] - least for b in best), tuple(b[1:] for b in best)
        return self.known[code, costs]

    def insert(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of a signature, which sorts at or after the one before."""
        n, most = 0, min(len(signature), len(self.path))
        if signature[:most] == self.path[:most]:
            n = most
        else:
            while signature[n] == self.path[n]:
                n += 1
        del self.layers[n + 1 :]
        for code in signature[n:]:
            base, costs, _ = self.layers[-1]
            more, costs, moves = self.layer(code, costs)
            self.layers.append((base + more, costs, moves))
            self.made += 1
        self.path = signature
        base, costs, _ = self.layers[-1]
        state, audit = 0, []
        for _, _, moves in reversed(self.layers):
            letters, state = moves[state]
            audit.append(letters)
        return base + costs[0], "".join(audit)


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest): rows without nulls in role and text; the digest, of both, puts rows of one turn in order."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.select(F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to one line a conversation: counts of faults, and the signature from the last row on."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
    now, begun, kind = None, False, None
    for batch in batches:
        out: list[tuple] = []
        kind = batch.schema.field("conv_id").type
        columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "fault")]
        for conv, turn, initial, fault in zip(*columns, strict=True):
            if not begun or conv != now:
                if begun:
                    out.append((now, high - low + 1 - turns if turns else 0, *counts, illegal, code[::-1].decode()))
                now, begun = conv, True
                low = high = before = None
                turns = illegal = 0
                counts, code = [0, 0, 0], bytearray()
            if initial is None:  # the conversation is named, no row of it
                continue
            if turn is not None:
                turns += turn != high
                low, high = turn if low is None else low, turn
            if before is not None and before + initial not in ("su", "ua", "au"):
                illegal += 1
            before = initial
            if fault:
                counts[fault - 1] += 1
            code += (GONE if fault in (1, 2) else initial.upper() if fault == 3 else initial).encode()
        if out:
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate([kind, *[pa.int64()] * 5, pa.string()])], names)
    if begun:
        last = (now, high - low + 1 - turns if turns else 0, *counts, illegal, code[::-1].decode())
        yield pa.record_batch([pa.array([v], t) for v, t in zip(last, [kind, *[pa.int64()] * 5, pa.string()], strict=True)], names)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        answers = [trie.insert(s) for s in batch["signature"].to_pylist()]
        kept = [c for c in batch.schema.names if c != "signature"]
        yield pa.record_batch([*[batch[c] for c in kept], pa.array([a[0] for a in answers], pa.int64()), pa.array([a[1] for a in answers], pa.string())], [*kept, "cost", "audit"])


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (long) and audit for each conversation of ``rows`` (conv_id, turn, role, text), and for each conv_id of ``ids``.

    Rows stand by turn, nulls first, and of one turn by a digest of role and text. The first fault of a row counts:
    blank (nothing but white space), duplicate (role and text stood before in the conversation), truncated (the last
    character that isn't white space is none of ``ENDS``). Null roles and texts count as one space. A repeated row is a
    duplicate; a null conv_id is a conversation of its own; an id without rows, and so an empty table's, has zeros and
    an empty audit. Other columns are not looked at. A task holds the letters of one conversation, not its texts.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut_off = ~F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).isin(*ENDS)
    initial = F.substring("role", 1, 1)
    light = marked(rows).select("conv_id", "turn", F.when(initial.isin(*ROLES), initial).otherwise("o").alias("initial"), F.when(blank, 1).when(cut_off, 3).otherwise(0).alias("fault"), "digest")
    if ids is not None:
        light = light.unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    dealt = light.repartition("conv_id")
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("turn")) > 1
    fault = F.when((F.col("fault") != 1) & again & F.col("digest").isNotNull(), 2).otherwise(F.col("fault"))
    ordered = dealt.withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "digest").select("conv_id", "turn", "initial", "fault")
    signed = Table(ordered.mapInArrow(_signed, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_signature = signed.df.repartitionByRange(parts, "signature", "conv_id").sortWithinPartitions("signature")
    return by_signature.mapInArrow(_solved, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit, then its rows in order, to the rows of the repaired conversation."""
    now, begun, audit, at, state, place, kind = None, False, "", 0, 0, 0, None
    names = ["conv_id", "place", "turn", "role", "text", "edit"]

    def put(out):
        nonlocal at, state, place
        while at < len(audit) and audit[at] == INSERT:
            role, state = PUT[state]
            out.append((now, place, None, ROLES[role], "", INSERT))
            at, place = at + 1, place + 1

    for batch in batches:
        out: list[tuple] = []
        kind = batch.schema.field("conv_id").type
        for conv, side, turn, role, text, told in zip(*[batch[c].to_pylist() for c in ("conv_id", "side", "turn", "role", "text", "audit")], strict=True):
            if side == 0:
                if begun:
                    put(out)
                now, begun, audit, at, state, place = conv, True, told, 0, 0, 0
                continue
            put(out)
            edit = audit[at]
            at += 1
            if edit == REROLE:
                initial, state = PUT[state]
                role = ROLES[initial]
            elif edit == KEEP:
                state = STEP[state, role[:1]]
            if edit != DELETE:
                out.append((conv, place, turn, role, text, edit))
                place += 1
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate([kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])], names)
    if begun:
        out = []
        put(out)
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate([kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])], names)


def repaired(rows: DataFrame, reported: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn (null for rows put in), role, text, edit (K, R or I): the conversations of ``rows`` with the edits of their ``report``.

    Each conversation's rows are together in one partition and in order there. Texts move once, to their conversation.
    Conversations of which nothing is left, and those of an empty table, have no rows.
    """
    audits = reported.select("conv_id", F.lit(0).alias("side"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), "audit")
    own = marked(rows).select("conv_id", F.lit(1).alias("side"), "turn", "role", "text", "digest", F.lit(None).cast("string").alias("audit"))
    both = audits.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "side", "turn", "digest")
    return both.drop("digest").mapInArrow(_applied, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, turn long, role string, text string, edit string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows in order to (conv_id, repaired_sha256)."""
    now, digest, kind = None, None, pa.int64()
    for batch in batches:
        out: list[tuple] = []
        kind = batch.schema.field("conv_id").type
        for conv, place, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "place", "role", "text")], strict=True):
            if place == 0:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield pa.record_batch([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], ["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.record_batch([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with the faults that the contract plants; nulls become one space, but for the turn and conv_id themselves."""
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(named) % 20).alias("h")).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op13(conversations: DataFrame) -> DataFrame:
    """The columns of the contract, a row for each original conv_id."""
    rows = damaged(conversations)
    done = Table(report(rows, conversations)).df
    kind = conversations.schema["conv_id"].dataType.simpleString()
    digests = repaired(rows, done).mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "of")
    joined = done.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
