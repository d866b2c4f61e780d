"""Removal of repeated 100-byte strings by a common-prefix-aware distributed merge sort of suffixes.

Which suffixes. A window is a string of ``length`` bytes; its anchor is the place of the smallest hash among its
``gram``-byte strings. Equal windows have equal anchors, and some 35 windows in a row share one. Such a row of windows
is one suffix here: the text from its first window to the end of its last. Gram hashes are first counted over all
documents: a suffix whose anchor's gram occurs once has no window that repeats, and is left out.

Sorting. Each block of documents sorts its suffixes (of equal ones, the first stands for all) and sends them, dealt by
anchor, as front-coded runs: the length of the prefix shared with the one before, and the rest. A reducer merges the runs
with a loser tree that keeps, for each head, how much of the last winner it shares: heads are told apart by these lengths,
and bytes are compared only beyond them. Equal suffixes come out next to each other; suffixes that share an anchor
without being equal are then compared window by window.

An anchor with many different suffixes (an often used passage in different surroundings) would gather in one reducer. Its
suffixes are cut by where the anchor stands in the window, and each part is dealt by the hash of the bytes that all windows
of such a part have around the anchor. The parts are counted as the anchors were: what occurs once is left out, and what
still is of many different parts is cut again, in the end into single windows, of which only those that repeat are sent. So
a window costs its 100 bytes only where nothing shorter would do.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from claimgraph.llm.common import BYTE_HASH, MULT, MULT_INV, U, batches, blocks_for, input_bytes, mix, pack, power_table, prefix_hash, range_hash, text_bytes, unpack, with_chunk

BITS = 40
PLACE = U((1 << 20) - 1)
#: What tells an anchor's hash, as it is dealt, from the one by which it was picked.
SPREAD = U(0x94D049BB133111EB)


@dataclass(frozen=True)
class SuffixParams:
    #: Strings of so many bytes that start earlier too are removed.
    length: int = 100
    #: Bytes of an anchor's string.
    gram: int = 32
    #: Input bytes in a block of documents.
    block_bytes: int = 6 << 20
    #: Blocks' worth of hashes that are counted in one task: more make fewer and longer rows.
    counted_blocks: int = 4
    #: So many different suffixes of one anchor, in all blocks of documents together, cut them into parts.
    wide: int = 24
    #: Parts into which they are cut first; what is still wide then is cut into windows.
    parts: int = 4

    @property
    def longest(self) -> int:
        return 2 * self.length - self.gram

    @property
    def levels(self) -> tuple[int, ...]:
        """Parts of a suffix when it is cut for the first and for the second time."""
        return (self.parts, self.length - self.gram + 1)


def sorted_rows(docs: pa.Table) -> pa.Table:
    """By doc_id (nulls last), then text: the same order wherever the block is read."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def suffixes(data: np.ndarray, offsets: np.ndarray, p: SuffixParams):
    """First and last window, anchor, gram hash and digest of each suffix, in order; places are in ``data``."""
    parts = []
    for i, j in batches(offsets, 1 << 19):
        a, b = int(offsets[i]), int(offsets[j])
        ends = offsets[i + 1 : j + 1]
        for lo in range(a, b, 1 << 19):  # a long text goes piece by piece, each with the bytes of its last windows
            hi = min(b, lo + (1 << 19) + p.length - 1)
            if hi - lo < p.length:
                continue
            piece = data[lo:hi]
            prefix = prefix_hash(piece)
            n = len(piece) - p.gram + 1
            at = np.arange(n)
            h = range_hash(prefix, at, at + p.gram)
            low = (h & ~PLACE) | at.astype(np.uint64)
            span, w = 1, p.length - p.gram + 1
            while span * 2 <= w:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if w > span:
                low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
            anchor = (low & PLACE).astype(np.int64)
            start = np.arange(len(anchor))
            start = start[start + lo + p.length <= ends[np.searchsorted(ends, start + lo, "right")]]
            start = start[start < 1 << 19]
            if not len(start):
                continue
            own = anchor[start]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(start) != 1)]))
            first, last = start[new], start[np.append(new[1:], len(start)) - 1]
            # Anchors have the smallest hashes around, so those are spread anew: dealt by ranges as they are, the lowest range would hold most.
            parts.append((first + lo, last + lo, own[new] + lo, mix(h[own[new]] ^ SPREAD), range_hash(prefix, first, last + p.length)))
    if not parts:
        return (*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], for which parts of the data are gone through one by one."""
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    at = np.searchsorted(start[order], np.arange(0, len(data) + (1 << 19), 1 << 19))
    for i, j in zip(at[:-1], at[1:], strict=True):
        if i < j:
            own = order[i:j]
            lo, hi = int(start[own[0]]), int(end[own].max())
            out[own] = range_hash(prefix_hash(data[lo:hi]), start[own] - lo, end[own] - lo)
    return out


def parted(data: np.ndarray, cut, parts: int, p: SuffixParams):
    """The suffixes of ``cut`` by where the anchor stands in the window: first and last window, anchor, hash of what all windows of the part have around the anchor, digest."""
    first, last, anchor = cut[:3]
    # Windows of part j start edge[j] to edge[j + 1] - 1 bytes before the anchor.
    edge = np.arange(parts + 1) * (p.length - p.gram + 1) // parts
    far, near = (np.searchsorted(edge, anchor - x, "right") - 1 for x in (first, last))
    n = far - near + 1
    i = np.repeat(np.arange(len(n)), n)
    j = far[i] - (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
    anchor = anchor[i]
    first, last = np.maximum(first[i], anchor - edge[j + 1] + 1), np.minimum(last[i], anchor - edge[j])
    return first, last, anchor, _hashes(data, anchor - edge[j], anchor - edge[j + 1] + 1 + p.length), _hashes(data, first, last + p.length)


def _distinct(grams: np.ndarray, digests: np.ndarray):
    """The grams' distinct leading bits, how many suffixes each has, how many different ones, and a byte that marks the first of these."""
    top = grams >> U(64 - BITS)
    order = np.lexsort((digests, top))
    g, d = top[order], digests[order]
    first = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    fresh = first | np.concatenate([[True], d[1:] != d[:-1]]) if len(g) else first
    at = np.flatnonzero(first)
    return g[at], np.diff(np.append(at, len(g))), np.add.reduceat(fresh, at) if len(at) else at, (d[at] >> U(56)).astype(np.uint8)


def _cuts(values: np.ndarray, blocks: int) -> np.ndarray:
    return np.searchsorted(values, np.array([(k << BITS) // blocks for k in range(blocks)] + [1 << BITS], np.uint64))


COUNTS = "block int, chunk int, level int, grams binary, different binary, mark binary, told binary"
ANSWERS = "chunk int, block int, level int, n int, often binary, wide binary, told binary"


def _cut(data: np.ndarray, offsets: np.ndarray, level: int, answers: pa.Table, p: SuffixParams):
    """What is known when ``level`` levels are answered: the suffixes and parts to be sent, the parts to be counted next, and the levels' answers for the block, packed.

    ``answers`` holds those of the last level by ranges of hashes, and those of the levels before as they were packed here.
    """
    cut, sent, told = suffixes(data, offsets, p), [], {}
    fresh = answers.filter(pc.is_null(answers.column("told"))) if level else answers
    packed = {r["level"]: r["told"] for r in answers.filter(pc.is_valid(answers.column("told"))).select(["level", "told"]).to_pylist()} if level else {}
    for k in range(level):
        if k < level - 1:
            keep, wide = np.unpackbits(np.frombuffer(packed[k], np.uint8), count=2 * len(cut[0])).reshape(2, -1) > 0
        else:
            own, counts, _, _ = _distinct(*cut[3:])
            order = np.argsort(fresh.column("block").to_numpy(), kind="stable")
            sizes = fresh.column("n").to_numpy()
            unbits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(fresh.column(name)[int(x)].as_py(), np.uint8), count=sizes[x]) for x in order] + [np.zeros(0, np.uint8)]) > 0  # noqa: B023, E731
            often, wide = unbits("often"), unbits("wide")
            if len(often) != len(own):
                raise ValueError("the counts don't belong to these documents")
            which = np.searchsorted(own, cut[3] >> U(64 - BITS))
            keep = (often | (counts > 1))[which]
            wide = wide[which] & keep & (k < len(p.levels))
        told[k] = np.packbits(np.stack([keep, wide])).tobytes()
        sent.append(tuple(x[keep & ~wide] for x in cut))
        if k < len(p.levels):
            cut = parted(data, [x[wide] for x in cut], p.levels[k], p)
    return sent, cut, told


def _count(blocks: int, p: SuffixParams, level: int = 0):
    def run(docs: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        kinds = {"block": pa.int32(), "chunk": pa.int32(), "level": pa.int32()}
        names = [k.split()[0] for k in COUNTS.split(", ")]
        if not docs.num_rows:
            return pa.table({k: pa.array([], kinds.get(k, pa.binary())) for k in names})
        docs = sorted_rows(docs)
        chunk = docs.column("chunk")[0].as_py()
        _, cut, told = _cut(*text_bytes(docs.column("text")), level, answers, p)
        own, _, different, mark = _distinct(*cut[3:])
        different = np.minimum(different, 255).astype(np.uint8)
        cuts = _cuts(own, blocks)
        some = np.flatnonzero(np.diff(cuts))
        part = lambda f: [f(slice(cuts[k], cuts[k + 1])) for k in some]
        known = list(told.items())
        columns = {
            "block": some.tolist() + [chunk % blocks] * len(known),
            "chunk": [chunk] * (len(some) + len(known)),
            "level": [level] * len(some) + [k for k, _ in known],
            "grams": part(lambda x: pack(own[x])) + [None] * len(known),
            "different": part(lambda x: different[x].tobytes()) + [None] * len(known),
            "mark": part(lambda x: mark[x].tobytes()) + [None] * len(known),
            "told": [None] * len(some) + [v for _, v in known],
        }
        return pa.table({k: pa.array(columns[k], kinds.get(k, pa.binary())) for k in names})

    return (lambda docs: run(docs)) if not level else run


def _answer(p: SuffixParams):
    def run(table: pa.Table) -> pa.Table:
        grams = [unpack(b) for b in table.column("grams").to_pylist()]
        joined = lambda name: np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8)
        every, inverse, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        most = np.zeros(len(every), np.int64)
        np.maximum.at(most, inverse, joined("different"))
        # Blocks whose first suffixes have different marks have different suffixes: an anchor with few in each block may have many in all.
        marks = np.bincount(np.unique(inverse.astype(np.int64) * 256 + joined("mark")) >> 8, minlength=len(every))
        wide = most + marks - 1 >= p.wide
        at = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        ends = list(zip(at[:-1], at[1:], strict=True))
        bits = lambda x: pa.array([np.packbits(x[inverse[a:b]]).tobytes() for a, b in ends], pa.binary())
        return pa.table({"chunk": table.column("chunk"), "block": table.column("block"), "n": pa.array(np.diff(at), pa.int32()), "often": bits(counts > 1), "wide": bits(wide)})

    return run


def _answers(p: SuffixParams):
    """``_answer`` of what is asked; what is known of earlier levels goes through."""
    answer = _answer(p)

    def run(table: pa.Table) -> pa.Table:
        asked = table.filter(pc.is_null(table.column("told")))
        known = table.filter(pc.is_valid(table.column("told")))
        names = [k.split()[0] for k in ANSWERS.split(", ")]
        kinds = {"chunk": pa.int32(), "block": pa.int32(), "level": pa.int32(), "n": pa.int32()}
        none = lambda k, n: pa.nulls(n, kinds.get(k, pa.binary()))
        out = [pa.table({k: known.column(k) if k in known.column_names else none(k, known.num_rows) for k in names})]
        if asked.num_rows:
            got = answer(asked).append_column("level", asked.column("level")).append_column("told", none("told", asked.num_rows))
            out.append(got.select(names))
        schema = pa.schema([(k, kinds.get(k, pa.binary())) for k in names])
        return pa.concat_tables([t.cast(schema) for t in out])

    return run


RUNS = "block int, chunk int, n int, shared binary, sizes binary, rest binary, grams binary, ids binary, rows binary, starts binary, ends binary"


def strings(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """A row of bytes for each string, zeros after its end, and its size in the last two columns."""
    cols = np.arange(width)
    out = data[np.minimum(start[:, None] + cols[None, :], len(data) - 1)]
    out[cols[None, :] >= size[:, None]] = 0
    return np.concatenate([out, (size >> 8)[:, None].astype(np.uint8), (size & 255)[:, None].astype(np.uint8)], axis=1)


def _runs(blocks: int, p: SuffixParams):
    width = p.longest

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = {k.split()[0]: [] for k in RUNS.split(", ")}

        def put(**x):
            for k in out:
                out[k].append(x.get(k, b""))

        if docs.num_rows:
            docs = sorted_rows(docs)
            chunk = docs.column("chunk")[0].as_py()
            data, offsets = text_bytes(docs.column("text"))
            sent, _, _ = _cut(data, offsets, len(p.levels) + 1, answers, p)
            start, last, _, gram, digest = (np.concatenate(x) for x in zip(*sent, strict=True))
            size = last - start + p.length
            order = np.argsort(start, kind="stable")
            start, size, gram, digest = start[order], size[order], gram[order], digest[order]
            row = np.searchsorted(offsets, start, "right") - 1
            ids = pc.fill_null(docs.column("doc_id"), 2**63 - 1).to_numpy()
            # Of equal suffixes in the block, the first goes on; the others repeat it.
            _, at, inverse = np.unique(digest, return_index=True, return_inverse=True)
            head = at[inverse]
            again = np.flatnonzero(head != np.arange(len(start)))
            for i in range(0, len(again), 1 << 14):
                part = again[i : i + (1 << 14)]
                same = (strings(data, start[part], size[part], width) == strings(data, start[head[part]], size[head[part]], width)).all(axis=1)
                head[part[~same]] = part[~same]
            again = np.flatnonzero(head != np.arange(len(start)))
            s, e, r = _joined(row[again], start[again] - offsets[row[again]], start[again] + size[again] - offsets[row[again]])
            put(block=chunk % blocks, chunk=chunk, n=0, rows=r.astype(np.int32).tobytes(), starts=s.astype(np.int64).tobytes(), ends=e.astype(np.int64).tobytes())
            go = np.flatnonzero(head == np.arange(len(start)))
            block = np.zeros(len(go), np.int64)
            if len(go):
                block = np.searchsorted(np.array([(k << BITS) // blocks for k in range(1, blocks)], np.uint64), gram[go] >> U(64 - BITS), "right")
            for k in np.unique(block):
                part = go[block == k]
                text = strings(data, start[part], size[part], width)
                order = np.argsort(np.ascontiguousarray(text).view(f"S{width + 2}").ravel(), kind="stable")
                text, part = text[order, :width], part[order]
                shared = np.zeros(len(part), np.int64)
                differ = text[1:] != text[:-1]
                shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
                shared[1:] = np.minimum(shared[1:], np.minimum(size[part][1:], size[part][:-1]))
                cols = np.arange(width)[None, :]
                rest = text[(cols >= shared[:, None]) & (cols < size[part][:, None])]
                put(block=int(k), chunk=chunk, n=len(part), shared=shared.astype(np.uint16).tobytes(), sizes=size[part].astype(np.uint16).tobytes(), rest=rest.tobytes(), grams=gram[part].tobytes(), ids=ids[row[part]].astype(np.int64).tobytes(), rows=row[part].astype(np.int32).tobytes(), starts=(start[part] - offsets[row[part]]).astype(np.int64).tobytes())
        kinds = {"block": pa.int32(), "chunk": pa.int32(), "n": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    return run


def _joined(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """start, end, row of the unions of overlapping or touching ranges by row."""
    if not len(row):
        return start, end, row
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # Rows by rank, so that the shifts stay small whatever the row numbers are.
    shift = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]])) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]]))
    return start[new], (reach - shift)[np.append(new[1:], len(row)) - 1], row[new]


def common(x: bytes, y: bytes, at: int) -> int:
    """The length of the common prefix of x and y, which is known to be ``at`` or more."""
    n = min(len(x), len(y))
    while at < n:
        a, b = x[at : at + 16], y[at : at + 16]
        if a != b:
            m = min(len(a), len(b))
            for i in range(m):
                if a[i] != b[i]:
                    return at + i
            return at + m
        at += 16
    return n


def merge(runs: list[tuple[list[bytes], list[int]]]):
    """(run, place in it, length shared with the string before) of all strings of the sorted runs, in order.

    ``runs``: strings, and how much each shares with the one before it in its run. A loser tree: each inner node holds
    the run that lost there, and shared[r] how much the head of run r has in common with the string that beat it. Of two
    heads, the one that shares more with the last string put out is smaller; only when they share as much are bytes
    compared, and only beyond that length.
    """
    k = len(runs)
    if k == 1:
        yield from ((0, i, s) for i, s in enumerate(runs[0][1]))
        return
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs]
    place, shared = [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner, loser."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        at = common(x, y, shared[a])
        less = at == len(x) if at in (len(x), len(y)) else x[at] < y[at]
        if less:
            shared[b] = at
            return a, b
        shared[a] = at
        return b, a

    loser = [0] * k
    winners = [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for i in range(k - 1, 0, -1):
        winners[i], loser[i] = play(winners[2 * i], winners[2 * i + 1])
    top = winners[1]
    while heads[top] is not None:
        yield top, place[top], shared[top]
        place[top] += 1
        own, sizes = runs[top]
        if place[top] < len(own):
            heads[top], shared[top] = own[place[top]], sizes[place[top]]
        else:
            heads[top] = None
        node = (k + top) >> 1
        while node:
            top, loser[node] = play(top, loser[node])
            node >>= 1


RANGES = "chunk int, rows binary, starts binary, ends binary"


def _reduce(p: SuffixParams):
    width = p.longest

    def run(table: pa.Table) -> pa.Table:
        found = []  # chunk, row, start, end
        runs, ids, chunks, rows, starts, grams, sizes = [], [], [], [], [], [], []
        for r in table.to_pylist():
            if not r["n"]:
                row = np.frombuffer(r["rows"], np.int32)
                found.append((np.full(len(row), r["chunk"]), row, np.frombuffer(r["starts"], np.int64), np.frombuffer(r["ends"], np.int64)))
                continue
            shared, size, rest = (*(np.frombuffer(r[k], np.uint16).tolist() for k in ("shared", "sizes")), r["rest"])
            own, at, last = [], 0, b""
            for s, n in zip(shared, size, strict=True):
                last = last[:s] + rest[at : at + n - s]
                at += n - s
                own.append(last)
            runs.append((own, shared))
            sizes.append(np.array(size)), grams.append(np.frombuffer(r["grams"], np.uint64)), ids.append(np.frombuffer(r["ids"], np.int64)), rows.append(np.frombuffer(r["rows"], np.int32)), starts.append(np.frombuffer(r["starts"], np.int64)), chunks.append(np.full(r["n"], r["chunk"]))
        if runs:
            base = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
            size, gram, doc, row, start, chunk = (np.concatenate(x) for x in (sizes, grams, ids, rows, starts, chunks))
            merged = np.array([(base[r] + i, s) for r, i, s in merge(runs)], np.int64)
            order, shared = merged[:, 0], merged[:, 1]
            n = size[order]
            same = np.concatenate([[False], (shared[1:] == n[1:]) & (n[1:] == n[:-1])])
            kind = np.cumsum(~same) - 1
            # Of equal suffixes, the first in the corpus stays; the others are repeats from end to end.
            by = np.lexsort((start[order], row[order], doc[order], kind))
            head = np.concatenate([[True], np.diff(kind[by]) != 0])
            later, heads = order[by[~head]], order[by[head]]
            found.append((chunk[later], row[later], start[later], start[later] + size[later]))
            # Different suffixes of one anchor, window by window.
            by = np.argsort(gram[heads], kind="stable")
            g = gram[heads][by]
            edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            count = np.diff(np.append(edge, len(g)))
            mixed = heads[by[np.repeat(count > 1, count)]]
            owner = np.searchsorted(base, mixed, "right") - 1
            ends = np.cumsum(count[count > 1])
            a = 0
            while a < len(mixed):
                b = int(ends[max(np.searchsorted(ends, a + 4096, "right") - 1, np.searchsorted(ends, a, "right"))])
                own = mixed[a:b]
                text = np.zeros((len(own), width), np.uint8)
                for i, (x, r) in enumerate(zip(own, owner[a:b], strict=True)):
                    s = runs[r][0][x - base[r]]
                    text[i, : len(s)] = np.frombuffer(s, np.uint8)
                sums = np.zeros((len(own), width + 1), np.uint64)
                np.cumsum(BYTE_HASH[text] * power_table(MULT, width)[None, :], axis=1, out=sums[:, 1:])
                many = width - p.length + 1
                hashes = mix((sums[:, p.length :] - sums[:, :many]) * power_table(MULT_INV, many)[None, :])
                i, w = np.nonzero(np.arange(many)[None, :] <= (size[own] - p.length)[:, None])
                h = hashes[i, w]
                at = np.lexsort((start[own][i] + w, row[own][i], doc[own][i], h))
                i, w, h = i[at], w[at], h[at]
                first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
                rep = np.flatnonzero(first != np.arange(len(h)))
                for c in range(0, len(rep), 1 << 14):
                    q = rep[c : c + (1 << 14)]
                    f = first[q]
                    cols = np.arange(p.length)[None, :]
                    equal = (text[i[q][:, None], w[q][:, None] + cols] == text[i[f][:, None], w[f][:, None] + cols]).all(axis=1)
                    q = own[i[q[equal]]], w[q[equal]]
                    s = start[q[0]] + q[1]
                    found.append((chunk[q[0]], row[q[0]], s, s + p.length))
                a = b
        c, r, s, e = (np.concatenate([np.asarray(x, np.int64) for x in part]) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        s, e, both = _joined((c << 32) + r, s, e)
        order = np.argsort(both >> 32, kind="stable")
        both, s, e = both[order], np.asarray(s, np.int64)[order], np.asarray(e, np.int64)[order]
        own, at = np.unique(both >> 32, return_index=True)
        ends = list(zip(at, np.append(at, len(both))[1:], strict=True))
        rows = (both & ((1 << 32) - 1)).astype(np.int32)
        return pa.table({"chunk": own.astype(np.int32)} | {k: pa.array([x[i:j].tobytes() for i, j in ends], pa.binary()) for k, x in (("rows", rows), ("starts", s), ("ends", e))})

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_out(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    docs = sorted_rows(docs)
    data, offsets = text_bytes(docs.column("text"))
    row, s, e = (np.frombuffer(b"".join(ranges.column(k).to_pylist()), kind).astype(np.int64) for k, kind in (("rows", np.int32), ("starts", np.int64), ("ends", np.int64)))
    s, e, row = _joined(row, s, e)
    at = np.searchsorted(row, np.arange(docs.num_rows + 1))
    removed, shas = np.zeros(docs.num_rows, np.int64), []
    for i in range(docs.num_rows):
        text, last, sha = data[offsets[i] : offsets[i + 1]], 0, hashlib.sha256()
        for a, b in zip(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]], strict=True):
            sha.update(text[last:a])
            removed[i] += b - a
            last = b
        sha.update(text[last:])
        shas.append(sha.hexdigest())
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": removed, "n_spans": np.diff(at).astype(np.int64), "kept_sha256": pa.array(shas, pa.string())})


def repeated_ranges(docs: DataFrame, p: SuffixParams = SuffixParams()) -> tuple[DataFrame, DataFrame]:
    """The documents dealt into blocks (doc_id, text, chunk), and the byte ranges to remove by block: packed rows of the block as ``sorted_rows`` has it, starts and ends."""
    blocks = blocks_for(input_bytes(docs), p.block_bytes)
    dealt = with_chunk(docs, blocks)
    ranges = -(-blocks // p.counted_blocks)
    answers = dealt.groupBy("chunk").applyInArrow(_count(ranges, p), COUNTS).groupBy("block").applyInArrow(_answers(p), ANSWERS)
    for level in range(1, len(p.levels) + 1):
        counted = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_count(ranges, p, level), COUNTS)
        answers = counted.groupBy("block").applyInArrow(_answers(p), ANSWERS)
    runs = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_runs(blocks, p), RUNS)
    return dealt, runs.groupBy("block").applyInArrow(_reduce(p), RANGES)


def remove_repeats(docs: DataFrame, p: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    A byte is removed if a string of p.length bytes that covers it also starts earlier: in a row with a smaller doc_id
    (of repeated rows, one that stands before it), or in the same text further to the front. Null and empty texts have
    no bytes. Matches never cross texts, but may cut characters. Other columns are not read; an empty table gives an
    empty one. Null ids come last.
    """
    dealt, ranges = repeated_ranges(docs, p)
    return dealt.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(_cut_out, OUT)


def op5(docs: DataFrame, p: SuffixParams = SuffixParams()) -> DataFrame:
    return remove_repeats(docs, p)
