"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents are dealt into blocks by a hash of their id, n-grams by a hash of their own, so each cell of the incidence
matrix is one packed row. The column sums of the product's diagonal, how many documents have an n-gram, come first:
a partner of a document of n n-grams shares 80 n / 100 of them at least, so a document with too few n-grams of a sum
over one has no partner and its row is dropped. What is left is collapsed to one row for each distinct set. For those,
overlap is accumulated over the n-grams of the shortest prefix that any partner must meet, pairs beyond the bounds
that their sizes set are discarded, and what remains is counted exactly. The column sums are taken again over distinct sets, so
that copies don't count, and order the n-grams: rare ones come first, and few prefixes hold what many documents share.

Links inside a group of near copies aren't all spelt out: once documents are known to be in one component, pairs
among them are passed over. Every pair of documents that are linked ends in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import U, batches, blocks_for, cut, input_bytes, mix, pack, text_bytes, unpack, with_chunk, words_of
from claimgraph.llm.components import components

#: Odd multipliers of the words of a shingle, by place.
PLACE = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]
#: Bits of a shingle's hash that the first filter compares; agreement by chance only keeps a document longer.
FILTER_BITS = 40


@dataclass(frozen=True)
class JoinParams:
    #: Words in a shingle.
    n: int = 5
    #: 100 * intersection >= percent * union
    percent: int = 80
    #: Input bytes in a block of documents.
    block_bytes: int = 10 << 20
    #: Rounds in which each n-gram's documents are tried against one of them, before the rest.
    stars: int = 2
    #: Sets of a column of the product that one task multiplies with the column; columns of more are split.
    column_rows: int = 1_024


def shingles(column: pa.ChunkedArray, p: JoinParams) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, whole = text_bytes(column)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for i, j in batches(whole, 1 << 20):
        words, at = words_of(*text_bytes(column.slice(i, j - i)))
        size = max(0, len(words) - p.n + 1)
        grams = np.zeros(size, np.uint64)
        for k in range(p.n):
            grams += words[k : k + size] * PLACE[k % len(PLACE)]
        grams = mix(grams)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= p.n:
                yield np.unique(grams[a : b - p.n + 1])
            elif b > a:
                short = (words[a:b] * np.resize(np.array(PLACE), b - a)).sum(keepdims=True) + U(b - a)
                yield mix(short ^ U(0xA5A5A5A5A5A5A5A5))
            else:
                yield np.zeros(0, np.uint64)


def need(n, p: JoinParams):
    """The least overlap with any partner of a set of n."""
    return -(-p.percent * n // 100)


def _columns(blocks: int, p: JoinParams):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        sets = list(shingles(table.column("text"), p))
        own = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) >> U(64 - FILTER_BITS))
        cuts = np.searchsorted(own, (np.arange(blocks + 1, dtype=np.uint64) << U(FILTER_BITS)) // U(blocks))
        some = np.flatnonzero(np.diff(cuts))
        return pa.table({"block": some.astype(np.int32), "chunk": np.full(len(some), chunk, np.int32), "cell": pa.array([pack(own[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())})

    return run


def _sums(table: pa.Table) -> pa.Table:
    cells = [unpack(x) for x in table.column("cell").to_pylist()]
    values, counts = np.unique(np.concatenate(cells), return_counts=True)
    often = counts > 1
    return pa.table({"chunk": table.column("chunk"), "block": table.column("block"), "often": pa.array([np.packbits(often[np.searchsorted(values, x)]).tobytes() for x in cells], pa.binary()), "n": pa.array([len(x) for x in cells], pa.int32())})


SETS = "doc_id long, n_shingles long, k1 long, k2 long, grams array<long>"


def precedes(a: int | None, b: int | None) -> bool:
    """a < b, with nulls last."""
    return a is not None and (b is None or a < b)


def _rows(p: JoinParams):
    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        sets = list(shingles(docs.column("text"), p)) if docs.num_rows else []
        ids = docs.column("doc_id").to_pylist()
        each = np.concatenate([*sets, np.zeros(0, np.uint64)]) >> U(64 - FILTER_BITS)
        own, inverse, counts = np.unique(each, return_inverse=True, return_counts=True)
        order = np.argsort(sums.column("block").to_numpy(), kind="stable")
        bits, sizes = sums.column("often").to_pylist(), sums.column("n").to_pylist()
        far = np.concatenate([np.unpackbits(np.frombuffer(bits[k], np.uint8), count=sizes[k]) for k in order] + [np.zeros(0, np.uint8)])
        if len(far) != len(own):
            raise ValueError("the sums don't belong to these documents")
        often = ((far > 0) | (counts > 1))[inverse]
        held: dict[tuple, int] = {}
        k1, k2, grams, at = [], [], [], 0
        for i, s in enumerate(sets):
            shared = int(np.count_nonzero(often[at : at + len(s)]))
            at += len(s)
            a, b = (s.sum(dtype=np.uint64), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else (U(0), U(0))
            k1.append(a.astype(np.int64)), k2.append(b.astype(np.int64))
            if len(s) and shared >= need(len(s), p):
                key = (len(s), int(a), int(b))
                last = held.get(key)
                if last is None or precedes(ids[i], ids[last]):  # one document of each set keeps it
                    if last is not None:
                        grams[last] = None
                    held[key] = i
                    grams.append(s.view(np.int64))
                    continue
            grams.append(None)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "grams": pa.array(grams, pa.list_(pa.int64()))})

    return run


def incidence(docs: DataFrame, p: JoinParams) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (a digest of the set) for all documents; grams for those that may have a partner, of one of each set in a block at least."""
    blocks = blocks_for(input_bytes(docs), p.block_bytes)
    dealt = with_chunk(docs, blocks)
    cells = dealt.groupBy("chunk").applyInArrow(_columns(2 * blocks, p), "block int, chunk int, cell binary")
    sums = cells.groupBy("block").applyInArrow(_sums, "chunk int, block int, often binary, n int")
    return dealt.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_rows(p), SETS)


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("grams").combine_chunks()
    at = column.offsets.to_numpy()
    return column.values.to_numpy().view(np.uint64), at


def _set_columns(blocks: int):
    """As ``_columns``, of sets that are known: with how many of the block's sets have each n-gram."""

    def run(table: pa.Table) -> pa.Table:
        flat, at = _lists(table)
        own, counts = np.unique(flat[at[0] : at[-1]] >> U(64 - FILTER_BITS), return_counts=True)
        cuts = np.searchsorted(own, (np.arange(blocks + 1, dtype=np.uint64) << U(FILTER_BITS)) // U(blocks))
        some = np.flatnonzero(np.diff(cuts))
        return pa.table({"block": some.astype(np.int32), "chunk": np.full(len(some), table.column("chunk")[0].as_py(), np.int32), "cell": pa.array([pack(own[cuts[k] : cuts[k + 1]]) for k in some], pa.binary()), "n": pa.array([np.minimum(counts[cuts[k] : cuts[k + 1]], 2**31 - 1).astype(np.int32).tobytes() for k in some], pa.binary())})

    return run


def _set_sums(table: pa.Table) -> pa.Table:
    """The sums over all sets, as one more than their binary logarithm; 0 for a sum of 1."""
    cells = [unpack(x) for x in table.column("cell").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("n").to_pylist()])
    _, inverse = np.unique(np.concatenate(cells), return_inverse=True)
    level = np.ceil(np.log2(np.bincount(inverse, weights=counts))).astype(np.uint8)[inverse]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in cells])])
    return pa.table({"chunk": table.column("chunk"), "block": table.column("block"), "level": pa.array([level[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


ENTRIES = "key long, id long, n long, at long, kept long"


def _prefixes(p: JoinParams):
    """The prefix of each set in one order of all n-grams, rare ones first; n-grams of no other set meet nothing and are left out."""

    def run(table: pa.Table, sums: pa.Table) -> pa.Table:
        out = {k.split()[0]: [np.zeros(0, np.int64)] for k in ENTRIES.split(", ")}
        if table.num_rows:
            flat, at = _lists(table)
            own = np.unique(flat[at[0] : at[-1]] >> U(64 - FILTER_BITS))
            blobs = sums.column("level").to_pylist()
            levels = np.frombuffer(b"".join(blobs[k] for k in np.argsort(sums.column("block").to_numpy(), kind="stable")), np.uint8)
            if len(levels) != len(own):
                raise ValueError("the sums don't belong to these sets")
            for i, ident in enumerate(table.column("id").to_pylist()):
                s = flat[at[i] : at[i + 1]]
                level = levels[np.searchsorted(own, s >> U(64 - FILTER_BITS))]
                least = need(len(s), p)
                if np.count_nonzero(level) < least:
                    continue
                size = len(s) - least + 1
                key = np.sort((level.astype(np.uint64) << U(56)) | (mix(s) >> U(8)))[:size].view(np.int64)
                key = key[key >= 1 << 56]
                for k, x in (("key", key), ("id", np.full(len(key), ident)), ("n", np.full(len(key), len(s))), ("at", np.arange(size - len(key), size)), ("kept", np.full(len(key), len(key)))):
                    out[k].append(x)
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    return run


def prefixes(sets: DataFrame, p: JoinParams) -> DataFrame:
    # By the bytes that sets have, which for long documents are many times those of others.
    held = sets.agg(F.sum(F.size("grams").cast("long") * 8)).first()[0] or 0
    blocks = blocks_for(held, p.block_bytes * 2)
    dealt = sets.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    cells = dealt.groupBy("chunk").applyInArrow(_set_columns(2 * blocks), "block int, chunk int, cell binary, n binary")
    sums = cells.groupBy("block").applyInArrow(_set_sums, "chunk int, block int, level binary")
    return dealt.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_prefixes(p), ENTRIES)


def _overlaps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        a, b = part.column("ga"), part.column("gb")
        pa_, va, pb_, vb = a.offsets.to_numpy(), a.values.to_numpy(), b.offsets.to_numpy(), b.values.to_numpy()
        both = [len(np.intersect1d(va[pa_[i] : pa_[i + 1]], vb[pb_[i] : pb_[i + 1]], assume_unique=True)) for i in range(part.num_rows)]
        yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "na": part.column("na"), "nb": part.column("nb"), "overlap": pa.array(both, pa.int64())})


def sizes_allow(x, y, p: JoinParams):
    return (F.least(x, y) * 100 >= F.greatest(x, y) * p.percent)


def verified(pairs: DataFrame, sets: DataFrame, p: JoinParams) -> DataFrame:
    """The (a, b) of the pairs that are linked; each set meets its pairs in two joins on ids."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    rows = pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "ga", "gb").mapInArrow(_overlaps, "a long, b long, na long, nb long, overlap long")
    return rows.filter(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * p.percent).select("a", "b")


def labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("label", F.col("id"))
    return entries.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def product(entries: DataFrame, p: JoinParams) -> DataFrame:
    """a, b: the cells of the product over the prefix columns that may still be links.

    ``entries``: key, id, n, at, label, most, m: a column's sets, the label that most of them have, and their number. A
    column is multiplied in parts of p.column_rows sets. Overlaps are accumulated over all columns; a cell is dropped when
    its sizes differ too much, when too few n-grams stand from its first common one on, and, once accumulated, when what
    both have behind their last common one doesn't make up for what is missing. Sets of one label aren't multiplied.
    """
    parts = F.ceil(F.col("m") / p.column_rows).cast("int")
    side = F.struct("id", "n", "at", "label", (F.col("label") != F.col("most")).alias("minor"))
    rest = entries.filter("label <> most").select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), side.alias("x"))
    every = entries.select("key", side.alias("y"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    nx, ny, ix, iy = F.col("x.n"), F.col("y.n"), F.col("x.at"), F.col("y.at")
    least = lambda a, b: F.floor(((a + b) * p.percent + 99 + p.percent) / float(100 + p.percent))
    # The first n-gram that linked sets share has, in both, as many n-grams from it on as they must share: common ones
    # further on in either aren't looked at, and all of them stand behind those that are. What stands before an n-gram
    # in either bounds the overlap too.
    bound = (nx - ix >= least(nx, ny)) & (ny - iy >= least(nx, ny)) & (F.least(ix, iy) + F.least(nx - ix, ny - iy) >= least(nx, ny))
    met = rest.join(every, ["key", "part"]).filter((F.col("x.label") != F.col("y.label")) & (~F.col("y.minor") | (F.col("x.id") < F.col("y.id"))) & sizes_allow(nx, ny, p) & bound)
    swap = F.col("x.id") > F.col("y.id")
    of = lambda f, first: F.when(swap == F.lit(not first), F.col(f"x.{f}")).otherwise(F.col(f"y.{f}"))
    cells = met.select(*[of(f, first).alias(f"{f}_{'a' if first else 'b'}") for f in ("id", "n", "at") for first in (True, False)])
    sums = cells.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("overlap"), F.first("n_a").alias("na"), F.first("n_b").alias("nb"), F.max("at_a").alias("ia"), F.max("at_b").alias("ib"))
    most = F.col("overlap") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
    return sums.filter(most >= least(F.col("na"), F.col("nb"))).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def links(sets: DataFrame, p: JoinParams) -> DataFrame | None:
    """id, label: components among sets (id, n, grams); None if there are no links."""
    entries = cut(prefixes(sets, p))
    edges = labels = None
    for k in range(p.stars + 1):
        now = labelled(entries, labels)
        top = F.struct(F.xxhash64("id", F.lit(k)).alias("h") if k else F.col("id").alias("h"), "id", "n", "label")
        groups = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(top).alias("hub"), F.mode("label", True).alias("most"), F.count(F.lit(1)).alias("m")).filter("lo != hi")
        mixed = now.join(groups, "key")
        if k < p.stars:
            # Whom most of a document's prefix names is tried first. What this leaves, the last round finds.
            named = mixed.filter((F.col("label") != F.col("hub.label")) & sizes_allow(F.col("n"), F.col("hub.n"), p)).groupBy(F.col("hub.id").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.max("kept").alias("kept"))
            pairs = named.filter("met * 2 >= kept")
        else:
            pairs = product(mixed, p)
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if pairs.isEmpty():
            continue
        new = cut(verified(pairs, sets, p))
        if not new.isEmpty():
            edges = new if edges is None else edges.union(new)
            labels = components(edges)
    return labels


def near_duplicates(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    A set is the distinct p.n-word shingles of a text; a shorter text is one shingle; null, empty and blank texts have
    none and are linked with nothing. component_id is the smallest doc_id that links reach. Equal sets of one shingle
    or more are linked, however many there are; repeated rows are copies of each other. A row without a doc_id can't be
    named by a link: it takes the component of rows with an equal set, or null if none has a doc_id. Other columns of ``docs`` are not read; an empty table gives an empty one.
    """
    rows = cut(incidence(docs, p))
    key = ["n_shingles", "k1", "k2"]
    classes = rows.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    kept = rows.filter("grams is not null").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "grams", *key)
    # Of each set, the row of its smallest doc_id: rows that keep their grams are few, one for a set and block.
    first = kept.groupBy(*key).agg(F.min("id").alias("id"))
    sets = cut(kept.join(first, [*key, "id"], "left_semi").select("id", "n", "grams").dropDuplicates(["id"]))
    labels = links(sets, p)
    named = classes.withColumn("label", F.col("id")) if labels is None else classes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = cut(named.filter("copies > 1 or label != id").select(*key, "label"))  # of known size: small, it is broadcast
    return rows.join(named, key, "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def op6(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    return near_duplicates(docs, p)


#: DuckDB: overlaps of all pairs that share a shingle, then the smallest id in reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT e.a, reach.r FROM reach JOIN e ON e.b = reach.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(r) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id"""
