"""Stupid-backoff scores of every document against the rest of the corpus, by a join of n-grams with their counts.

Three relations, dealt by the hash of the n-gram. The exploded n-grams: for each block of documents and each range of
hashes, the block's n-grams of that range with how often it has them, one row of sorted packed columns. The count
tables: for each range, the sum over all blocks. Their join, on the n-gram, gives back for each exploded n-gram what
the other blocks have. Each document then takes off its own, and sums its words' scores. A row is a range of a block and
not one n-gram, since a row for each would take some ten times the space; ranges without n-grams have no row, so there
are never more rows than n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import U, batches, blocks_for, input_bytes, mix, pack, text_bytes, unpack, with_chunk, words_of


@dataclass(frozen=True)
class LmParams:
    order: int = 3
    #: What the score of a lower order is multiplied with.
    alpha: float = 0.4
    #: Input bytes in a block of documents.
    block_bytes: int = 10 << 20


def hash_bits(size: int) -> int:
    """Bits of an n-gram's hash, so that an n-gram meets another by chance about once in a million times."""
    return min(64, max(40, int(size).bit_length() + 20))


def ngram_hashes(words: np.ndarray, at: np.ndarray, order: int, bits: int) -> np.ndarray:
    """order x words: the hash of the n-gram of each length that ends in each word; 0 where the text has too few words before."""
    out = np.zeros((order, len(words)), np.uint64)
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    h = np.zeros(len(words), np.uint64)
    for n in range(order):
        shifted = np.zeros(len(words), np.uint64)
        shifted[n:] = words[: len(words) - n] if n else words
        h = mix(h * U(0x9E3779B97F4A7C15) + shifted) if n else mix(shifted)
        own = mix(h + U(n + 1)) >> U(64 - bits)
        out[n] = np.where(place >= n, np.maximum(own, U(1)), U(0))
    return out


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts by byte planes."""
    if not len(counts):
        return b"\0"
    wide = counts.astype("<u8")
    planes = max(1, (int(wide.max()).bit_length() + 7) // 8)
    return bytes([planes]) + wide.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    planes = blob[0]
    if not planes:
        return np.zeros(0, np.int64)
    body = np.frombuffer(blob, np.uint8, offset=1).reshape(planes, -1)
    wide = np.zeros((body.shape[1], 8), np.uint8)
    wide[:, :planes] = body.T
    return wide.view("<u8").ravel().astype(np.int64)


def _pieces(table: pa.Table, p: LmParams, bits: int):
    """(first document, n documents, offsets of their words, hashes) of parts of the block."""
    column = table.column("text").combine_chunks()
    _, offsets = text_bytes(column)
    for i, j in batches(offsets, 1 << 20):
        words, at = words_of(*text_bytes(column.slice(i, j - i)))
        yield i, j - i, at, ngram_hashes(words, at, p.order, bits)


def _distinct(table: pa.Table, p: LmParams, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's n-grams and their counts."""
    values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    some = []
    for _, _, _, hashes in _pieces(table, p, bits):
        v, c = np.unique(hashes[hashes > 0], return_counts=True)
        some.append((v, c))
    if some:
        every, inverse = np.unique(np.concatenate([v for v, _ in some]), return_inverse=True)
        values, counts = every, np.bincount(inverse, weights=np.concatenate([c for _, c in some]), minlength=len(every)).astype(np.int64)
    return values, counts


def _ask(parts: int, bits: int, p: LmParams):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        values, counts = _distinct(table, p, bits)
        edge = [(k << bits) // parts for k in range(1, parts)]
        cuts = np.concatenate([[0], np.searchsorted(values, np.array(edge, np.uint64)), [len(values)]]).astype(int)
        ends = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.table({"part": np.array([k for k, _, _ in ends], np.int32), "chunk": np.full(len(ends), chunk, np.int32), "grams": pa.array([pack(values[a:b]) for _, a, b in ends], pa.binary()), "counts": pa.array([pack_counts(counts[a:b]) for _, a, b in ends], pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    grams = [unpack(b) for b in table.column("grams").to_pylist()]
    counts = [unpack_counts(b) for b in table.column("counts").to_pylist()]
    every, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    # What the other blocks have: 0 for most, which packs well.
    answers = [pack_counts(total[inverse[a:b]] - c) for a, b, c in zip(at[:-1], at[1:], counts, strict=True)]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "others": pa.array(answers, pa.binary())})


#: As ``words_of`` has them.
WORD = r"[^\x20\x09-\x0D]+"
SCORES = "doc_id long, n_words long, n_backoff long, n_unseen long, score double"


def backoff(counts: np.ndarray, rest: np.ndarray, total: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each word, and the order at which it was found (0: nowhere).

    counts: order x words, of the n-gram that ends in the word; rest: of that n-gram without its last word (row 0 unused);
    total: words in the rest of the corpus.
    """
    order, n = counts.shape
    score = -np.log(total + 1.0) + order * np.log(alpha) if n else np.zeros(0)
    at = np.zeros(n, int)
    for k in range(order):
        have = counts[k] > 0
        base = total if k == 0 else rest[k]
        ratio = np.log(np.maximum(counts[k], 1)) - np.log(np.maximum(base, 1)) + (order - 1 - k) * np.log(alpha)
        score = np.where(have, ratio, score)
        at = np.where(have, k + 1, at)
    return score, at


def _score(bits: int, all_words: int, p: LmParams):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_backoff": pa.array([], pa.int64()), "n_unseen": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        values, counts = _distinct(docs, p, bits)
        blobs = answers.column("others").to_pylist()
        others = np.concatenate([unpack_counts(blobs[k]) for k in np.argsort(answers.column("part").to_numpy(), kind="stable")] + [np.zeros(0, np.int64)])
        if len(others) != len(values):
            raise ValueError("the counts don't belong to these documents")
        every = counts + others
        sums = {k: np.zeros(docs.num_rows) for k in ("n_words", "n_backoff", "n_unseen", "score")}
        for i, n, at, hashes in _pieces(docs, p, bits):
            size = np.diff(at)
            doc = np.repeat(np.arange(n), size)
            flat = np.searchsorted(values, hashes)
            # A document's own counts are taken off.
            key = doc[None, :] * len(values) + flat
            held = hashes > 0
            _, inverse, own = np.unique(key[held], return_inverse=True, return_counts=True)
            c = np.zeros(hashes.shape, np.int64)
            c[held] = every[flat[held]] - own[inverse]
            total = (all_words - size)[doc]
            rest = np.zeros_like(c)
            rest[1:, 1:] = c[:-1, :-1]
            score, found = backoff(c, rest, total.astype(float), p.alpha)
            possible = np.minimum(np.arange(len(doc)) - np.repeat(at[:-1], size) + 1, p.order)
            for k, x in (("n_words", np.ones(len(doc))), ("n_backoff", found < possible), ("n_unseen", found == 0), ("score", score)):
                sums[k][i : i + n] = np.bincount(doc, weights=x, minlength=n)
        return pa.table({"doc_id": docs.column("doc_id"), **{k: pa.array(sums[k].astype(np.int64)) for k in ("n_words", "n_backoff", "n_unseen")}, "score": pa.array(sums["score"])})

    return run


def score(docs: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """doc_id, n_words, n_backoff, n_unseen, score (the sum of log scores) and mean_score for each row.

    Words are lower-cased runs of other than white space. A word's score is the count of the longest n-gram that ends in
    it and occurs elsewhere in the corpus, over the count of that n-gram less the word, times alpha for each word it was
    shortened by; counts leave the document's own occurrences out, so copies score high and rare texts low. The first
    words of a text count as shortened too. A word that occurs nowhere else scores alpha**order / (words
    elsewhere + 1). Null, empty and blank texts have no words, score 0 and a null
    mean. Repeated rows are documents each. Other columns are not read; an empty table gives an empty one.
    """
    size = input_bytes(docs)
    bits, blocks = hash_bits(size), blocks_for(size, p.block_bytes)
    dealt = with_chunk(docs, blocks)
    exploded = dealt.groupBy("chunk").applyInArrow(_ask(2 * blocks, bits, p), "part int, chunk int, grams binary, counts binary")
    joined = exploded.groupBy("part").applyInArrow(_answer, "chunk int, part int, others binary")
    all_words = docs.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    done = dealt.groupBy("chunk").cogroup(joined.groupBy("chunk")).applyInArrow(_score(bits, int(all_words), p), SCORES)
    return done.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))


def op4(docs: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """``score``, rounded to six places."""
    done = score(docs, p)
    return done.select("doc_id", "n_words", "n_backoff", "n_unseen", F.round("score", 6).alias("score"), F.round("mean_score", 6).alias("mean_score"))


#: DuckDB: n-grams exploded, counted, joined, and summed by document.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT r, i, n, array_to_string(w[i - n + 1:i], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), range(1, 4) k(n) WHERE i >= n),
own AS (SELECT r, n, s, count(*) AS c FROM g GROUP BY ALL),
every AS (SELECT n, s, sum(c) AS c FROM own GROUP BY ALL),
rest AS MATERIALIZED (SELECT own.r, own.n, own.s, every.c - own.c AS c FROM own JOIN every USING (n, s)),
found AS (SELECT g.r, g.i, max(c) FILTER (g.n = 1) AS c1, max(c) FILTER (g.n = 2) AS c2, max(c) FILTER (g.n = 3) AS c3 FROM g JOIN rest USING (r, n, s) GROUP BY g.r, g.i),
b AS (SELECT a.*, p.c1 AS p1, p.c2 AS p2, (SELECT sum(len(w)) FROM d) - len(d.w) AS t FROM found a JOIN d USING (r) LEFT JOIN found p ON p.r = a.r AND p.i = a.i - 1),
f AS (SELECT r, i, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS k, CASE WHEN c3 > 0 THEN ln(c3) - ln(p2) WHEN c2 > 0 THEN ln(c2) - ln(p1) + ln(0.4) WHEN c1 > 0 THEN ln(c1) - ln(t) + 2 * ln(0.4) ELSE 3 * ln(0.4) - ln(t + 1) END AS x FROM b),
s AS (SELECT r, count(*) AS n_words, count(*) FILTER (k < least(i, 3)) AS n_backoff, count(*) FILTER (k = 0) AS n_unseen, sum(x) AS score FROM f GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff, CAST(coalesce(n_unseen, 0) AS BIGINT) AS n_unseen, round(coalesce(score, 0), 6) AS score, round(score / n_words, 6) AS mean_score
FROM d LEFT JOIN s USING (r)"""
