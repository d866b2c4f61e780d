"""Keys and names that must not meet or gather: remainders of ids, repeated labels, hashes as names, anchors in many blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimgraph.llm import knn, ngram_join, quality, suffix
from tests.llm.test_brute_force import lower_words

IDS = "doc_id long, text string"


def test_queries_of_a_cell_are_spread(spark):
    """All queries in one cell, all ids divisible by 20, some negative: each of its groups gets its part, and the result is whole."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.05, (400, 6)) + 3, rng.normal(0, 1, (1600, 6))])
    ids = [20 * (i - 100) for i in range(400)] + [20 * i + 7 for i in range(1600)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    p = knn.KnnParams(k=3, query_rows=40, block_rows=400, most_pivots=4)
    asked, data = knn.dealt(vectors, vectors.filter("vec_id % 20 = 0"), p)
    sizes, held = ({r["task"]: r["count"] for r in df.groupBy("task").count().collect()} for df in (asked, data))
    assert len(sizes) >= 8 and max(sizes.values()) <= 3 * np.median(list(sizes.values()))
    assert set(held) <= set(sizes) and max(held.values()) <= 3 * np.median(list(held.values()))
    ints = {i: np.floor(64 * v) for i, v in zip(ids, x, strict=True)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.op2(vectors, p).collect()}
    for q in ids[:400]:
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:3]
        assert [got[q, r + 1] for r in range(3)] == [(i, -s) for s, i in best]


def test_repeated_labelled_id(spark):
    """5,000 rows of one labelled id teach one text; the bound in bytes takes whole texts."""
    taught = [i for i in range(1, 400) if not spark.range(1).select((F.crc32(F.lit(str(i))) % 5 == 0).alias("h")).first().h][:40]
    docs = spark.createDataFrame([(taught[0], f"text {i}") for i in range(5000)] + [(i, "x" * 1000) for i in taught[1:]] + [(None, "none"), (taught[1], None)], IDS)
    labels = spark.createDataFrame([(i, i % 2) for i in taught] * 3, "doc_id long, quality int")
    rows = quality.sample(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == taught and {r.text for r in rows if r.doc_id == taught[0]} == {"text 0"}
    few = quality.sample(docs, labels, quality.NetParams(sample_bytes=10_500)).collect()
    assert sum(len(r.text) for r in few) <= 10_500 and all(len(r.text) in (6, 1000) for r in few) and len(few) >= 10
    assert quality.sample(docs.filter("false"), labels).count() == quality.sample(docs, labels.filter("false")).count() == 0


def test_no_name_of_one_row_is_that_of_another(spark):
    """Ids that are the hashes of rows without ids: every document stays."""
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma", "delta")]
    hashes = [r.h for r in spark.createDataFrame([(None, t) for t in texts], IDS).select(F.xxhash64("doc_id", "text").alias("h")).collect()]
    rows = [(None, t) for t in texts] + [(h, f"other words that are only in document number {i} of these") for i, h in enumerate(hashes)]
    rows += [(2**63 - 1, "the largest of ids, and its own words"), (2**63 - 1, "the largest of ids again with a text that differs"), (2**63 - 1, None), (2**63 - 1, "")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, IDS), "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(rows, key=str)


def test_blocks_of_sets_by_their_bytes(spark):
    """Long documents make more blocks, and the components are those of all pairs."""
    words = [f"w{i}" for i in range(3000)]
    long = [(i, " ".join(words[i * 10 : i * 10 + 2500])) for i in range(30)]
    p = ngram_join.JoinParams(block_bytes=40_000)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(long, IDS), p).collect()}
    sets = {i: {tuple(lower_words(t)[j : j + 5]) for j in range(2496)} for i, t in long}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = {}
    for i in sets:
        want[i] = next((want[j] for j in range(i) if linked(i, j)), i)
    assert got == want


@pytest.mark.parametrize(("block_bytes", "wide"), [(2_000, 24), (2_000, 4), (1 << 20, 4)])
def test_anchor_of_few_suffixes_in_each_block(spark, block_bytes, wide):
    """A passage in ever different surroundings, in blocks that have few of them each: cut into windows by the sum of all blocks, with the result of plain Python."""
    rng = np.random.default_rng(4)
    noise = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage = noise(110)
    rows = [(i, noise(40) + passage + noise(40)) for i in range(150)]
    p = suffix.SuffixParams(block_bytes=block_bytes, wide=wide)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.op5(spark.createDataFrame(rows, IDS), p).collect()}
    seen, want = set(), {}
    for i, t in rows:
        gone = [False] * len(t)
        for j in range(len(t) - 99):
            if t[j : j + 100] in seen:
                gone[j : j + 100] = [True] * 100
            seen.add(t[j : j + 100])
        want[i] = (sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)))
    assert got == want


def test_different_suffixes_add_up():
    """Of an anchor with one suffix in each of many blocks: wide if they differ, not if they are copies."""
    p = suffix.SuffixParams()
    blocks = 200
    for marks, want in ((np.arange(blocks) % 251, 1), (np.zeros(blocks), 0)):
        grams = suffix.pack(np.array([5, 9], np.uint64))
        rows = {"block": [0] * blocks, "chunk": list(range(blocks)), "grams": [grams] * blocks, "different": [bytes([1, 1])] * blocks, "mark": [bytes([int(m), 7]) for m in marks]}
        out = suffix._answer(p)(pa.table(rows)).column("wide").to_pylist()
        assert {tuple(np.unpackbits(np.frombuffer(b, np.uint8), count=2)) for b in out} == {(want, 0)}


@pytest.mark.parametrize(("phrase", "copies"), [(88, 1), (95, 1), (95, 2)])
def test_wide_anchors_send_what_repeats(spark, monkeypatch, phrase, copies):
    """A phrase in ever different surroundings sends next to nothing if no window of it repeats; copies of the surroundings are found as by plain Python."""
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    same = noise(phrase)
    texts = [noise(150) + same + noise(150) for _ in range(120)]
    rows = [(i, f"{texts[i % 120]}{i // 120}{noise(30)}") for i in range(120 * copies)]
    docs, p = spark.createDataFrame(rows, IDS), suffix.SuffixParams(block_bytes=4_000)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.op5(docs, p).collect()}
    size = 300 + phrase
    assert got == {i: (size, 1) if i >= 120 else (0, 0) for i, _ in rows}

    def weighed(p):
        def run(table):
            n = sum(len(x) for x in table.column("rest").to_pylist())
            return pa.table({"chunk": pa.array([n], pa.int32())} | {k: pa.array([b""], pa.binary()) for k in ("rows", "starts", "ends")})

        return run

    monkeypatch.setattr(suffix, "_reduce", weighed)
    sent = sum(r.chunk for r in suffix.repeated_ranges(docs, p)[1].collect())
    # Suffixes of anchors that few texts have are sent whole; windows would be 100 bytes each.
    assert copies > 1 or sent <= sum(len(t) for _, t in rows)
