"""The pipeline's rows after its stages against plain Python, with repeated rows and rows without ids."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_brute_force import lower_words
from tests.llm.test_edges import CLASHES

SF = "/root/testdata/sf0.001"

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
EDGES = [
    (7, A, "en", "s", 1), (7, A, "en", "s", 1), (7, A, "en", "t", 1),  # a repeated row
    (9, A + " tail", "en", "s", 1), (None, A, "en", "s", 1),
    (None, B, "en", "s", 1), (None, B, "en", "s", 1), (None, B + " tail", "de", None, 1),  # no id at all
    (8, C, "en", "s", 1), (8, "other words of the same id here", "en", "s", 1), (3, C, "en", "s", 1),
    (5, None, "en", "s", 0), (5, None, "en", "s", 0), (6, "  ", "en", "s", 0), (None, None, None, None, 0), (None, None, None, None, 0),
]


def test_one_row_of_a_group(spark):
    docs = spark.createDataFrame(EDGES, COLUMNS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    none = [x for x in got if x[0] is None and x[1] is not None]
    assert len(none) == 1 and none[0][1] in (B, B + " tail")
    want = [(7, A), (8, "other words of the same id here"), (3, C), (5, None), (6, "  "), (None, None), (None, None)]
    assert sorted((x for x in got if x not in none), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), "").count() == 0
    plain = docs.filter("doc_id in (3, 9) or (doc_id = 8 and n_chars = 1 and length(text) < 60)")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, plain, "").collect()) == [3, 8, 9]


def test_stages_keep_any_column(spark):
    """All stages but the last return the columns as they came, whatever their names and types."""
    extra = {**{c: F.lit(f"is {c}") for c in [*CLASHES, "repeated", "name", "__n", "__odd", "__row", "__doc", "__order", "t"]}, "a map": F.create_map(F.lit("k"), F.lit(1))}
    for rows in (EDGES, [x for x in EDGES if x[0] in (3, 9)]):
        docs = spark.createDataFrame(rows, COLUMNS).select("*", *[v.alias(c) for c, v in extra.items()])
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, SF)
            if name == "mixing":
                assert {"copy_no", "shuffle_key"} < set(done.columns) and done.count() >= 0
                continue
            assert done.columns == docs.columns, name
            got = done.collect()
            assert got and all(r[c] == (f"is {c}" if c != "a map" else {"k": 1}) for r in got for c in extra), name


def shingled(text):
    ws = lower_words(text or "")
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def kept_of_groups(rows):
    """Of rows with ids of their own, the ids that stay: the smallest of each component of links, all pairs compared."""
    sets, up = {i: shingled(t) for i, t in rows}, {i: i for i, _ in rows}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        met = Counter(j for g in s for j in holders[g] if j < i)
        for j, n in met.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i for i in up if up[i] == i}


def windows(ws, k):
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def asked(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def draws(rows):
    """(doc_id, copy_no) of the last stage, from (doc_id, source)."""
    counts, out = Counter(s for _, s in rows), Counter()
    for i, s in rows:
        rate = len(rows) / len(counts) / counts[s]
        u = int(hashlib.md5(f"mix|{i}|1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out.update((i, n) for n in range(k))
    return out


def test_stages_by_hand(spark, tmp_path):
    """The doc_ids after each stage. Which language a text has is the model's; that it has one is seen by its letters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    bench = [asked(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    far = 10**6
    edges = [(far, None, "en", "s", 0), (far + 1, "12 !!", "en", "s", 5), (far + 2, C + " the end of it", "en", None, 1), (far + 3, C + " the end of it", "en", "s", 1), (far + 4, "And then they said: " + " ".join(max(bench, key=len)[:10]) + " which was the end of it.", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(edges, docs.schema))
    rows = {r.doc_id: r for r in docs.collect()}
    # Texts without a letter have no language.
    left = {i for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")}
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append([tuple(r) for r in docs.select("doc_id", *(["copy_no"] if i == 4 else [])).collect()])
    ids = [[x[0] for x in s] for s in seen[:4]]
    assert set(ids[0]) <= left and len(left - set(ids[0])) <= len(left) // 50, sorted(left - set(ids[0]))
    left = kept_of_groups([(i, rows[i].text) for i in ids[0]])
    assert sorted(ids[1]) == sorted(left)
    parts = {k: set().union(*[windows(b, k) for b in bench if min(len(b), 10) == k]) for k in {min(len(b), 10) for b in bench if b}}
    left = {i for i in left if not any(windows(asked(rows[i].text), k) & w for k, w in parts.items())}
    assert sorted(ids[2]) == sorted(left) == sorted(ids[3])
    assert far + 2 in left and not left & {far + 3, far + 4}
    assert Counter(seen[4]) == draws([(i, rows[i].source) for i in ids[3]])
