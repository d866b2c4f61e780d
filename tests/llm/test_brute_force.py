"""The training-data operators against brute force, on the small tables and on cases at their edges."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimgraph.llm import decontam, knn, langid, lm, mixing, ngram_join, pii, quality, suffix, tokens
from claimgraph.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
EDGES = [(90001, None), (90002, ""), (90003, " \n"), (90004, "a b c"), (90005, "A B  c"), (90006, "a b c d e"), (90007, "é漢字 don't " * 3000), (90008, "x" * 100_000), (90009, "ab" * 300), (90010, "ab" * 300), (90010, "ab" * 300)]


@pytest.fixture(scope="module")
def docs(spark):
    more = spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in EDGES], "doc_id long, text string, lang string, source string, chunk string")
    table = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 250").select("doc_id", "text", "lang", "source").withColumn("chunk", F.lit("clash"))
    return table.unionByName(more).repartition(6).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < -1")


def lower_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLES[name], connect(SF))


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark):
    cases = ["a@b.c@d.e x@y..z a.b.@c.d.e.f. a@b.com_x@d.com 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111-4 +1 (415) 555-0100 +12.\x01 é+49 30 1234567", "(415) 555-0100 bob (at) mail (dot) com ssn 123-45-6789", "1 " * 3000, "a.b@" * 2000 + "c.d", "x" * 100_000 + "@", "4" * 50_000, None, ""]
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = table.union(spark.createDataFrame(list(enumerate(cases, 50_000)), "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    got = pii.op1(both).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = base_spans(texts[r.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (r.doc_id, told, r.spans)
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
        assert r.n_card == sum(k == "card" for k, _, _ in spans)
    model = pii.train(both)
    clean = pii.redacted(both.filter("doc_id >= 50000"), model)
    assert not any(base_spans(r.text or "") for r in clean.filter("doc_id not in (50000, 50004)").collect())


def test_tokens(docs, rows, empty):
    tokenizer = tokens.load(tokens.TOKENIZER)
    want = Counter((i, len(tokenizer.encode(t, add_special_tokens=False).ids), len(t.encode())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_bytes) for r in tokens.op3(docs).collect()) == want
    small, safe = tokens.TokenParams(chunk=300, overlap=16), tokens.margin(tokens.TOKENIZER)
    for t in [*(t for _, t in rows if len(t) < 20_000), "a<|endoftext|> b" * 200, "don't  we'll\n\n " * 90, "x" * 3000, " " * 2000, "漢字" * 900, "'ll" * 700, "a  <|endof" * 200]:
        assert tokens.spliced(tokenizer, t, small, safe) == len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert tokens.op3(empty).count() == 0


def test_lm(spark, docs, empty):
    some = docs.filter("doc_id % 2 = 0 and length(coalesce(text, '')) < 20000 and doc_id <> 90010")
    words = [(r.doc_id, lower_words(r.text or "")) for r in some.collect()]
    grams = lambda w: Counter(tuple(w[i - n + 1 : i + 1]) for i in range(len(w)) for n in (1, 2, 3) if i - n + 1 >= 0)
    total, size = Counter(), 0
    for _, w in words:
        total.update(grams(w))
        size += len(w)
    got = {r.doc_id: r for r in lm.op4(some, lm.LmParams(block_bytes=50_000)).collect()}
    for i, w in words:
        own, rest, score, unseen = grams(w), size - len(w), 0.0, 0
        left = lambda g: total[g] - own[g]  # noqa: B023, E731
        for j in range(len(w)):
            for n in (3, 2, 1):
                g = tuple(w[j - n + 1 : j + 1])
                if j - n + 1 >= 0 and left(g) > 0:
                    score += math.log(left(g) / (rest if n == 1 else left(g[:-1]))) + (3 - n) * math.log(0.4)
                    break
            else:
                unseen += 1
                score += 3 * math.log(0.4) - math.log(rest + 1)
        assert (got[i].n_words, got[i].n_unseen) == (len(w), unseen)
        assert abs(got[i].score - score) <= 1e-6 * (1 + abs(score))
    assert lm.op4(empty).count() == 0


def test_suffix(spark, docs, rows, empty):
    want, seen = Counter(), set()
    for i, t in sorted(rows):
        raw, gone, end = t.encode(), bytearray(len(t.encode())), 0
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[max(s, end) : s + 100] = b"\1" * (s + 100 - max(s, end))
                end = s + 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        want[i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    for wide in (2, 24):
        got = suffix.op5(docs, suffix.SuffixParams(block_bytes=60_000, wide=wide)).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix.op5(empty).count() == 0


def test_merge_never_loses_order():
    runs = [sorted({bytes(f"{(x * k) % 97:b}", "ascii") for x in range(40)}) for k in (3, 5, 7, 11, 13)]
    fronts = [[0, *(suffix.common(a, b, 0) for a, b in zip(r, r[1:], strict=False))] for r in runs]
    out = [runs[r][i] for r, i, _ in suffix.merge(list(zip(runs, fronts, strict=True)))]
    assert out == sorted(x for r in runs for x in r)


def test_ngram_join(spark, docs, rows, empty):
    base = [f"w{i}" for i in range(200)]
    near = [(70_000 + k, " ".join(f"z{k}" if (i * 7 + k * k) % 41 == k % 9 and i % 50 < 6 else w for i, w in enumerate(base))) for k in range(120)]
    every = docs.filter("doc_id <> 90010").select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    sets = {}
    for i, t in [*(r for r in rows if r[0] != 90010), *near]:
        w = lower_words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inverse = {}
    for i, s in sets.items():
        for g in s:
            inverse.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, o in Counter(j for g in s for j in inverse[g] if j < i).items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    for stars in (0, 2):
        got = ngram_join.op6(every, ngram_join.JoinParams(stars=stars)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.op6(empty).count() == 0


def test_langid(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op8(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    edges = {r.doc_id: r.lang_pred for r in langid.op8(docs).filter("doc_id > 90000").collect()}
    assert edges[90001] == edges[90002] == edges[90003] == "und"
    assert langid.op8(empty).count() == 0
    assert langid.identify(docs, langid.train(empty)).filter("lang_pred <> 'und'").count() == 0


def test_quality(spark, docs, empty):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op9(table, labels).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.9
    scores = [r.score for r in quality.op9(docs, labels).filter("doc_id > 90000").collect()]
    assert len(scores) == len(EDGES) and all(0 <= s <= 1 for s in scores)
    assert quality.op9(empty, labels).count() == 0


def test_mixing(spark, docs, empty):
    odd = docs.unionByName(spark.createDataFrame([(None, None, "en", None, "c")], docs.schema))
    got = mixing.mix(odd, {"s": 0.0}, 1.0, 3.0)
    assert got.filter("source = 's'").count() == 0
    assert got.columns[-2:] == ["copy_no", "shuffle_key"]
    big = mixing.mix(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a").alias("source")), None, 1.0, 900.0)
    assert abs(big.count() / 400 - 900) < 15
    assert mixing.mix(empty).count() == 0


def test_decontam(spark, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short Item"), (3, None), (4, "--")], "item_id long, text string")
    texts = ["x One two THREE four five six seven eight nine ten y", "one two three four five six seven eight nine", "a short-item b short item", None, "", "one two three four five six seven eight nine ten eleven twelve " * 2]
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words long")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.decontaminate(table, bench).collect()}
    assert got == {0: (12, 10, ["1"], True), 1: (9, 0, [], False), 2: (6, 4, ["2"], True), 3: (0, 0, [], False), 4: (0, 0, [], False), 5: (24, 24, ["1"], True)}
    assert decontam.op10(table, bench.filter("item_id < 0")).filter("contaminated").count() == 0
    assert decontam.op10(empty, bench).count() == 0


def test_knn(spark):
    vectors = spark.createDataFrame([(i, [float((i * j) % 7) - 3 for j in range(1, 5)]) for i in range(300)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 4), (1003, [0.5] * 4), (1020, [0.5] * 4)], "vec_id long, embedding array<double>")
    ok = [(r.vec_id, [math.floor(64 * x) for x in r.embedding]) for r in vectors.collect() if r.embedding and None not in r.embedding and all(map(math.isfinite, r.embedding))]
    want = set()
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in ok if j != i)[:20]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in knn.op2(vectors, knn.KnnParams(block_rows=40)).collect()}
    assert got == want
    assert knn.op2(vectors.filter("vec_id < 0")).count() == 0
