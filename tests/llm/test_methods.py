"""What the methods themselves promise: pruning, filters without misses, whole texts, reliabilities, both sides of each switch."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimgraph.llm import knn, langid, mixing, ngram_join, pii, quality, suffix
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_search_prunes_clusters(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (6, 8))
    middle = 40 * middle / np.linalg.norm(middle, axis=1)[:, None]
    x = middle[np.arange(1600) % 6] + rng.normal(0, 0.2, (1600, 8))
    x = 40 * x / np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = knn.KnnParams(k=5, query_rows=8, block_rows=200)
    asked, data = knn.dealt(vectors, vectors.filter("vec_id % 20 = 0"), p)
    a, b = ({r["task"]: r["count"] for r in df.groupBy("task").count().collect()} for df in (asked, data))
    scored = sum(n * b.get(k, 0) for k, n in a.items())
    assert scored < 0.5 * 80 * 1600  # of all pairs of queries and vectors
    ints = np.floor(64 * x)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.op2(vectors, p).collect()}
    for q in range(0, 1600, 20):
        order = sorted((-int(ints[q] @ ints[i]), i) for i in range(1600) if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in order]


def test_search_beyond_long(spark):
    rows = [(20, [1e18, 1.0]), (1, [1e18, 0.0]), (2, [-1e18, 0.0]), (3, [0.0, 2.0])]
    got = [(r.vec_id, r.score) for r in knn.op2(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 64 * 128), (2, -(2**63))]


TEXTS = [("aa", "banana bandana cabana"), ("aa", "banana und bandana"), ("bb", "fjord fjell und fjord"), ("bb", "fjell banana"), ("cc", "xyzzy")]


def grams_of(text, sizes=(3, 4)):
    chars = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
    chars = " ".join(chars.split()).join("  ")
    return [chars[i : i + n] for n in sizes for i in range(len(chars) - n + 1) if " " not in chars[i + 1 : i + n - 1]]


def test_language_filters(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(TEXTS * 3)], "doc_id long, text string, lang string")
    p = langid.LangParams(levels=(0.0, 0.05), slots=1 << 14)
    model = langid.train(docs, p)
    counts = {lang: {} for lang in ("aa", "bb", "cc")}
    for lang, t in TEXTS * 3:
        for g in grams_of(t):
            counts[lang][g] = counts[lang].get(g, 0) + 1

    def hashed(gram):
        chars = np.array([ord(c) if c != " " else 0 for c in gram], np.uint64)
        return langid.ngrams(chars, len(gram))[0]

    # Every n-gram is in each language that has it, and the more common ones in the second filter.
    for i, lang in enumerate(model.langs):
        total = sum(counts[lang].values())
        for g, n in counts[lang].items():
            masks = model.masks(hashed(g))
            assert model.bit(masks, 0, i)[0] == 1 and model.bit(masks, 1, i)[0] >= (n / total >= 0.05)
    # What a filter doesn't have passes as often as it says.
    other = np.random.default_rng(1).integers(0, 2**63, 200_000, dtype=np.uint64)
    for i in range(3):
        assert abs(model.bit(model.masks(other), 0, i).mean() - model.false_rate[0, i]) < 1e-3
    # The corrected popcounts decide, as worked out from plain sets.
    for text in ("bandana und cabana", "fjord", "xyzzy xyzzy banana"):
        own = grams_of(text)
        want = []
        for lang in model.langs:
            total = sum(counts[lang].values())
            want.append(sum(1 for g in own if g in counts[lang]) + sum(1 for g in own if counts[lang].get(g, 0) / total >= 0.05))
        got, score, cover = model.predict(pa.array([text]))
        assert got[0] == model.langs[int(np.argmax(want))] and abs(score[0] - max(want) / sum(want)) < 0.02
        assert abs(cover[0] - sum(g in counts[got[0]] for g in own) / len(own)) < 0.02
    kept = langid.keep_identified(spark.createDataFrame([(1, "banana"), (2, "qqqqq wwwww"), (3, None), (4, "12")], "doc_id long, text string"), model)
    assert [r.doc_id for r in kept.collect()] == [1]


def test_rare_language(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rare = [(10**6 + i, f"zorblat wixen grumfel vontag {w} wixen yarbek", "zz") for i, w in enumerate(("holvat", "grumfel", "yarbek", "temrik"))]
    model = langid.train(table.union(spark.createDataFrame(rare, table.schema)))
    assert model.predict(pa.array(["grumfel yarbek holvat vontag"]))[0] == ["zz"]


def test_quality_scores_whole_texts():
    p = quality.NetParams(chunk=32, width=5, filters=3, dims=2, epochs=2)
    rng = np.random.default_rng(5)
    texts = ["good " * 30, "b4d " * 25, "x", "é漢" * 40] * 4
    net = quality.fit(pa.array(texts), np.array([1, 0, 0, 1] * 4, np.float32), p)
    cases = [*texts[:4], "", None, "a" * 27, "a" * 28, "a" * 29, bytes(rng.integers(97, 123, 500).astype(np.uint8)).decode()]
    step = p.chunk - p.width + 1
    for text, got in zip(cases, net.scores(pa.array(cases)), strict=True):
        data = (text or "").encode()
        z = net.out_bias
        if data:
            many = -(-(len(data) + p.width - 1) // step)
            padded = bytes(p.width - 1) + data + bytes(many * step - len(data))
            pooled = []
            for c in range(many):
                windows = [[sum(net.table[j][padded[k + j]][f] for j in range(p.width)) for f in range(p.filters)] for k in range(c * step, (c + 1) * step)]
                pooled.append([max(0.0, max(w[f] for w in windows) + net.bias[f]) for f in range(p.filters)])
            for f in range(p.filters):
                own = [r[f] for r in pooled]
                z += sum(own) / many * net.out[0][f] + max(own) * net.out[1][f]
        assert abs(got - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-4


def test_quality_of_long_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op9(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "n_chars"), "doc_id").filter("held_out and n_chars > 3000")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.85


def test_reliabilities_are_estimated():
    # A labeler that agrees with the others is trusted; one that votes at random is not, whatever it is called.
    rows = [("++00+", 80), ("-+00+", 78), ("+-0-0", 60), ("--0-0", 62)]
    chance, prior, soft = pii.reliabilities(rows)
    assert abs(chance["check", "+", 1] - chance["check", "+", 0]) < 0.15
    assert chance["format", "+", 1] > 0.9 > 0.1 > chance["format", "+", 0]
    assert 0.4 < prior < 0.7 and soft[0] > 0.9 and soft[1] > 0.9 and soft[2] < 0.1 and soft[3] < 0.1


def test_classifier_scores_unseen_patterns(spark):
    known = [f"Call our phone 415-555-{1000 + i} or mail a{i}@b.example now" for i in range(30)] + [f"order no. 415.555-{2000 + i} of part" for i in range(30)]
    model = pii.train(spark.createDataFrame(list(enumerate(known)), "doc_id long, text string"))
    assert model.weights
    texts = ["call (415) 555-0100 now, or write to x@y.example", "invoice version 415 555-0199"]
    assert all(p not in known for p in texts)
    got = [r.added for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("row.doc_id").collect()]
    assert [x.kind for x in got[0]] == ["phone"] and texts[0][got[0][0].s : got[0][0].e] == "(415) 555-0100" and got[1] == []
    clean = [r.text for r in pii.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert clean == ["call [PHONE] now, or write to [EMAIL]", texts[1]]


def test_mixing_on_both_sides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for size in (1.0, 900.0):
        few = docs.filter("doc_id < 12")
        con = connect(SF)
        con.sql("CREATE VIEW few AS SELECT * FROM documents WHERE doc_id < 12")
        for most in (0, 8 << 20):
            compare(mixing.mix(few, size=size, most_broadcast=most).select("doc_id", "copy_no", "shuffle_key"), mixing.oracle(size=size, docs="few", columns="doc_id"), con)
    for wrong in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix(docs, {"a": wrong})


def test_columns_of_the_product_are_split(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:50] + [f"u{i}x{j}" for j in range(i % 9)])) for i in range(90)] + [(1000 + i, " ".join([*words[:20], *[f"v{i}y{j}" for j in range(40)]])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(tuple, ngram_join.op6(docs, ngram_join.JoinParams(stars=stars, column_rows=most)).collect())) for stars, most in ((0, 1024), (0, 7), (2, 7))]
    assert got[0] == got[1] == got[2]
    assert {c for i, _, c in got[0] if i < 90} == {0} and all(c == i for i, _, c in got[0] if i >= 1000)


def test_longer_strings(spark):
    text = bytes(np.random.default_rng(2).integers(97, 123, 700).astype(np.uint8)).decode()
    docs = spark.createDataFrame([(1, text), (2, "x" + text[100:500]), (3, text[300:500] + "tail")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix.op5(docs, suffix.SuffixParams(length=200)).collect()}
    assert got == {1: 0, 2: 400, 3: 200}


def test_many_rows_without_ids(spark):
    rows = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(8)]).alias("text"))
    from claimgraph.llm.common import with_chunk

    assert with_chunk(rows, 16).groupBy("chunk").count().agg(F.max("count")).first()[0] < 1_000
    assert ngram_join.op6(rows).filter("component_id is null").count() == 10_000
