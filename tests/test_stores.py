"""Stores merged a part at a time: what stays, what is refused, and labels against items taken one by one."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import archive, keyed_store, sentence_view, state

ITEM = "at int, headline string, entity string, date string, claim_type string, denominator_stated string, topic string, reviewed boolean, auto_labelled boolean, sources array<struct<name string, url string, source_tier int>>"


def item(at, url, headline="h", claim=None, topic=None, reviewed=None, date="2024-01-05", tiers=(3,)):
    return (at, headline, None, date, claim, None, topic, reviewed, False, [("s", "", 1), *[("n", url, t) for t in tiers]])


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{folder}/data") for f in fs if f.startswith("part-")}


def test_archive_over_captures(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, ITEM)
    day = dt.date
    store = keyed_store.created(spark, f"{tmp_path}/a", ["url"], archive.ARCHIVE, buckets=8)
    first = [item(1, "u1", topic="t1", reviewed=True, claim="target"), item(2, "u1", topic="t2"), item(3, "u2", date="no day"), item(4, None), *[item(9 + n, f"x{n}") for n in range(40)]]
    store = archive.capture(store, df(first), "2024-02-01", ["at"])
    got = {r.url: r for r in store.rows().collect()}
    assert len(got) == 42
    assert (got["u1"].topic, got["u1"].claim_type, got["u1"].reviewed, got["u1"].first_seen, got["u1"].min_tier, got["u1"].max_tier) == ("t1", "target", True, day(2024, 1, 5), 1, 3)
    assert (got["u2"].first_seen, got["u2"].captured, got["u2"].outcome, got["u2"].claim_type, got["u2"].denominator_stated) == (day(2024, 2, 1), day(2024, 2, 1), "", "unclassified", "?")
    store = archive.settle(store, spark.createDataFrame([("u1", "delivered", "seen", day(2024, 2, 2)), ("gone", "abandoned", "", None)], "url string, outcome string, outcome_note string, outcome_date date"))
    before, path = files_of(tmp_path / "a"), dict(store.at)
    # The second capture sees one claim again, without a review, and one that is new; buckets of neither stay as they are.
    store = archive.capture(store, df([item(1, "u1", headline="new", topic="t3", claim="announced", date="2024-01-09", tiers=(5,)), item(2, "u3", reviewed=True, topic="r")]), "2024-02-03", ["at"])
    after = files_of(tmp_path / "a")
    touched = {b for b in store.at if store.at[b] != path.get(b)}
    assert 1 <= len(touched) <= 2 and len(store.at) > 4
    assert {f: m for f, m in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched} == {f: m for f, m in after.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    got = {r.url: r for r in keyed_store.opened(spark, store.folder).rows().collect()}
    assert len(got) == 43
    u1 = got["u1"]
    assert (u1.headline, u1.topic, u1.claim_type, u1.reviewed, u1.max_tier, u1.date) == ("new", "t1", "target", True, 5, "2024-01-09")
    assert (u1.first_seen, u1.captured, u1.last_seen, u1.outcome, u1.outcome_note, u1.outcome_date) == (day(2024, 1, 5), day(2024, 2, 1), day(2024, 2, 3), "delivered", "seen", day(2024, 2, 2))
    # A new review is taken over.
    store = archive.capture(store, df([item(1, "u1", topic="t4", reviewed=True)]), "2024-02-04", ["at"])
    assert [(r.topic, r.claim_type) for r in store.rows().filter("url = 'u1'").collect()] == [("t4", "unclassified")]


def test_second_writer_is_refused(spark, tmp_path):
    store = keyed_store.created(spark, f"{tmp_path}/s", ["k"], "k long, v string", buckets=4)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    one = store.merge(rows, lambda old, new: new)
    with pytest.raises(RuntimeError, match="another writer"):
        store.merge(rows.withColumn("v", F.lit("z")), lambda old, new: new)
    assert sorted(keyed_store.opened(spark, store.folder).rows().collect()) == [(1, "a"), (2, "b")]
    gone = one.merge(rows, lambda old, new: F.when(new["k"] > 1, new))
    assert gone.rows().collect() == [(2, "b")]
    assert store.merge(rows.filter("false"), lambda old, new: new) is store


LABEL = "url string, topic string, denominator_stated string, label_schema_version int, reviewed boolean, label_source string"


def one_by_one(items, store):
    """The items' labels put into a dict, one after the other."""
    store = {u: dict(row) for u, row in store.items()}
    for i in items:
        held = store.get(i["url"], {})
        if i["reviewed"]:
            store[i["url"]] = {"topic": i["topic"], "denominator_stated": i["denominator_stated"], "label_schema_version": None, "reviewed": True, "label_source": held.get("label_source") or i["label_source"] or "unattributed"}
        elif i["auto_labelled"] and held.get("label_source") not in ("human", "unattributed"):
            store[i["url"]] = {"topic": None, "denominator_stated": i["denominator_stated"], "label_schema_version": i["label_schema_version"], "reviewed": False, "label_source": "machine"}
    return store


def test_labels_one_by_one(spark, tmp_path):
    random.seed(3)
    sources = ["human", "machine", "unattributed", "deterministic", "", None]
    items = [{"at": n, "url": f"u{random.randrange(150)}", "topic": f"t{n}", "denominator_stated": random.choice("YN"), "label_schema_version": n, "reviewed": random.random() < 0.3, "auto_labelled": random.random() < 0.5, "label_source": random.choice(sources)} for n in range(700)]
    held = {f"u{n}": {"topic": f"old{n}", "denominator_stated": "Y", "label_schema_version": 1, "reviewed": True, "label_source": random.choice(sources)} for n in range(0, 160, 2)}
    want = one_by_one(items, held)
    df = spark.createDataFrame([tuple(i.values()) for i in items], "at int, url string, topic string, denominator_stated string, label_schema_version int, reviewed boolean, auto_labelled boolean, label_source string")
    old = spark.createDataFrame([(u, *r.values()) for u, r in held.items()], LABEL)
    as_dict = lambda rows: {r.url: {k: v for k, v in r.asDict().items() if k != "url"} for r in rows.collect()}
    assert as_dict(state.harvest(df, old, ["at"])) == want
    store = keyed_store.created(spark, f"{tmp_path}/l", ["url"], LABEL, buckets=8).merge(old, lambda o, n: n)
    # Two runs are as good as one.
    store = archive.keep_reviews(store, df.filter("at < 300"), ["at"])
    assert as_dict(archive.keep_reviews(store, df.filter("at >= 300"), ["at"]).rows()) == want


def test_history(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, n)
    df = lambda rows: spark.createDataFrame(rows, "date date, symbol string, price double, stale boolean")
    store = keyed_store.created(spark, f"{tmp_path}/h", ["date", "symbol"], archive.HISTORY, buckets=8)
    store = archive.keep_quotes(store, df([(day(n), "A", float(n), None) for n in range(1, 6)]), 4)
    assert sorted(r.date for r in store.rows().collect()) == [day(n) for n in (2, 3, 4, 5)]
    store = archive.keep_quotes(store, df([(day(5), "A", 50.0, False), (day(6), "A", 6.0, True), (day(7), "B", 7.0, False), (day(7), "B", 8.0, False), (day(1), "A", 1.0, False)]), 4)
    assert sorted((r.date, r.symbol, r.price) for r in store.rows().collect()) == [(day(3), "A", 3.0), (day(4), "A", 4.0), (day(5), "A", 50.0), (day(7), "B", 8.0)]


def evidence_of(texts):
    """What each article's evidence is, from all texts at once."""
    firsts = {}
    for url, said in texts.items():
        firsts[url] = {}
        for offset, sentence in said:
            firsts[url].setdefault(" ".join(sentence.split()).lower(), (offset, sentence))
    owners: dict = {}
    for url, keys in firsts.items():
        for k in keys:
            owners.setdefault(k, set()).add(url)
    return {u: ([v for k, v in keys.items() if len(owners[k]) == 1], sum(len(owners[k]) > 1 for k in keys)) for u, keys in firsts.items()}


def test_sentences_batch_by_batch(spark, tmp_path):
    random.seed(9)
    kind = "url string, content_hash string, spans array<struct<sentence:string,offset:int>>"
    view = sentence_view.created(spark, f"{tmp_path}/v", buckets=8)
    now: dict = {}
    digests: dict = {}
    for batch in range(4):
        gone = random.sample(sorted(now), min(len(now), 4 * batch // 2))
        new = {f"u{random.randrange(30)}": [(o, random.choice(["Same  line.", "same line."]) if random.random() < 0.3 else f"s {random.randrange(60)}") for o in range(random.randrange(6))] for _ in range(12)}
        rows = spark.createDataFrame([(u, f"c{batch}{u}" if u != "u3" else None, [(s, o) for o, s in said]) for u, said in new.items()], kind)
        untouched = {u: digests[u] for u in digests if u not in new and u not in gone}
        view = sentence_view.update(view, rows, spark.createDataFrame([(u,) for u in gone], "url string"))
        for u in gone:
            now.pop(u, None)
        now |= new
        got = {r.url: r for r in sentence_view.opened(spark, f"{tmp_path}/v").evidence().collect()}
        want = evidence_of(now)
        assert {u: ([(s.offset, s.sentence) for s in r.spans], r.dropped) for u, r in got.items()} == want
        assert all((r.evidence_hash is None) == (u == "u3") for u, r in got.items())
        # A digest changes with the evidence, also of articles that aren't in the batch, and only then.
        digests = {u: (r.evidence_hash, [tuple(s) for s in r.spans]) for u, r in got.items()}
        assert all((digests[u][0] == was[0]) == (digests[u][1] == was[1]) for u, was in untouched.items() if u != "u3")
    one = sentence_view.update(sentence_view.created(spark, f"{tmp_path}/w", buckets=8), spark.createDataFrame([(u, "c", [(s, o) for o, s in said]) for u, said in now.items()], kind))
    assert {r.url: (r.spans, r.dropped) for r in one.evidence().collect()} == {r.url: (r.spans, r.dropped) for r in view.evidence().collect()}


def test_sentence_update_is_run_again(spark, tmp_path, monkeypatch):
    kind = "url string, content_hash string, spans array<struct<sentence:string,offset:int>>"
    view = sentence_view.update(sentence_view.created(spark, f"{tmp_path}/v", buckets=4), spark.createDataFrame([("a", "c", [("one", 0), ("two", 4)]), ("b", "c", [("three", 0)])], kind))
    more = spark.createDataFrame([("c", "c", [("two", 0), ("three", 4)]), ("b", "d", [("four", 0)])], kind)
    whole = keyed_store.KeyedStore.merge

    def merge(self, new, combine):
        if self.keys == ("url",):
            raise RuntimeError("killed")
        return whole(self, new, combine)

    with monkeypatch.context() as m:
        m.setattr(keyed_store.KeyedStore, "merge", merge)
        with pytest.raises(RuntimeError, match="killed"):
            sentence_view.update(view, more)
    done = sentence_view.update(sentence_view.opened(spark, f"{tmp_path}/v"), more)
    assert {r.url: [s.sentence for s in r.spans] for r in done.evidence().collect()} == {"a": ["one"], "b": ["four"], "c": ["three"]}
