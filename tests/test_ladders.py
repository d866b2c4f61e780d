"""Topics with exclusions and grounds, reviews harvested and carried in one run, and the ladder of page dates."""

from pyspark.sql import functions as F

from claimgraph.functions import dates as D
from claimgraph.operators import rules as L
from claimgraph.operators import state

REGISTRY = [
    {"topic": "chips", "rules": [{"phrase": "chip", "score": 2}, {"regex": r"\bGPU-?[0-9]", "score": 1}], "exclude": ["fish and chip"], "headline_exclude": ["casino"], "anchors": [{"kind": "k"}], "anchor_min_score": 3},
    {"topic": "power", "rules": [{"phrase": "reactor", "score": 2}], "topic_min_score": 2, "anchors": [{"kind": "k"}], "anchor_min_score": 3},
    {"topic": "never", "rules": [{"phrase": "moon", "score": 9}], "anchors": [{"kind": "k"}]},
]
TOPICS = [
    ("New Chips out", [], [], {"chips": 4}, "chips"),
    ("Plain", [], ["a chip", "GPU-45 and chips", "a chip"], {}, None),  # sentences alone
    ("Plain", ["chip"], ["a chip", "a chip"], {"chips": 4}, None),  # a tag makes a topic but no anchor
    ("Fish and chips", ["fish and chip shops"], ["a gpu7"], {}, None),
    ("Fish and chips", ["chip"], ["fish and chips"], {"chips": 2}, None),
    ("Casino chip", ["chip"], [], {}, None),
    ("Chip and reactor", [], [], {"chips": 4, "power": 4}, None),  # a tie
    ("Chip and reactor", [], ["reactors"], {"chips": 4, "power": 6}, "power"),
    ("Moon", [], [], {"never": 18}, None),
    ("Chipset microchip", None, None, {}, None),
    (None, ["chip"], [None], {"chips": 2}, None),
]


def test_topics(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(TOPICS)], "i int, head string, tags array<string>, said array<string>")
    found = L.topic_candidates(df, "i", F.col("head"), F.col("tags"), F.col("said"), REGISTRY)
    got = [{} for _ in TOPICS]
    for r in found.collect():
        got[r.i][r.topic] = r.score
    assert got == [r[3] for r in TOPICS]
    assert {r.i: r.topic for r in L.topic_anchors(found, "i").collect()} == {i: r[4] for i, r in enumerate(TOPICS) if r[4]}


FIELDS = "entity string, topic string, denominator_stated string, auto_labelled boolean, label_schema_version int, content_hash string, evidence_hash string, reviewed boolean, label_source string"
BLANK = {"entity": None, "topic": None, "denominator_stated": None, "auto_labelled": None, "label_schema_version": None, "content_hash": None, "evidence_hash": None, "reviewed": None, "label_source": None}
AUTO = {"auto_labelled": True, "label_schema_version": 2, "content_hash": "c", "evidence_hash": "e", "denominator_stated": "N"}


def test_reviews(spark):
    items, store = [], []
    item = lambda at, url, **kw: items.append((at, url, *(BLANK | kw).values(), None))
    held = lambda url, **kw: store.append((url, *(BLANK | kw).values()))
    item(1, "new", reviewed=True, entity="A", label_source="machine", label_schema_version=9)
    item(2, "new")  # sees the harvest of the same run
    item(3, "bare", reviewed=True, topic="t")
    item(4, "prior", reviewed=True, topic="t", label_source="machine")
    item(5, "auto", **AUTO)
    item(6, "auto")
    item(7, "kept", **AUTO)  # doesn't outrank the hand-set label
    item(8, "again", **AUTO)
    item(9, "gone", **AUTO | {"content_hash": "old"})
    item(10, "rule")
    item(11, "", reviewed=True)
    item(12, "twice", reviewed=True, topic="first")
    item(13, "twice", **AUTO)
    item(14, None)
    held("prior", label_source="human", reviewed=True, entity="old")
    held("kept", label_source="unattributed", reviewed=True, denominator_stated="Y")
    held("again", label_source="machine", reviewed=False, denominator_stated="Y", entity="x")
    held("rule", label_source="deterministic", reviewed=False, denominator_stated="Y", label_schema_version=2, content_hash="c", evidence_hash="e")
    held("idle", label_source="human", reviewed=True, entity="z")
    hashes = [(u, "c", "e") for u in ("auto", "kept", "again", "gone", "rule", "new")]
    after, carried = state.carry_reviews(spark.createDataFrame(items, f"at int, url string, {FIELDS}, review_stale boolean"), spark.createDataFrame(store, f"url string, {FIELDS}"), spark.createDataFrame(hashes, "url string, content_hash string, evidence_hash string"), 2, ["at"])
    got = {r.url: (r.label_source, r.reviewed, r.entity, r.topic, r.denominator_stated, r.label_schema_version) for r in after.collect()}
    assert got == {
        "new": ("machine", True, "A", None, None, None),
        "bare": ("unattributed", True, None, "t", None, None),
        "prior": ("human", True, None, "t", None, None),
        "auto": ("machine", False, None, None, "N", 2),
        "kept": ("unattributed", True, None, None, "Y", None),
        "again": ("machine", False, None, None, "N", 2),
        "gone": ("machine", False, None, None, "N", 2),
        "rule": ("deterministic", False, None, None, "Y", 2),
        "idle": ("human", True, "z", None, None, None),
        "twice": ("unattributed", True, None, "first", None, None),
    }
    rows = {r.at: (r.denominator_stated, r.topic, r.reviewed, r.label_source, r.review_stale) for r in carried.collect()}
    assert len(rows) == 14
    assert rows[2] == (None, None, None, None, True)  # a machine's label without a schema is stale
    assert rows[6] == ("N", None, False, "machine", None)
    assert rows[7] == ("Y", None, True, "unattributed", None)
    assert rows[9] == ("N", None, None, None, True)
    assert rows[10] == ("Y", None, False, "deterministic", None)
    assert rows[13] == ("N", "first", True, "unattributed", None)
    assert rows[14] == (None, None, None, None, None)


def test_page_dates(spark):
    far = "x" * 1900
    cases = [
        ('{"datePublished": "2024-03-05T23:30:00-05:00", "dateModified": "2025-01-01"} <meta name="publishdate" content="2020-01-01">', "2024-03-05"),
        ('{"datePublished": "soon"}<meta content="March 5, 2024" property="article:published_time">', "2024-03-05"),
        ('<meta name="date" content="2020-01-01"><meta itemprop="datePublished" content="nope"><meta itemprop="datePublished" content="2021-02-03">', "2021-02-03"),
        ('<meta property="" name="PublishDate" data-content="x" content="20240229">', "2024-02-29"),
        ("Mar 9, 2019 é\U0001f600 and <h1>Title</h1> then Apr 2, 2020", "2019-03-09"),
        ("May 1, 2020<h1>ab</h1>  May 2, 2020", "2020-05-01"),
        ("December 1, 2020<h1>", "2020-12-01"),
        ("12345678901<H1 x>4567 Jan 2, 2021", "2021-01-02"),
        ("Jan 12, 2020 <h1> xxxxxxx Feb 12, 2020", "2020-01-12"),
        (f"Jan 1, 2020 {far}<h1>{far} Feb 1, 2020", None),
        ("January 1, 2020, no heading", None),
        ("<h1> February 30, 2020", None),
        ("2024", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, html string").select("i", D.page_date(F.col("html")).cast("string").alias("d"))
    assert [r.d for r in df.orderBy("i").collect()] == [c[1] for c in cases]
    urls = {"https://a.example/2024/03/05/x": "2024-03-05", "https://a.example/2024/mar/5": "2024-03-05", "https://a.example/2024/March/05/": "2024-03-05", "https://a.example/2024/Foo/05/": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.d for r in df.select("u", D.date_in_url(F.col("u")).cast("string").alias("d")).collect()} == urls
