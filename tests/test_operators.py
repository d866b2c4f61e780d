"""Functions and operators that no SQL covers, against Python's own or brute force."""

import hashlib
import html
import html.entities
import re

import pytest
from pyspark.sql import functions as F

from claimgraph.functions import dates as D
from claimgraph.functions import html as H
from claimgraph.functions import text as T
from claimgraph.functions import urls as U
from claimgraph.operators import evaluate as E
from claimgraph.operators import evidence as E2
from claimgraph.operators import packing, reports
from claimgraph.operators import rules as L
from claimgraph.operators import state as S
from claimgraph.sources import adapters, readers, sinks
from claimgraph.sources import catalogues as C


def column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, x string")


def by_key(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("i").collect()]


def test_unescape(spark):
    cases = ["a &amp; b", "&#8217;&#x2019;&#X41;", "&amp;lt; &#38;lt; &amp;#38;", "&rsquo;&hellip;&euro; &mdash;", "plain", "", "&#; &#x; &# 12; tail &", "&#128512;&#65;x&#66;", None]
    assert by_key(column(spark, cases).select("i", T.unescape(F.col("x")).alias("y")), "y") == [(None if c is None else html.unescape(c),) for c in cases]
    # All names there are, with what follows them or not, and numbers that are odd.
    cases = [f"a&{n}b &{n.rstrip(';')} &{n.rstrip(';')}x;" for n in html.entities.html5] + ["&notit; &notin; &amp &AMP;; &ampamp; &a; &zz &; &;& &#38 &#x26g &<b &copy2"]
    cases += [f"&#{n}; &#x{n:x} &#0{n}" for n in [*range(170), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**12, 16**14]]
    assert by_key(column(spark, cases).select("i", T.unescape(F.col("x")).alias("y")), "y") == [(html.unescape(c),) for c in cases]


def split_by_hand(text):
    out, at = [], 0
    for line in text.split("\n"):
        begin = 0
        for m in [*re.finditer(r"(?<=[.!?])[ \t\r]+", line), None]:
            if m and re.search(rf"(?i)(?:^|[^A-Za-z0-9_]){T.ABBREVIATION}$", line[begin : m.start()]):
                continue
            piece = line[begin : m.start() if m else len(line)]
            if len(piece.strip()) >= 15:
                out.append((at + begin + len(piece) - len(piece.lstrip()), piece.strip()))
            begin = m.end() if m else begin
        at += len(line) + 1
    return out


def test_sentences(spark):
    cases = ["Dr. St. John met Mr. Brown in the U.S. today. They spoke for an hour!  Did they?  Yes, for a long while.", "First line of the text\n\n\nSecond line after blanks. Third one is here too.", "  Leading space here, e.g. this one. éCo. is no abbreviation? It may be.", "Ends with Inc.\nNext line begins here.", "", "x" * 5000, "One.  Two.\tThree and some more words.", None]
    got = column(spark, cases).select("i", T.sentence_spans(F.col("x")).alias("s"), T.sentences(F.col("x")).alias("t")).orderBy("i").collect()
    for text, row in zip(cases, got, strict=True):
        if text is None:
            assert row.s is None and row.t is None
            continue
        want = split_by_hand(text)
        assert [(r.s, r.sentence) for r in row.s] == want
        assert all(text[a : a + len(b)] == b for a, b in want)
        assert row.t == [b for _, b in want]


FIGURES = [
    ("In fiscal 2027, some 1,200, or 35 of them.", ["1,200", "35"]),
    ("On October 13 - 15 they paid $5 million under section 4.", ["$5 million"]),
    ("It rose 7\tpercent to $ 3bn and 5 million.", ["7\tpercent", "$ 3bn", "5 million"]),
    ("Claude 3 and GPT-4 are out", []),
    ("A note of 12 pages far away from all that is noise of any kind at all, see version 2", ["12"]),
    ("9 GW at 10.5% of 3 kWh", ["9 GW", "10.5%", "3 kWh"]),
    ("20 Million and 30 PER CENT", ["20 Million", "30 PER CENT"]),
    ("", []),
    (None, None),
]


def test_figures(spark):
    got = column(spark, [x for x, _ in FIGURES]).select("i", T.figure_spans(F.col("x")).alias("f")).orderBy("i").collect()
    assert [None if r.f is None else [x.figure for x in r.f] for r in got] == [want for _, want in FIGURES]
    for (text, _), r in zip(FIGURES, got, strict=True):
        assert all(text[x.s :].startswith(x.figure) for x in r.f or [])


FURNITURE = {
    "She has covered the tech industry for over 20 years.": True,
    "DOI: 10.1000/xyz": True,
    "See all comments (12)": True,
    "Mar 3rd 2024 | 5 min read": True,
    "Figure 3: The model": True,
    "Figure 3: Costs fell 20%": False,
    "3:05 PM EDT · March 5, 2024": True,
    "March 5, 2024, 3:05 PM EDT": True,
    "Updated Mon 4 March at 3:05pm today": True,
    "VIDEO 1:23 4:56": True,
    "At 3:05 PM they sold 20 of them.": False,
    "Subscribe to 3 letters": True,
}


def test_furniture(spark):
    got = column(spark, list(FURNITURE)).select("i", T.is_furniture(F.col("x")).alias("y"))
    assert [r[0] for r in by_key(got, "y")] == list(FURNITURE.values())


def test_evidence_text(spark):
    body = "x" * 420
    cases = [f"{body}\nRelated\ntail", f"{body}\n12 Comments\nyes", f"short\nRelated\n{body}", f"{body} \n3 comments\nA\nRelated\nB", None]
    want = [body, body, cases[2], body, None]
    rails = {"a.example": ("Related", "Most read")}
    assert [r[0] for r in by_key(column(spark, cases).select("i", T.evidence_text(F.col("x"), F.lit("a.example"), rails).alias("y")), "y")] == want
    assert by_key(column(spark, cases[:1]).select("i", T.evidence_text(F.col("x"), F.lit("b.example"), rails).alias("y")), "y") == [(cases[0],)]


DATES = {
    "Fri, 31 Jul 2026 10:00:00 GMT": "2026-07-31 10:00:00", "31 July 2026": "2026-07-31 00:00:00", "2026-07-31T10:00:00.123Z": "2026-07-31 10:00:00",
    "Sept 3, 2026": "2026-09-03 00:00:00", "2026-07-31 10:05": "2026-07-31 10:05:00", "Fri, 31 Jul 2026 10:00:00 -0500": "2026-07-31 15:00:00", "31 Jul 2026 10:00 EST": "2026-07-31 15:00:00",
    "2026-07-31T10:00:00+02:00": "2026-07-31 08:00:00", "2026-07": "2026-07-01 00:00:00", "2026": "2026-01-01 00:00:00", "Jul 2026": "2026-07-01 00:00:00", "March 5, 2026": "2026-03-05 00:00:00",
    "Tue, 19 May 2026": "2026-05-19 00:00:00", "soon": None, "31 Foo 2026": None, "2026-13-01": None, "": None,
}


def test_dates(spark):
    got = column(spark, list(DATES)).select("i", D.parse_date(F.col("x")).cast("string").alias("y"))
    assert dict(zip(DATES, [r[0] for r in by_key(got, "y")], strict=True)) == DATES
    fresh = {"2026-07-31 10:00 UTC": "2026-07-31T10:00:00Z", "2026-07-31 10:00": "2026-07-31T10:00:00Z", "2026-07-31T10:00:00+02:00": "2026-07-31T08:00:00Z", "2026-07-31": "2026-07-31T00:00:00Z|dateonly", "31 Jul 2026": None}
    assert [r[0] for r in by_key(column(spark, list(fresh)).select("i", D.freshness(F.col("x")).alias("y")), "y")] == list(fresh.values())


def test_verdicts(spark):
    cases = {"": "single", "a": "single", "a,a": "unanimous", "a,b": "split", "a,a,b": "majority", "a,a,b,c,d": "majority", "a,a,b,b": "tied", "a,a,b,b,c": "tied", "a,b,c": "split"}
    got = column(spark, list(cases)).select("i", L.verdict(F.filter(F.split("x", ","), lambda v: v != "")).alias("y"))
    assert [r[0] for r in by_key(got, "y")] == list(cases.values())


def test_revisit(spark):
    heads = {"A 40% of it": 3, "a $5 deal": 3, "US$5 and": 3, "5bn more": 3, "in 2031": 3, "by 1999": 3, "nothing 7": 0}
    got = column(spark, list(heads)).select("i", S.revisit_score(F.col("x"), F.lit("announced"), F.lit(3), F.lit(""), F.lit(False)).alias("y"))
    assert [r[0] for r in by_key(got, "y")] == list(heads.values())
    assert by_key(column(spark, ["by 2030"]).select("i", S.revisit_score(F.col("x"), F.lit("target"), F.lit(5), F.lit("t"), F.lit(True)).alias("y")), "y") == [(10,)]


def test_evaluator(spark):
    rows = column(spark, ["A binding rule. ", "Meeting notice of a rule", None, "broken", "silent"]).withColumn("summary", F.lit("5% more"))

    def answer(prompt):
        if "broken" in prompt:
            raise OSError("down")
        return "no json" if "silent" in prompt else '```json\n{"is_duty": true, "duty_type": "other", "priority": 1}\n```'

    noise = F.col("x").startswith("Meeting")
    native = E.evaluated(rows, "x", "summary", noise)
    assert by_key(native.select("i", "finding.*"), "is_duty", "priority", "quantity") == [(True, 2, True), (False, 5, False), (False, 4, True), (False, 4, True), (False, 4, True)]
    asked = E.evaluated(rows, "x", "summary", noise, answer, tries=2, wait=0.0)
    assert by_key(asked.select("i", "finding.*"), "duty_type", "priority") == [("other", 1), ("none", 5), ("other", 1), ("none", 4), ("none", 4)]
    assert asked.columns == native.columns
    assert E.evaluated(rows.filter("false"), "x", "summary", noise, answer).count() == 0


def test_retried():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 2:
            raise OSError("down")
        return "up"

    assert E.retried(flaky, 2, 0.0) == "up" and len(calls) == 2
    with pytest.raises(OSError):
        E.retried(lambda: (_ for _ in ()).throw(OSError()), 2, 0.0)


class Refused(Exception):
    def __init__(self, code):
        self.code = code


def test_articles(spark):
    def transport(url):
        if url.endswith("404"):
            raise Refused(404)
        if url.endswith("slow"):
            raise TimeoutError
        return ("application/pdf", b"%PDF") if url.endswith("pdf") else ("text/html; charset=iso-8859-1", b"caf\xe9" + b"x" * 5_000_000)

    urls = spark.createDataFrame([(f"https://{h}.example/{p}",) for h in "ab" for p in ("ok", "404", "slow", "pdf", "private")] + [(None,)], "url string")
    got = {r.url: (r.status, len(r.html), r.html[:4]) for r in adapters.articles(urls, transport, lambda u: "private" not in u, 0.0).collect()}
    assert len(got) == 10
    assert got["https://a.example/ok"] == ("ok", adapters.MOST_BYTES, "café")
    assert [got[f"https://b.example/{p}"][0] for p in ("404", "slow", "pdf", "private")] == ["http-404", "timeouterror", "not-html", "robots-disallowed"]


def test_quotes(spark):
    def first(symbol):
        if symbol != "A":
            raise Refused(429 if symbol == "B" else 500)
        return 1.5, None, "2024-01-02"

    def second(symbol):
        if symbol == "C":
            raise ValueError("empty")
        return 2.5, 0.1, "2024-01-03"

    df = spark.createDataFrame([("A",), ("A",), ("B",), ("C",), (None,)], "symbol string")
    got = {r.symbol: (r.value, r.provider, r.error) for r in adapters.quotes(df, first, second, 3, 0.0).collect()}
    assert got == {"A": (1.5, "primary", ""), "B": (2.5, "fallback", ""), "C": (None, None, "valueerror")}


def test_sinks(spark, tmp_path):
    alerts = spark.createDataFrame([("2024-01-02 10:00:00", 1, "s|t", "a\nb", None, "u", "one", True), ("2024-01-03 10:00:00", 9, "s", None, "Art. 5", None, "two", True), (None, 2, None, "c", None, None, "three", False)], "timestamp string, priority int, source string, summary string, reference string, url string, title string, is_duty boolean")
    lines = sinks.bulletin(alerts, "Bulletin").split("\n")
    assert lines[4:] == ["| 2024-01-03 10:00 | P5 | s |  | Art. 5 |", "| 2024-01-02 10:00 | P1 | s/t | a b | [Link](u) |", "|  | P2 |  | c | Primary |"]
    sent = []
    sinks.notifier(lambda *x: sent.append(x))(alerts, 0)
    assert sent == [("one", "s|t")]
    write = sinks.batch_writer(str(tmp_path / "out"))
    for number in (0, 1, 1):
        write(alerts, number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    section = sinks.nominations(alerts.select(F.col("title").alias("name"), F.lit("r|s").alias("reason")), "Due")
    want = ["## Due (3)", "", "- one: r/s", "- three: r/s", "- two: r/s"]
    assert [r.line for r in section.orderBy("place", "line").collect()] == want
    sinks.write_lines(section, f"{tmp_path}/due")
    assert [f.read_text().split("\n")[:-1] for f in tmp_path.glob("due/part-*")] == [want]


def test_packing(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 900 + 1) for i in range(500)] + [(500, 5000)], "id long, n long").repartition(5)
    batches = {}
    for r in packing.pack(rows, "id", "n", 8, 2000).collect():
        batches.setdefault(r.batch, []).append(r.n)
    assert sum(map(len, batches.values())) == 501
    assert all(len(x) <= 8 and (sum(x) <= 2000 or len(x) == 1) for x in batches.values())
    # Greedy: within a partition, a batch is closed only when the next row doesn't fit.
    assert len(batches) < 501 / 3


def test_urls(spark):
    urls = {"https://www.a.example:80/x": "a.example:80", "http://www.b.www.example": "b.example", "no url": "no url", None: ""}
    assert [r[0] for r in by_key(column(spark, list(urls)).select("i", U.domain(F.col("x")).alias("y")), "y")] == list(urls.values())
    same = {
        "https://www.youtube.com/watch?v=Ab1&t=9": "https://youtube.com/watch?v=Ab1", "https://youtu.be/Ab1": "https://youtube.com/watch?v=Ab1", "https://m.youtube.com/shorts/Ab1": "https://youtube.com/watch?v=Ab1",
        "https://user@WWW.a.example:8080/Path//?b=2&a=&utm_source=x&source=s#top": "https://a.example/Path?a=&b=2&source=s", " no scheme ": "no scheme", "http://a.example": "http://a.example/",
    }
    assert [r[0] for r in by_key(column(spark, list(same)).select("i", U.canonical_url(F.col("x")).alias("y")), "y")] == list(same.values())
    kinds = {"https://www.arxiv.org/abs/1": ("arXiv paper", "arXiv 1"), "https://doi.org/10.1/x": ("DOI record", "DOI 10.1/x"), "https://a.gov.uk/": ("official record", "a.gov.uk"), "https://a.example/" + "p" * 90: ("primary source", "a.example/" + "p" * 65 + "...")}
    assert by_key(column(spark, list(kinds)).select("i", H.primary_kind(F.col("x")).alias("k"), H.primary_label(F.col("x")).alias("l")), "k", "l") == list(kinds.values())


def test_entities(spark):
    names = {"Acme": True, "x": False, "": False, None: False, "researchers": False, "AI startups": False, "acme.example": False, "Acme Inc. of B": True, "N/A": False}
    assert [r[0] for r in by_key(column(spark, list(names)).select("i", E2.usable_entity(F.col("x")).alias("y")), "y")] == list(names.values())
    tags = [(["AI", "ab", "Exclusive", " Chip tariffs "], "Chip tariffs"), (["news"], ""), (None, "")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(tags)], "i int, x array<string>")
    assert [r[0] for r in by_key(df.select("i", E2.publisher_topic(F.col("x")).alias("y")), "y")] == [w for _, w in tags]
    spans = ["He said 5%", "It is 7%"]
    one = spark.createDataFrame([(0, spans)], "i int, x array<string>").select(E2.named_source_figures(F.col("x")).alias("y")).first().y
    assert (one.total, one.with_named_source) == (2, 1)
    assert [(r.basis, r.n) for r in E2.basis_histogram(spark.createDataFrame([("a (x)",), ("a (y)",), ("b",)], "s string"), "s").collect()] == [("a", 2), ("b", 1)]


def test_evidence_hash(spark):
    rows = spark.createDataFrame([(0, "c", [("a",), ("b",)]), (1, "c", [("a",)]), (2, "c", [("a",), ("b",)]), (3, "d", [("a",)])], "i int, c string, s array<struct<sentence:string>>")
    got = [r[0] for r in by_key(rows.select("i", T.evidence_hash(F.col("c"), F.col("s")).alias("h")), "h")]
    assert got[0] == got[2] and len(set(got)) == 3


def test_reports(spark):
    alerts = spark.createDataFrame([(1, True), (2, False), (2, True), (5, False)], "priority int, is_duty boolean")
    assert tuple(reports.urgent_counts(alerts).first()) == (4, 1, 2, 2)
    tiers = spark.createDataFrame([(0, [(3,), (1,)]), (1, []), (2, None)], "i int, s array<struct<source_tier:int>>").select("i", reports.tier_range(F.col("s")).alias("t")).select("i", "t.*")
    assert by_key(tiers, "min_tier", "max_tier") == [(1, 3), (None, None), (None, None)]
    named = spark.createDataFrame([(1, 2, "b", 4), (1, 1, "a", 4), (1, 3, "b", 2)], "item int, place int, name string, tier int")
    assert tuple(reports.ordered_sources(named, "item", "place").first()) == (1, ["a", "b"], [2, 4])
    assert sorted(r[0] for r in reports.symbols(spark.createDataFrame([("A",), ("",)], "symbol string"), spark.createDataFrame([("A",), ("B",)], "symbol string")).collect()) == ["A", "B"]
    assert reports.with_status(spark.createDataFrame([("x",), ("y",)], "status string"), "x").count() == 1
    shown = spark.range(1).select(reports.money(F.lit(1234.5)), reports.signed_percent(F.lit(1.2)), reports.signed_percent(F.lit(None).cast("double")), reports.clock_text(F.lit("2024-01-02T03 That")), C.lab_name(F.lit("some-lab"), {"x": "X"}), C.lab_name(F.lit("X"), {"x": "Ex"})).first()
    assert tuple(shown) == ("$1,234.50", "+1.20%", "", "2024-01-02 03 That", "Some Lab", "Ex")
    chips = spark.createDataFrame([("", True, "T", "", 1.0), ("A", False, None, None, None), ("A", True, None, "far", None), ("A", True, None, None, None), ("A", True, "T", None, None), ("A", True, "T", None, 1.0)], "e string, k boolean, t string, u string, q double")
    assert [r[0] for r in chips.select(reports.market_chip(*[F.col(c) for c in "ektuq"])).collect()] == ["", "", "listed, not covered here", "no listed security", "", "quote"]


def test_files(spark, tmp_path):
    (tmp_path / "x_monitor").mkdir()
    (tmp_path / "x_monitor" / "clauses.csv").write_text("a")
    (tmp_path / "x_monitor" / "other.csv").write_text("b")
    assert [tuple(r) for r in C.file_hashes(spark, str(tmp_path), ["clauses.csv"]).collect()] == [("x_monitor/clauses.csv", hashlib.sha256(b"a").hexdigest())]
    (tmp_path / "map.json").write_text('{"u1": {"a": 1},\n "u2": {"a": 2}}')
    assert sorted((r.key, r.value.a) for r in C.json_map(spark, str(tmp_path / "map.json"), "struct<a:int>").collect()) == [("u1", 1), ("u2", 2)]
    assert C.json_map(spark, str(tmp_path / "none.json"), "struct<a:int>").count() == 0
    assert {(r.key, r.value.tier) for r in C.registry(spark, '{"source_types": {"press": {"tier": 5}}}', "source_types", "struct<tier:int>").collect()} == {("press", 5)}
    assert readers.documents(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    sinks.append_lines(spark.range(2), str(tmp_path / "log"))
    sinks.append_lines(spark.range(1), str(tmp_path / "log"))
    assert readers.documents(spark, str(tmp_path / "log"), "id long").count() == 3
    news = "<rss><channel>" + "".join(f"<item><title>t{i}</title><link>l</link><pubDate>Fri, 31 Jul 2026 10:00:00 GMT</pubDate><source url='u'>S</source></item>" for i in range(5)) + "</channel></rss>"
    rows = column(spark, [news]).select(F.inline(C.category_news(F.col("x")))).collect()
    assert [(r.title, r.pub_date) for r in rows] == [(f"t{i}", "Fri, 31 Jul 2026") for i in range(3)]
    answers = spark.createDataFrame([("a-b", "[" + ",".join(f'{{"id": "a-b/m{i}", "createdAt": "2026-07-0{i + 1}T00:00:00Z"}}' for i in range(7)) + "]"), ("down", "<html>")], "org string, body string")
    got = C.org_releases(answers, F.lit("2026-07-04").cast("timestamp"), {}).collect()
    assert sorted((r.model or "", r.lab or "", r.error or "") for r in got) == [("", "", "no list"), *[(f"m{i}", "A B", "") for i in (3, 4, 5, 6)]]
