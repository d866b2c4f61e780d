"""Scopes, facets and mentions; titles and tiers are dealt to the documents, in forms that both engines build."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgraph.operators import rules as L
from claimgraph.operators import scope as S
from claimgraph.queries.common import query

#: Each stands for a case: words of either vocabulary, of both, of none, cut-off words, routine notices.
TITLES = [
    "New algorithms for the harbour", "Rainfall in May", "A.I in schools", "Said of paint and chairs", "Data centre planned", "Data center planned",
    "Deepfakes and the law", "Watermarking rules", "Deepfake rules", "A high-risk label", "Chips are down", "The microchip", "Automation at work",
    "Unified Agenda of Federal Regulatory Actions", "PURPLE HEART DAY for compute", "Airworthiness Directives; engines", "Airworthiness directive", "What energy costs",
]
TITLE_SQL = "[" + ", ".join(f"'{x}'" for x in TITLES) + f"][doc_id % {len(TITLES)} + 1]"
FIRST_LINE = "split_part(text, chr(10), 1)"


def titled(t):
    place = F.pmod("doc_id", F.lit(len(TITLES))).cast("int")
    return t("documents").withColumn("title", F.get(F.array(*map(F.lit, TITLES)), place))


FEED_SQL = f"regexp_matches({TITLE_SQL}, '(?i){S.FEED_SCOPE}')"


@query("q94_feed_scope", f"SELECT source, doc_id, CAST(r AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE NOT ends_with(source, '1') OR {FEED_SQL}) WHERE r <= 6")
def q94(t, spark):
    return S.scoped_top(titled(t), "source", "title", F.col("source").endswith("1"), ["doc_id"]).select("source", "doc_id", "rank")


NOTICE = f"{TITLE_SQL} || ' ' || coalesce({FIRST_LINE}, '')"


@query("q95_gazette_scope", f"SELECT doc_id, regexp_matches({NOTICE}, '(?i){S.GAZETTE_SCOPE}') AS in_scope, regexp_matches({NOTICE}, '(?i){'|'.join(S.ROUTINE)}') AS routine FROM documents")
def q95(t, spark):
    summary = F.split_part("text", F.lit("\n"), F.lit(1))
    return titled(t).select("doc_id", S.in_gazette_scope(F.col("title"), summary).alias("in_scope"), S.is_routine(F.col("title"), summary).alias("routine"))


BOARD = f"""SELECT doc_id, lower({TITLE_SQL}) AS search, CASE WHEN doc_id % 4 = 0 THEN [] WHEN doc_id % 4 = 1 THEN [lang] ELSE [lang, 'law'] END AS topics,
CASE WHEN doc_id % 5 = 0 THEN [] ELSE [doc_id % 5, 5] END AS tiers, doc_id % 3 = 0 AS conflict FROM documents"""


@query("q96_facets", f"""WITH b AS ({BOARD}), o AS (SELECT *, CASE WHEN len(topics) = 0 THEN [''] ELSE topics END AS own FROM b WHERE len(tiers) > 0)
SELECT 'all' AS facet, doc_id FROM o UNION ALL SELECT 'term', doc_id FROM o WHERE contains(search, 'rules') UNION ALL SELECT 'topic', doc_id FROM o WHERE list_has_any(own, ['', 'law'])
UNION ALL SELECT 'tier', doc_id FROM o WHERE list_has_any(tiers, [1, 2]) UNION ALL SELECT 'conflict', doc_id FROM o WHERE conflict AND list_has_any(own, ['en', 'de'])
UNION ALL SELECT 'labour', doc_id FROM o WHERE contains(search, 'cost')""")
def q96(t, spark):
    rest = lambda m, k: F.col("doc_id") % m == k
    topics = F.when(rest(4, 0), F.array().cast("array<string>")).when(rest(4, 1), F.array("lang")).otherwise(F.array("lang", F.lit("law")))
    tiers = F.when(rest(5, 0), F.array().cast("array<int>")).otherwise(F.array((F.col("doc_id") % 5).cast("int"), F.lit(5)))
    board = titled(t).select("doc_id", F.col("title").alias("search"), topics.alias("topics"), tiers.alias("tiers"), rest(3, 0).alias("conflict"))
    shown = {
        "all": S.chip(board, "all", topics=["law"]), "term": S.faceted(board, " Rules "), "topic": S.faceted(board, topics=["", "law"]), "tier": S.faceted(board, tiers=[1, 2]),
        "conflict": S.faceted(board, topics=["en", "de"], conflicts_only=True), "labour": S.chip(board, "labour"),
    }
    first, *others = [df.select(F.lit(name).alias("facet"), "doc_id") for name, df in shown.items()]
    for df in others:
        first = first.unionByName(df)
    return first


REGISTRY = {"Theo": ["the"], "Ander": ["and the", "and"], "Derrick": ["der"], "Quentin": ["que"], "Lasse": ["las", "los"], "Unda": ["und"], "Ofner": ["of"], "Inga": ["in"]}
#: The host of a document: its first word, so that some publish themselves.
HOST_SQL = "lower(split_part(text, ' ', 1)) || '.example'"
#: Separators twice, so that a word between two others shares none.
DOUBLED = r"'  ' || regexp_replace(lower(left(text, 20000)), '([^\pL\pN_])', '\1\1', 'g') || '  '"


def times_sql(form: str) -> str:
    return rf"len(regexp_extract_all(x, '[^\pL\pN_]{form.replace(' ', '  ')}[^\pL\pN_]'))"


def name_sql(place: int, name: str, forms: list[str]) -> str:
    own = " OR ".join(f"contains(host, '{f.replace(' ', '')}')" for f in forms)
    return f"SELECT doc_id, {place} AS place, '{name}' AS name, {' + '.join(map(times_sql, forms))} AS n FROM d WHERE NOT ({own})"


@query("q97_mentions", f"WITH d AS (SELECT doc_id, {HOST_SQL} AS host, {DOUBLED} AS x FROM documents), f AS (" + " UNION ALL ".join(name_sql(i, name, forms) for i, (name, forms) in enumerate(REGISTRY.items())) + ") SELECT doc_id, name, CAST(n AS BIGINT) AS n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS r FROM f WHERE n > 0) WHERE r <= 6")
def q97(t, spark):
    host = F.concat(F.lower(F.split_part("text", F.lit(" "), F.lit(1))), F.lit(".example"))
    return t("documents").select("doc_id", F.posexplode(L.mentions(F.col("text"), host, REGISTRY))).select("doc_id", "col.name", F.col("col.count").alias("n"), (F.col("pos") + 1).alias("rank"))
