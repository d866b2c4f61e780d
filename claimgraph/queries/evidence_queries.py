"""Evidence, resolution, topics, catalogues and reports; pages, feeds and files are told from the tables, in forms that both engines build."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgraph.functions import html as H
from claimgraph.functions import text as T
from claimgraph.functions import urls as U
from claimgraph.operators import evidence as E
from claimgraph.operators import reports
from claimgraph.operators import rules as L
from claimgraph.queries.common import query
from claimgraph.queries.text_queries import SENTENCES_SQL
from claimgraph.sources import catalogues as C
from claimgraph.sources import sinks

TOPICS = [
    {"topic": "motion", "rules": [{"phrase": "tion", "score": 1}, {"phrase": "ing", "score": 2}], "topic_min_score": 3, "exclude": ["worthless"], "anchors": [{}], "anchor_min_score": 5},
    {"topic": "ties", "rules": [{"phrase": "the", "score": 1}, {"phrase": "with", "score": 2}], "topic_min_score": 3, "headline_exclude": ["for"], "anchors": [{}], "anchor_min_score": 5},
    {"topic": "nord", "rules": [{"phrase": "und", "score": 2}, {"phrase": "der", "score": 1}], "topic_min_score": 3, "anchors": [{}], "anchor_min_score": 6},
    {"topic": "source", "rules": [{"phrase": "src1", "score": 3}], "topic_min_score": 3},
]


def topics_sql() -> str:
    has = lambda x, p: f"regexp_matches(lower({x}), '(^|[^a-z0-9]){p}(s|es)?($|[^a-z0-9])')"
    parts = []
    for t in TOPICS:
        off = "".join(f" AND NOT {has('x', p)}" for p in t.get("exclude", []))
        head = "".join(f" AND NOT {has('h', p)}" for p in t.get("headline_exclude", []))
        for i, r in enumerate(t["rules"]):
            parts.append(f"SELECT DISTINCT doc_id, '{t['topic']}' AS topic, {i} AS rule, cls, {r['score']} * CASE cls WHEN 'headline' THEN 2 ELSE 1 END AS s, {t['topic_min_score']} AS least, {t.get('anchor_min_score', 'NULL')} AS anchor FROM x WHERE {has('x', r['phrase'])}{off}{head}")
    return f"""WITH x AS (SELECT doc_id, split_part(text, chr(10), 1) AS h, 'headline' AS cls, split_part(text, chr(10), 1) AS x FROM documents UNION ALL SELECT doc_id, split_part(text, chr(10), 1), 'tag', source FROM documents
UNION ALL SELECT doc_id, split_part(text, chr(10), 1), 'sentence', unnest(string_split(text, chr(10))) FROM documents), r AS ({' UNION ALL '.join(parts)})
SELECT doc_id, topic, CAST(sum(s) AS BIGINT) AS score, bool_or(cls = 'headline') AS on_headline, coalesce(sum(s) >= max(anchor), false) AND bool_or(cls = 'headline') AS can_anchor FROM r GROUP BY doc_id, topic HAVING sum(s) >= max(least) AND bool_or(cls <> 'sentence')"""


def candidates(t):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return L.topic_candidates(t("documents"), "doc_id", first, F.array("source"), F.split("text", "\n"), TOPICS)


@query("q74_topic_candidates", topics_sql())
def q74(t, spark):
    return candidates(t)


@query("q75_topic_anchors", f"WITH c AS ({topics_sql()}), r AS (SELECT doc_id, topic, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS r, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS nxt FROM c WHERE can_anchor) SELECT doc_id, topic, score FROM r WHERE r = 1 AND (nxt IS NULL OR score > nxt)")
def q75(t, spark):
    return L.topic_anchors(candidates(t), "doc_id")


ALIASES = {"Ander Group": ["the"]}


@query("q76_attribution", rf"""WITH s AS (SELECT doc_id, doc_id % 3 = 0 AS known, unnest({SENTENCES_SQL}) AS s FROM (SELECT doc_id, replace(replace(text, ' and ', ' said '), ' for ', ' sources ') AS text FROM documents)),
k AS (SELECT doc_id, CASE WHEN regexp_matches(s, '(?i)\bsources\b|\breports?\b|\bsomeone\b') AND NOT (known AND (contains(s, 'Ander') OR contains(s, 'the'))) THEN 'unnamed' WHEN known AND (contains(s, 'Ander') OR contains(s, 'the')) THEN 'to_subject' ELSE 'to_others' END AS k FROM s WHERE length(s) >= 30 AND regexp_matches(s, '(?i)\b(said|says|told|wrote|added|noted)\b'))
SELECT d.doc_id, count(*) FILTER (k = 'to_subject') AS to_subject, count(*) FILTER (k = 'to_others') AS to_others, count(*) FILTER (k = 'unnamed') AS unnamed FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def q76(t, spark):
    told = F.replace(F.replace("text", F.lit(" and "), F.lit(" said ")), F.lit(" for "), F.lit(" sources "))
    forms = E.aliases(F.when(F.col("doc_id") % 3 == 0, "Ander Group"), ALIASES)
    a = E.attribution(T.sentences(told), forms)
    size = lambda k: F.size(F.col("a")[k]).cast("long").alias(k)
    return t("documents").select("doc_id", a.alias("a")).select("doc_id", size("to_subject"), size("to_others"), size("unnamed"))


#: A page of each part: tags in several places, links of several kinds.
PAGE = """concat('<html><head><meta property="og:title" content="', p_name, ' | Paper"><meta property="og:site_name" content="Site ', CAST(p_size AS {s}), '"><meta name="keywords" content="', p_brand, ', news, ', upper(p_type), '"><script type="application/ld+json">{{"about": {{"name": "no list"}}, "@graph": [{{"keywords": [], "about": "no list"}}, [[{{"@graph": {{"@graph": [{{"keywords": "', p_type, ',", "about": [{{"name": "', p_brand, '"}}, "text"]}}]}}}}]]]}}</script></head><body><article>', repeat('word ', 90),
 '<a href="https://arxiv.org/abs/', CAST(p_partkey AS {s}), '">x</a><a href="//www.brand', CAST(p_size AS {s}), '.example/a">y</a><a href="/own">z</a><a href="https://www.site.example/b">w</a><nav><a href="https://gone.example/">n</a></nav><a href="https://arxiv.org/abs/', CAST(p_partkey AS {s}), '">again</a></article><a href="https://outside.example/">o</a></body></html>')"""


@query("q77_page_tags", "SELECT p_partkey, p_name AS title, 'Site ' || p_size AS site, p_type || '|' || p_brand || '|news' AS tags FROM part")
def q77(t, spark):
    page = F.expr(PAGE.format(s="STRING"))
    return t("part").select("p_partkey", page.alias("h")).select("p_partkey", H.page_title(F.col("h"), ["Paper"]).alias("title"), H.site_name(F.col("h")).alias("site"), F.array_join(H.publisher_tags(F.col("h")), "|").alias("tags"))


@query("q78_link_kinds", "SELECT p_partkey, 'https://arxiv.org/abs/' || p_partkey AS primary_link, 'arXiv ' || p_partkey AS label, CASE WHEN p_size = 7 THEN 1 ELSE 0 END AS own, CASE WHEN p_size = 7 THEN 0 ELSE 1 END AS other FROM part")
def q78(t, spark):
    # Dealt anew, since a page costs many times what its part takes in the file.
    page = t("part").repartition("p_partkey").select("p_partkey", F.expr(PAGE.format(s="STRING")).alias("h"))
    links = page.select("p_partkey", H.outbound(F.col("h"), F.lit("https://site.example/post")).alias("l"), T.region_scope(F.col("h")).alias("scope"))
    kinds = links.select("p_partkey", E.link_kinds(F.col("l"), F.col("scope"), F.lit("Seven"), ["arxiv.org", "doi.org"], {"Seven": ["brand7.example"]}).alias("k"))
    first = F.get("k.primary", F.lit(0))
    return kinds.select("p_partkey", first.alias("primary_link"), H.primary_label(first).alias("label"), F.size("k.subject_own").alias("own"), F.size("k.other").alias("other"))


ORGS = {"Brushed Works": ["brushed"], "Plated Group": ["plated", "anodized"], "Eleven": ["Brand#11"], "Twelve": ["Brand#12"]}


@query("q79_resolved_entity", r"""WITH p AS (SELECT p_partkey, lower(p_type) AS h, p_brand, p_size, nullif(strpos(lower(p_type), 'brushed'), 0) AS a, nullif(least(nullif(strpos(lower(p_type), 'plated'), 0), nullif(strpos(lower(p_type), 'anodized'), 0)), 0) AS b FROM part)
SELECT p_partkey, CASE WHEN a IS NOT NULL AND (b IS NULL OR a < b) THEN 'Brushed Works' WHEN b IS NOT NULL THEN 'Plated Group' WHEN regexp_matches(h, '(^|[^a-z0-9_])copper($|[^a-z0-9_])') THEN 'Mine' WHEN p_size % 2 = 0 AND p_brand IN ('Brand#11', 'Brand#12') THEN '' WHEN p_brand = 'Brand#11' THEN 'Eleven' WHEN p_brand = 'Brand#12' OR p_size % 2 = 0 THEN 'Twelve' WHEN p_size > 20 THEN 'Site' ELSE '' END AS entity,
CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'headline' WHEN regexp_matches(h, '(^|[^a-z0-9_])copper($|[^a-z0-9_])') THEN 'product:copper' WHEN p_size % 2 = 0 AND p_brand = 'Brand#11' THEN 'tags-name-2-orgs' WHEN p_brand IN ('Brand#11', 'Brand#12') OR p_size % 2 = 0 THEN 'tag' WHEN p_size > 20 THEN 'site' ELSE 'unresolved' END AS basis FROM p""".replace("WHEN p_size % 2 = 0 AND p_brand IN ('Brand#11', 'Brand#12') THEN ''", "WHEN p_size % 2 = 0 AND p_brand = 'Brand#11' THEN ''"))
def q79(t, spark):
    tags = F.array(F.lit("news"), F.lower("p_brand"), F.when(F.col("p_size") % 2 == 0, "brand#12").otherwise("law"))
    host = F.when(F.col("p_size") > 20, "blog.site.example").otherwise("other.example")
    return t("part").select("p_partkey", E.resolved(F.col("p_type"), tags, host, ORGS, {"copper": "Mine"}, {"site.example": "Site"}).alias("r")).select("p_partkey", "r.entity", "r.basis")


@query("q80_corpus_report", """WITH e AS (SELECT o_orderkey % 5 <> 0 AS f, o_orderkey % 3 <> 0 AS u, o_orderkey % 4 AS s, o_orderkey % 2 AS o, o_orderkey % 7 % 2 AS n, o_orderkey % 6 % 3 AS p, o_orderkey % 8 % 2 AS w, o_orderkey % 9 AS g, least(o_orderkey % 9, o_orderkey % 4) AS q, o_orderkey % 10 % 4 AS c FROM orders)
SELECT count(*) AS items, count(*) FILTER (f) AS fetched, count(*) FILTER (f AND u) AS usable, count(*) FILTER (f AND u AND s > 0 AND o = 0) AS only_subject, count(*) FILTER (f AND s + o + n = 0) AS unattributed, count(*) FILTER (f AND n > 0) AS with_unnamed, count(*) FILTER (f AND p > 0) AS with_primary, count(*) FILTER (f AND w > 0) AS with_own,
CAST(sum(g) FILTER (f) AS BIGINT) AS figures, CAST(sum(q) FILTER (f) AS BIGINT) AS sourced_figures, count(*) FILTER (f AND c > 0) AS in_chain FROM e""")
def q80(t, spark):
    k = F.col("o_orderkey")
    rows = t("orders").select((k % 5 != 0).alias("fetched"), (k % 3 != 0).alias("entity_usable"), (k % 4).alias("to_subject"), (k % 2).alias("to_others"), (k % 7 % 2).alias("unnamed"), (k % 6 % 3).alias("primary"), (k % 8 % 2).alias("subject_own"), (k % 9).alias("figures"), F.least(k % 9, k % 4).alias("sourced_figures"), (k % 10 % 4).alias("cites"), F.lit(0).alias("cited_by"))
    return E.corpus_report(rows)


@query("q81_story_chains", """WITH p AS (SELECT page_id, 'https://a.example/' || page_id % 90 AS u, 'https://a.example/' || (page_id * 7) % 120 AS l1, 'https://a.example/' || page_id % 90 AS l2, page_id % 4 <> 0 AS article FROM pages)
SELECT DISTINCT u AS citing, l AS cited FROM (SELECT u, unnest([l1, l2]) AS l FROM p WHERE article) WHERE u <> l AND l IN (SELECT u FROM p)""")
def q81(t, spark):
    at = lambda n: F.concat(F.lit("https://a.example/"), n.cast("string"))
    i = F.col("page_id")
    own = U.canonical_url(F.concat(F.lit("HTTPS://www.a.example:443/"), (i % 90).cast("string"), F.lit("/?utm_source=x")))
    links = F.transform(F.array(F.concat(at(i * 7 % 120), F.lit("#top")), at(i % 90)), U.canonical_url)
    return E.story_chains(t("pages").select(own.alias("u"), links.alias("l"), F.when(i % 4 != 0, "article").otherwise("document").alias("s")), "u", "l", "s")


@query("q82_sitemap_posts", "SELECT vendor, url, max(lastmod) AS lastmod FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'A' ELSE 'B' END AS vendor, 'https://v.example/news/' || page_id % 40 AS url, CAST(2000 + page_id % 25 AS VARCHAR) || '-01-02' AS lastmod FROM pages) GROUP BY vendor, url")
def q82(t, spark):
    i = F.col("page_id")
    entry = lambda path: F.concat(F.lit("<url><loc>https://v.example"), F.lit(path), (i % 40).cast("string"), F.lit("</loc>\n <lastmod>"), (2000 + i % 25).cast("string"), F.lit("-01-02</lastmod></url>"))
    maps = t("pages").select(F.when(i % 2 == 0, "A").otherwise("B").alias("vendor"), C.sitemap_posts(F.concat(entry("/news/"), entry("/jobs/")), "/news/").alias("posts"))
    return C.merged_posts(maps, "vendor", "posts")


@query("q83_papers_datasets", """SELECT p_partkey, 'paper' AS kind, p_name AS title, 'https://x.example/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN 'A' || p_size || ', B, C et al.' ELSE 'A' || p_size || ', B' END AS authors, '2024-01-02' AS day FROM part
UNION ALL SELECT p_partkey, 'dataset', 'own' || p_size || '/' || p_partkey, 'https://d.example/own' || p_size || '/' || p_partkey, 'own' || p_size, '2024-05-06' FROM part""")
def q83(t, spark):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    name = lambda x: F.concat(F.lit("<author><name>"), x if not isinstance(x, str) else F.lit(x), F.lit("</name></author>"))
    xml = F.concat(F.lit("<feed><entry><title> "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit("</title><link href='https://pdf.example' rel='related'/><link href='https://x.example/"), k, F.lit("' rel='alternate'/><published>2024-01-02T03:04:05Z</published>"), name(F.concat(F.lit("A"), size)), name("B"), F.when(F.col("p_size") % 2 == 0, F.concat(name("C"), name("D"))).otherwise(""), F.lit("</entry></feed>"))
    text = F.concat(F.lit('[{"id": "own'), size, F.lit("/"), k, F.lit('", "lastModified": "2024-05-06T01:02:03Z"}]'))
    both = t("part").select("p_partkey", F.concat(C.papers(xml), C.datasets(text, "https://d.example/", "D")).alias("x"))
    return both.select("p_partkey", F.inline("x")).select("p_partkey", "kind", "title", "url", "authors", F.col("date").alias("day"))


@query("q84_releases", """WITH m AS (SELECT o_orderkey AS k, 'lab-' || o_custkey % 7 || '/m' || o_orderkey % 50 AS base, CASE o_orderkey % 3 WHEN 0 THEN ':free' WHEN 1 THEN '' ELSE ':nitro' END AS v, epoch(o_orderdate)::BIGINT AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'Org/M' || o_orderkey % 50 ELSE '' END AS hf FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderdate >= DATE '1994-01-01'),
b AS (SELECT base, min(c) AS c, arg_min(hf, c * 100000000 + k) AS hf FROM m GROUP BY base), o AS (SELECT DISTINCT 'org/m' || (o_orderkey % 60) AS hf FROM orders)
SELECT base AS id, 'Lab ' || substr(base, 5, 1) AS lab, CAST(CAST(to_timestamp(c) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, CASE WHEN hf <> '' THEN 'open-weights' ELSE 'closed' END AS evidence FROM b
UNION ALL SELECT hf, 'Org', '2000-01-01', 'open-weights' FROM o WHERE hf NOT IN (SELECT lower(hf) FROM b WHERE hf <> '')""")
def q84(t, spark):
    k = F.col("o_orderkey")
    base = F.concat(F.lit("lab-"), (F.col("o_custkey") % 7).cast("string"), F.lit("/m"), (k % 50).cast("string"))
    ident = F.when(k % 11 == 0, F.concat(F.lit("~"), base)).when(k % 13 == 0, F.concat(F.lit("auto/"), base)).otherwise(F.concat(base, F.when(k % 3 == 0, ":free").when(k % 3 == 1, "").otherwise(":nitro")))
    # Ties of one time go by the order's key here, as in the SQL: it is put in front of the id that breaks them.
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    models = t("orders").select(ident.alias("id"), F.lit(None).cast("string").alias("name"), at.alias("created"), F.when(k % 2 == 0, F.concat(F.lit("Org/M"), (k % 50).cast("string"))).alias("hugging_face_id"), F.lit(1).alias("context_length"))
    first = C.catalogue_releases(models, F.lit("1994-01-01").cast("timestamp"), {})
    second = t("orders").select(F.concat(F.lit("org/m"), (k % 60).cast("string")).alias("hf_id")).distinct().select("hf_id", F.col("hf_id").alias("id"), F.lit("Org").alias("lab"), F.lit("2000-01-01").cast("date").alias("day"), F.lit("open-weights").alias("evidence"))
    return C.merged_releases(first, second).select("id", "lab", F.col("day").cast("string").alias("day"), "evidence")


@query("q85_gazettes_trends", """SELECT page_id, 'rss' AS kind, 'T' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'S' || page_id ELSE 'T' || page_id END AS told FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'register', 'R' || page_id, CASE WHEN page_id % 2 = 0 THEN 'abstract' ELSE 'R' || page_id END FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'trend', 'q' || page_id, (page_id % 9) || '00+ n' || page_id FROM pages WHERE page_id % 3 = 2""")
def q85(t, spark):
    i, n = F.col("page_id"), F.col("page_id").cast("string")
    rss = F.concat(F.lit("<rss><channel><item><title>T"), n, F.lit("</title><link>l</link>"), F.when(i % 2 == 0, F.concat(F.lit("<description>S"), n, F.lit("</description>"))).otherwise(""), F.lit("</item></channel></rss>"))
    register = F.concat(F.lit('{"results": [{"title": "R'), n, F.lit('", "html_url": "u", "abstract": "'), F.when(i % 2 == 0, "abstract").otherwise(""), F.lit('"}]}'))
    trend = F.concat(F.lit("<rss xmlns:ht='https://t.example'><channel><item><title>q"), n, F.lit("</title><ht:approx_traffic>"), (i % 9).cast("string"), F.lit("00+</ht:approx_traffic><ht:news_item><ht:news_item_title>n"), n, F.lit("</ht:news_item_title></ht:news_item><ht:news_item><ht:news_item_title/></ht:news_item></item></channel></rss>"))
    shape = lambda xs, kind, told: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x["query" if kind == "trend" else "title"].alias("title"), told(x).alias("told")))
    rows = F.when(i % 3 == 0, shape(C.gazette_items(rss), "rss", lambda x: x["summary"])).when(i % 3 == 1, shape(C.register_items(register), "register", lambda x: x["summary"])).otherwise(shape(C.trends(trend), "trend", lambda x: F.concat_ws(" ", x["traffic"], F.array_join(F.transform(x["news"], lambda y: y["title"]), ","))))
    return t("pages").select("page_id", F.inline(rows))


@query("q86_ratings_caches", """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'blocked' WHEN n_nationkey % 3 = 1 THEN 'caution' ELSE 'trusted' END AS class, lower(n_name) AS pattern, 'note ' || n_regionkey AS note, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'T ' || n_name END AS title, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '2024-01-02' END AS published FROM nation""")
def q86(t, spark):
    k = F.col("n_nationkey")
    head = F.when(k % 3 == 0, "## Blocked for good").when(k % 3 == 1, "## CAUTION").otherwise("## trusted")
    file = F.concat(F.lit("- before any heading :: x\n"), head, F.lit("\n- "), "n_name", F.lit(" ::  note "), F.col("n_regionkey").cast("string"), F.lit("\n- <none>\ntext\n-  :: y"))
    cache = F.concat(F.lit('{"_purpose": "p", "https://c.example/": '), F.when(k % 2 == 0, F.concat(F.lit('"'), "n_name", F.lit('"'))).otherwise(F.concat(F.lit('{"title": "T '), "n_name", F.lit('", "published": "2024-01-02"}'))), F.lit(', "https://d.example/": 7}'))
    rows = t("nation").select(k, F.inline(C.ratings_file(file)), cache.alias("cache"))
    return rows.select("n_nationkey", "class", "pattern", "note", F.inline(C.title_cache(F.col("cache")))).drop("url")


@query("q87_model_scores", """WITH j AS (SELECT doc_id, quality = 1 AS a, toxic = 1 AS b, CASE WHEN doc_id % 3 = 0 THEN 'r' END AS ref, doc_id % 50 / 4.0 AS sec FROM labels WHERE quality IS NOT NULL AND doc_id % 5 <> 0)
SELECT 'other' AS model, count(*) AS n, count(*) FILTER (a = b) AS agree, count(*) FILTER (b AND NOT a) AS false_positives, count(*) FILTER (a AND NOT b) AS false_negatives, count(*) FILTER (ref IS NOT NULL) AS cited, round(avg(sec), 4) AS mean_sec, round(sum(sec), 4) AS total_sec FROM j""")
def q87(t, spark):
    i = F.col("doc_id")
    base = t("labels").filter("quality is not null").select(i.alias("id"), (F.col("quality") == 1).alias("duty"))
    other = t("labels").filter(i % 5 != 0).select(i.alias("id"), (F.col("toxic") == 1).alias("duty"), F.when(i % 3 == 0, "r").alias("reference"), (i % 50 / 4.0).alias("sec"))
    return reports.model_scores(reports.model_answers(t("labels").select(i.alias("id")), {"base": base, "other": other}), "base", "other")


@query("q88_archive_outcomes", """WITH o AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'unresolvable' WHEN o_orderkey % 3 = 0 THEN 'delivered' ELSE '' END AS x FROM orders) SELECT outcome, n, (SELECT count(*) FROM o WHERE x <> '') AS scored, round((SELECT count(*) FROM o WHERE x = 'unresolvable') / (SELECT count(*) FROM o WHERE x <> ''), 4) AS share FROM (SELECT CASE x WHEN '' THEN '(not scored)' ELSE x END AS outcome, count(*) AS n FROM o GROUP BY 1)""")
def q88(t, spark):
    k = F.col("o_orderkey")
    rows = t("orders").select(F.when(k % 5 == 0, "unresolvable").when(k % 3 == 0, "delivered").alias("outcome"))
    return reports.outcome_histogram(rows, "outcome").join(F.broadcast(reports.unresolvable_share(rows, "outcome").select("scored", "share")))


@query("q89_strongest_moves", """WITH q AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN 'index' ELSE 'equity' END AS kind, CASE WHEN p_size % 9 = 0 THEN NULL ELSE (p_retailprice - 1400) / 40 END AS c FROM part),
l AS (SELECT p_partkey AS symbol, round(c, 2) AS change, CASE WHEN kind = 'index' THEN CASE WHEN abs(c) >= 3 THEN 'macro' END WHEN c <= -3 THEN 'drops' WHEN c >= 5 THEN 'rallies' END AS list FROM q)
SELECT list, CAST(r AS INTEGER) AS rank, symbol, change FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY CASE list WHEN 'drops' THEN change WHEN 'rallies' THEN -change ELSE -abs(change) END, symbol) AS r FROM l WHERE list IS NOT NULL) WHERE r <= 3""")
def q89(t, spark):
    quotes = t("part").select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") > 45, "index").otherwise("equity").alias("kind"), F.when(F.col("p_size") % 9 == 0, None).otherwise((F.col("p_retailprice") - 1400) / 40).alias("change_pct"))
    return reports.strongest_moves(quotes).select("list", "rank", "symbol", "change")


ENTITIES = [("almond", "ALM", None), ("blush", "BLU", None), ("chiffon", None, "not listed"), ("drab", None, "family owned")]


@query("q90_reconciled", """WITH e(entity, ticker, private) AS (VALUES ('almond', 'ALM', NULL), ('blush', 'BLU', NULL), ('chiffon', NULL, 'not listed'), ('drab', NULL, 'family owned')), m AS (SELECT p_partkey, ticker, entity || ': ' || private AS why FROM part LEFT JOIN e ON contains(lower(p_name), entity) OR contains(entity, lower(p_name)))
SELECT p_partkey, CASE WHEN bool_or(coalesce(ticker = 'ALM', false)) THEN 'AUDITABLE_PUBLIC_FILING' WHEN count(ticker) > 0 THEN 'MAPPED_PUBLIC_SECURITY' WHEN count(why) > 0 THEN 'PRIVATE_UNCHECKABLE' ELSE 'UNCLASSIFIED_SOURCE' END AS status, coalesce(string_agg(DISTINCT ticker, ', ' ORDER BY ticker), '') AS tickers, coalesce(string_agg(DISTINCT why, '; ' ORDER BY why), '') AS reasons FROM m GROUP BY p_partkey""")
def q90(t, spark):
    known = spark.createDataFrame(ENTITIES, "entity string, ticker string, private string")
    return reports.reconciled(t("part").select("p_partkey", "p_name"), "p_partkey", "p_name", known, spark.createDataFrame([("ALM",)], "ticker string"))


@query("q91_item_blocks", """SELECT o_orderkey, o_orderkey || '. HEADLINE: ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '   OPENING: ' || repeat('x', 400) ELSE '' END || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '   FIGURE SENTENCE: (none found in the article)' ELSE '   FIGURE SENTENCE: ' || repeat('5% ', 200) || chr(10) || '   FIGURE SENTENCE: two' END AS block FROM orders""")
def q91(t, spark):
    k = F.col("o_orderkey")
    lead = F.when(k % 2 == 0, F.repeat(F.lit("x"), 500))
    found = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.repeat(F.lit("5% "), 200), F.lit("two")))
    return t("orders").select("o_orderkey", E.item_block(k, F.col("o_orderpriority"), lead, found).alias("block"))


@query("q92_history_merge", """WITH h AS (SELECT CAST(ts AS DATE) AS d, event_type AS s, CAST(count(*) AS DOUBLE) AS p FROM events GROUP BY ALL), q AS (SELECT DATE '2024-01-30' AS d, event_type AS s, -1.0 AS p FROM events WHERE event_type <> 'click' GROUP BY ALL), u AS (SELECT * FROM h WHERE NOT (d = DATE '2024-01-30' AND s <> 'click') UNION ALL SELECT * FROM q)
SELECT CAST(d AS VARCHAR) AS date, s AS symbol, p AS price FROM u WHERE d IN (SELECT DISTINCT d FROM u ORDER BY d DESC LIMIT 5)""")
def q92(t, spark):
    history = t("events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).cast("double").alias("price"))
    quotes = t("events").select(F.lit("2024-01-30").cast("date").alias("date"), F.col("event_type").alias("symbol"), F.lit(-1.0).alias("price"), (F.col("event_type") == "click").alias("stale")).distinct()
    return sinks.merged_history(history, quotes, 5).withColumn("date", F.col("date").cast("string"))


@query("q93_reader_families", "SELECT doc_id, count(DISTINCT f) AS families FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['a', 'a', 'b'] ELSE ['a', 'b', 'c'] END) AS f FROM labels) GROUP BY doc_id")
def q93(t, spark):
    readers = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a:9b"), F.lit("a:27b"), F.lit("b"))).otherwise(F.array(F.lit("a:9b"), F.lit("b:1"), F.lit("c")))
    return reports.reader_families(t("labels").select("doc_id", F.explode(readers).alias("reader")), "doc_id", "reader")
