"""Further sources as text columns: sitemaps, papers, data sets, model releases, trends, gazettes, ratings and title caches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgraph.functions.text import bare
from claimgraph.sources import readers

PAPERS = "struct<entry:array<struct<title:string,published:string,link:array<struct<_href:string,_rel:string>>,author:array<struct<name:string>>>>>"
TRENDS = "struct<channel:struct<item:array<struct<title:string,approx_traffic:string,pubDate:string,news_item:array<struct<news_item_title:string,news_item_url:string>>>>>>"
NEWS = "struct<channel:struct<item:array<struct<title:string,link:string,pubDate:string,source:string>>>>"
GAZETTE_RSS = "struct<channel:struct<item:array<struct<title:string,link:string,description:string>>>>"
GAZETTE_ATOM = "struct<entry:array<struct<title:string,link:array<struct<_href:string>>,summary:string>>>"


def first_of(items: Column, most: int) -> Column:
    return F.slice(items, 1, most)


def sitemap_posts(xml: Column, fragment: Column | str) -> Column:
    """array<struct<url, lastmod>> of a sitemap's addresses that have the path fragment of a post."""
    pairs = F.regexp_extract_all(xml, F.lit(r"(?s)<loc>([^<]+)</loc>\s*<lastmod>[^<]+</lastmod>"), 1), F.regexp_extract_all(xml, F.lit(r"(?s)<loc>[^<]+</loc>\s*<lastmod>([^<]+)</lastmod>"), 1)
    rows = F.zip_with(*pairs, lambda u, d: F.struct(u.alias("url"), d.alias("lastmod")))
    part = F.lit(fragment) if isinstance(fragment, str) else fragment
    return F.filter(rows, lambda r: r["url"].contains(part))


def merged_posts(sitemaps: DataFrame, vendor: str, posts: str) -> DataFrame:
    """vendor, url, lastmod: the sitemaps of a vendor as one, an address once, with its latest date."""
    rows = sitemaps.select(F.col(vendor).alias("vendor"), F.inline(posts))
    return rows.groupBy("vendor", "url").agg(F.max("lastmod").alias("lastmod"))


def papers(xml: Column) -> Column:
    """array<struct<kind, title, url, authors, date, venue>> of a feed of papers: the alternate link, the first three authors and 'et al.'."""

    def one(e: Column) -> Column:
        names = F.filter(F.transform(F.coalesce(e["author"], F.array().cast("array<struct<name:string>>")), lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
        by = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, " et al.").otherwise(""))
        link = F.try_element_at(F.filter(e["link"], lambda x: x["_rel"] == "alternate"), F.lit(-1))["_href"]
        title = bare(F.regexp_replace(F.coalesce(e["title"], F.lit("")), r"\s+", " "))
        return F.struct(F.lit("paper").alias("kind"), title.alias("title"), F.coalesce(link, F.lit("")).alias("url"), by.alias("authors"), F.substring(F.coalesce(e["published"], F.lit("")), 1, 10).alias("date"), F.lit("arXiv").alias("venue"))

    return F.transform(F.from_xml(xml, PAPERS)["entry"], one)


def datasets(text: Column, base: str, venue: str, most: int = 8) -> Column:
    """The same of a JSON list of data sets, its first ``most``: the owner is what stands before the slash."""
    rows = first_of(F.from_json(text, "array<struct<id:string,lastModified:string>>"), most)
    ident = lambda d: F.coalesce(d["id"], F.lit(""))
    return F.transform(rows, lambda d: F.struct(F.lit("dataset").alias("kind"), ident(d).alias("title"), F.concat(F.lit(base), ident(d)).alias("url"), F.when(ident(d).contains("/"), F.split_part(ident(d), F.lit("/"), F.lit(1))).otherwise("").alias("authors"), F.substring(F.coalesce(d["lastModified"], F.lit("")), 1, 10).alias("date"), F.lit(venue).alias("venue")))


# Ways of serving one model, and names that move.
VARIANT = r"(?i)(:free|:batch|:thinking|:extended|:online|:nitro|:floor)$"
ALIAS = r"^~|-latest$"
ROUTERS = ("openrouter", "auto")


def lab_name(vendor: Column, names: Mapping[str, str]) -> Column:
    """The known name of a vendor, else its words with capitals."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, F.lower(vendor)), F.initcap(F.replace(vendor, F.lit("-"), F.lit(" "))))


def catalogue_releases(models: DataFrame, since: Column, names: Mapping[str, str]) -> DataFrame:
    """lab, model, id, day, hf_id, evidence of a catalogue (id, name, created in seconds, hugging_face_id, context_length).

    Ways of serving are one model, which has its earliest date and that row; routers, moving names, and what is older than
    ``since`` or has no id or date are left out.
    """
    base = F.regexp_replace("id", VARIANT, "")
    rows = models.filter((F.coalesce("id", F.lit("")) != "") & (F.col("created") > 0)).withColumn("base", base).withColumn("at", F.timestamp_seconds("created"))
    kept = rows.filter((F.col("at") >= since) & ~F.lower(F.split_part("base", F.lit("/"), F.lit(1))).isin(*ROUTERS) & ~F.col("base").rlike(ALIAS))
    first = kept.groupBy("base").agg(F.min_by(F.struct("id", "name", "at", "hugging_face_id", "context_length"), F.struct("at", "id")).alias("m"))
    hf = F.coalesce("m.hugging_face_id", F.lit(""))
    return first.select(lab_name(F.split_part("base", F.lit("/"), F.lit(1)), names).alias("lab"), F.coalesce("m.name", "base").alias("model"), F.col("base").alias("id"), F.col("m.at").cast("date").alias("day"), hf.alias("hf_id"), F.when(hf != "", "open-weights").otherwise("closed").alias("evidence"), F.col("m.context_length").alias("context_length"))


def org_releases(answers: DataFrame, since: Column, names: Mapping[str, str], most: int = 5) -> DataFrame:
    """The same of answers (org, body): the ``most`` newest models of each organisation; an answer that is no list is a row with error."""
    parsed = F.from_json("body", "array<struct<id:string,createdAt:string>>")
    rows = answers.select("org", F.when(F.col("body").rlike(r"^\s*\["), parsed).alias("models"))
    failed = rows.filter("models is null").select("org", F.lit("no list").alias("error"))
    each = rows.select("org", F.inline("models")).withColumn("day", F.try_to_timestamp(F.substring("createdAt", 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    newest = each.filter(F.col("day").isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy("org").orderBy(F.desc("createdAt"), "id"))).filter((F.col("r") <= most) & (F.col("day") >= since.cast("date")))
    good = newest.select("org", lab_name(F.col("org"), names).alias("lab"), F.substring_index("id", "/", -1).alias("model"), "id", "day", F.col("id").alias("hf_id"), F.lit("open-weights").alias("evidence"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def merged_releases(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of the first list, and of the second what the first doesn't have by its weights' id, in any case; newest first, the first list's before the second's."""
    known = first.filter("hf_id <> ''").select(F.lower("hf_id").alias("known")).distinct()
    more = second.join(known, F.lower(second["hf_id"]) == F.col("known"), "left_anti")
    both = first.withColumn("list", F.lit(0)).unionByName(more.withColumn("list", F.lit(1)), allowMissingColumns=True)
    return both.orderBy(F.desc("day"), "list", "id").drop("list")


def trends(xml: Column) -> Column:
    """array<struct<query, traffic, pub_date, news>> of a feed of searches; news: array<struct<title, url>>; null if it is no feed."""
    plain = F.regexp_replace(xml, r"<(/?)ht:", "<$1")
    news = lambda i: F.filter(F.transform(F.coalesce(i["news_item"], F.array().cast("array<struct<news_item_title:string,news_item_url:string>>")), lambda n: F.struct(n["news_item_title"].alias("title"), F.coalesce(n["news_item_url"], F.lit("")).alias("url"))), lambda n: F.coalesce(n["title"], F.lit("")) != "")
    return F.transform(F.from_xml(plain, TRENDS)["channel"]["item"], lambda i: F.struct(F.coalesce(i["title"], F.lit("")).alias("query"), F.coalesce(i["approx_traffic"], F.lit("N/A")).alias("traffic"), F.coalesce(i["pubDate"], F.lit("")).alias("pub_date"), news(i).alias("news")))


def category_news(xml: Column, most: int = 3) -> Column:
    """array<struct<title, url, source, pub_date>>: the first articles of a category's feed; null if it is none."""
    rows = first_of(F.from_xml(xml, NEWS)["channel"]["item"], most)
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(rows, lambda i: F.struct(text(i["title"]).alias("title"), text(i["link"]).alias("url"), F.coalesce(i["source"], F.lit("News")).alias("source"), F.substring(text(i["pubDate"]), 1, 16).alias("pub_date")))


def gazette_items(xml: Column, most: int = 10) -> Column:
    """array<struct<title, link, summary>>: the first items of an RSS text, else of an Atom one; a missing summary is the title."""
    rss = F.transform(F.from_xml(xml, GAZETTE_RSS)["channel"]["item"], lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), F.coalesce(F.nullif(i["description"], F.lit("")), i["title"]).alias("summary")))
    atom = F.transform(F.from_xml(xml, GAZETTE_ATOM)["entry"], lambda e: F.struct(e["title"].alias("title"), e["link"][0]["_href"].alias("link"), F.coalesce(F.nullif(e["summary"], F.lit("")), e["title"]).alias("summary")))
    return first_of(F.when(F.size(rss) > 0, rss).otherwise(atom), most)


def register_items(text: Column, most: int = 10) -> Column:
    """The same of a JSON answer with results (title, html_url, abstract)."""
    rows = first_of(F.from_json(text, "results array<struct<title:string,html_url:string,abstract:string>>")["results"], most)
    return F.transform(rows, lambda r: F.struct(r["title"].alias("title"), r["html_url"].alias("link"), F.coalesce(F.nullif(r["abstract"], F.lit("")), r["title"]).alias("summary")))


# Headings of a file of ratings, in the order in which they are tried.
CLASSES = ("trusted", "caution", "blocked")


def ratings_file(text: Column) -> Column:
    """array<struct<class, pattern, note>> of a file of ratings: '- pattern :: note' lines below a heading of their class; patterns in lower case."""
    none = F.array().cast("array<struct<class:string,pattern:string,note:string>>")

    def step(acc: Column, line: Column) -> Column:
        s = bare(line)
        head = F.coalesce(*[F.when(F.upper(s).startswith(f"## {c.upper()}"), c) for c in CLASSES])
        pattern, note = F.lower(bare(F.split_part(F.substring(s, 3, 1 << 20), F.lit("::"), F.lit(1)))), bare(F.coalesce(F.get(F.split(s, "::", 2), F.lit(1)), F.lit("")))
        row = F.struct(acc["class"].alias("class"), pattern.alias("pattern"), note.alias("note"))
        fits = s.startswith("- ") & ~s.startswith("- <") & acc["class"].isNotNull() & (pattern != "")
        return F.struct(F.coalesce(head, acc["class"]).alias("class"), F.when(head.isNull() & F.coalesce(fits, F.lit(False)), F.concat(acc["all"], F.array(row))).otherwise(acc["all"]).alias("all"))

    return F.aggregate(F.split(text, "\n"), F.struct(F.lit(None).cast("string").alias("class"), none.alias("all")), step)["all"]


def title_cache(text: Column) -> Column:
    """array<struct<url, title, published>> of a JSON object by address whose values are titles, or objects; other keys go."""
    pairs = F.map_entries(F.from_json(text, "map<string,variant>"))
    rows = F.transform(F.filter(pairs, lambda e: e["key"].rlike("^https?://")), lambda e: F.struct(e["key"].alias("url"), F.coalesce(F.try_variant_get(e["value"], "$.title", "string"), F.when(~F.schema_of_variant(e["value"]).startswith("OBJECT"), F.try_variant_get(e["value"], "$", "string")), F.lit("")).alias("title"), F.coalesce(F.try_variant_get(e["value"], "$.published", "string"), F.lit("")).alias("published"), F.schema_of_variant(e["value"]).alias("kind")))
    kept = F.filter(rows, lambda r: (r["kind"] == "STRING") | r["kind"].startswith("OBJECT"))
    return F.transform(kept, lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["published"].alias("published")))


def file_hashes(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """name (the last folder and the file), hash: SHA-256 of the named files below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    return files.filter(F.element_at(parts, -1).isin(*names)).select(F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("name"), F.sha2("content", 256).alias("hash"))


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value: a store that is one JSON object by key; an absent one is empty."""
    rows = readers.documents(spark, path, "value string", text=True)
    return rows.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def registry(spark: SparkSession, text: str, field: str, value: str) -> DataFrame:
    """key, value: an object of a registry's JSON text, such as its tiers by type."""
    return spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", f"`{field}` map<string,{value}>")[field]))


def last_observations(rows: DataFrame, series: str, day: str, value: str) -> DataFrame:
    """series, asof, value, change_pct: the last observation of each series and how it changed from the one before, in percent.

    Values are texts; "." and whatever is no number is no observation, and neither is the one before. A series of one
    observation has no change, nor has one whose last but one is 0; a series of none has no row. Of several values of a
    day the largest counts.
    """
    seen = rows.select(F.col(series).alias("series"), F.col(day).alias("asof"), F.col(value).try_cast("double").alias("value")).filter("value IS NOT NULL AND asof IS NOT NULL")
    daily = seen.groupBy("series", "asof").agg(F.max("value").alias("value"))
    newest = Window.partitionBy("series").orderBy(F.desc("asof"))
    two = daily.withColumn("nth", F.row_number().over(newest)).filter("nth <= 2")
    last = two.groupBy("series").agg(*[F.max(F.when(F.col("nth") == n, F.col(c))).alias(name) for n, c, name in ((1, "asof", "asof"), (1, "value", "value"), (2, "value", "before"))])
    return last.select("series", "asof", "value", (100 * (F.try_divide("value", "before") - 1)).alias("change_pct"))
