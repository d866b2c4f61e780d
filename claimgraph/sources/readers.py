"""Feeds and documents in XML and JSON, as text columns or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RSS = "struct<channel:struct<item:array<struct<title:string,link:string,pubDate:string>>>>"
ATOM = "struct<entry:array<struct<title:string,link:array<struct<_href:string>>,updated:string>>>"


def rss_items(xml: Column) -> Column:
    """array<struct<title, link, pubDate>> of an RSS text."""
    return F.from_xml(xml, RSS)["channel"]["item"]


def atom_items(xml: Column) -> Column:
    """The same of an Atom text: the first link's href, the update as date."""
    return F.transform(F.from_xml(xml, ATOM)["entry"], lambda e: F.struct(e["title"].alias("title"), e["link"][0]["_href"].alias("link"), e["updated"].alias("pubDate")))


def feed_items(xml: Column) -> Column:
    """RSS items; if there are none, Atom entries."""
    return F.when(F.size(rss_items(xml)) > 0, rss_items(xml)).otherwise(atom_items(xml))


def json_block(text: Column) -> Column:
    """The JSON object in a model's answer: a fenced one, else from the first brace to the last; null if it doesn't parse."""
    fenced, outer = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    some = F.when(fenced != "", fenced).when(outer != "", outer)
    return F.when(F.try_parse_json(some).isNotNull(), some)


def documents(spark, path: str, schema: str, lines: bool = True, text: bool = False) -> DataFrame:
    """A JSON or JSON-lines store, or (text) a whole file as one value; an absent one is empty."""
    try:
        return spark.read.text(path, wholetext=True) if text else spark.read.schema(schema).option("multiLine", not lines).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ratings(lines: Column) -> Column:
    """struct<pattern, note> of a '- pattern :: note' line; null of others."""
    return F.when(lines.rlike(r"^- .+::"), F.struct(F.trim(F.regexp_extract(lines, r"^- (.+?)\s*::", 1)).alias("pattern"), F.trim(F.regexp_extract(lines, r"::(.*)$", 1)).alias("note")))
