"""What a page says of itself, as column expressions: title, tags, links."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from claimgraph.functions import text as T
from claimgraph.functions.urls import hostname

LINK = r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"'#][^"']*)["']"""
LINKED_DATA = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def meta(html: Column, key: str) -> Column:
    """The contents of the meta tags whose property or name is ``key``, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"""(?i)<meta[^>]+(?:property|name)\s*=\s*["']{key}["'][^>]*\bcontent\s*=\s*["']([^"']*)["']"""), 1), T.unescape)


def page_title(html: Column, publishers: Sequence[str] = ()) -> Column:
    """og:title, else the title element, on one line; a publisher's name behind a bar, dot or dash is left out. '' if there is none."""
    said = F.coalesce(first_match(html, r"""(?i)<meta[^>]+property=["']og:title["'][^>]*content=["']([^"']+)["']"""), first_match(html, r"(?is)<title[^>]*>(.*?)</title>"), F.lit(""))
    one = F.trim(T.unescape(F.regexp_replace(said, r"\s+", " ")))
    return F.regexp_replace(one, rf"(?i)\s*[|\\•·-]\s*(?:{'|'.join(publishers)})\s*$", "") if publishers else one


def linked_tags(document) -> list[str]:
    """keywords and the names under about of all objects of a linked-data document, at any depth of lists and of @graph; the last of a list comes first."""
    tags: list[str] = []
    waiting = list(document) if isinstance(document, list) else [document]
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting += node
        elif isinstance(node, dict):
            if node.get("@graph"):
                waiting.append(node["@graph"])
            words = node.get("keywords")
            tags += words.split(",") if isinstance(words, str) else map(str, words) if isinstance(words, list) else []
            about = node.get("about")
            tags += [str(x["name"]) for x in about if isinstance(x, dict) and x.get("name")] if isinstance(about, list) else []
    return tags


@F.arrow_udf(ArrayType(StringType()))
def linked_data_tags(blocks: pa.Array) -> pa.Array:
    """The tags of a page's blocks of linked data, each parsed once; blocks that don't parse say nothing. A walk to any depth, which no column expression makes."""

    def of(page: list | None) -> list[str]:
        out: list[str] = []
        for block in page or []:
            try:
                out += linked_tags(json.loads(block.strip()))
            except (ValueError, RecursionError):
                continue
        return out

    return pa.array([of(page) for page in blocks.to_pylist()], pa.list_(pa.string()))


def publisher_tags(html: Column, most: int = 30) -> Column:
    """The publisher's own tags: keywords and about of linked data, nested ones included, then tag and keyword metas.

    Trimmed; of tags that differ in case only the first; under 60 characters, at most ``most``.
    """
    metas = F.flatten(F.transform(F.concat(meta(html, "article:tag"), meta(html, "keywords")), lambda x: F.split(x, ",")))
    said = F.concat(linked_data_tags(F.regexp_extract_all(html, F.lit(LINKED_DATA), 1)), metas)
    kept = F.filter(F.transform(said, T.bare), lambda x: (x != "") & (F.length(x) < 60))

    def first_of_case(tags: Column) -> Column:
        low = F.transform(tags, lambda x: F.lower(x))
        first = F.filter(F.transform(tags, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda t: F.array_position(low, F.lower(t["x"])) == t["i"] + 1)
        return F.slice(F.transform(first, lambda t: t["x"]), 1, most)

    return F.transform(F.array(kept), first_of_case)[0]


def site_name(html: Column) -> Column:
    """The last og:site_name; '' if there is none."""
    return F.coalesce(F.try_element_at(meta(html, "og:site_name"), F.lit(-1)), F.lit(""))


def outbound(html: Column, url: Column, most: int = 200) -> Column:
    """The absolute links to other hosts in the page's content region, each once, as they come, at most ``most``."""
    region = T.content_region(html)
    for tag in T.DROPPED:
        region = F.regexp_replace(region, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    scheme = F.coalesce(first_match(F.lower(url), r"^(https?):"), F.lit("https"))
    links = F.transform(F.regexp_extract_all(region, F.lit(LINK), 1), lambda x: T.unescape(F.trim(x)))
    whole = F.transform(links, lambda x: F.when(x.startswith("//"), F.concat(scheme, F.lit(":"), x)).otherwise(x))
    outside = lambda own: F.filter(whole, lambda x: x.rlike("^https?://") & T.let(hostname(x), lambda h: (h != "") & (h != own)))
    return F.slice(F.array_distinct(T.let(hostname(url), outside)), 1, most)


# How records are named.
def primary_kind(url: Column) -> Column:
    """arXiv paper, DOI record, official record or primary source."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    official = host.endswith(".gov") | host.endswith(".gov.uk") | host.contains("europa.eu")
    return F.when(host == "arxiv.org", "arXiv paper").when(host == "doi.org", "DOI record").when(official, "official record").otherwise("primary source")


def primary_label(url: Column) -> Column:
    """arXiv and its number, DOI and its name, else host and path, at most 78 characters."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    shown = F.regexp_replace(F.concat(host, F.lit("/"), path), "/+$", "")
    return F.when(host == "arxiv.org", F.concat(F.lit("arXiv "), F.regexp_replace(F.regexp_replace(path, r"^(?:abs|html|pdf)/", ""), r"\.pdf$", ""))).when(host == "doi.org", F.concat(F.lit("DOI "), path)).when(F.length(shown) <= 78, shown).otherwise(F.concat(F.substring(shown, 1, 75), F.lit("...")))
