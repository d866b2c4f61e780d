"""URL identity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that don't change what a URL names.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def hostname(url: Column) -> Column:
    """Lower-case host without user, port and one leading 'www.'; '' if there is none."""
    net = F.regexp_replace(F.regexp_extract(url, SHAPE, 2), r"^.*@|:[0-9]*$", "")
    return F.regexp_replace(F.lower(net), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """What a URL names: scheme and host in lower case, no user, port, 'www.', trailing slash, fragment or tracking key; the query sorted and encoded anew; video links in their one form. A text without scheme or host is trimmed only."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme, net, path = F.lower(F.regexp_extract(u, SHAPE, 1)), F.regexp_extract(u, SHAPE, 2), F.regexp_extract(u, SHAPE, 3)
    host = hostname(u)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    split = F.transform(F.filter(F.split(F.substring(F.regexp_extract(u, SHAPE, 4), 2, 1 << 20), "&"), lambda p: p != ""), lambda p: F.split(p, "=", 2))
    pairs = F.transform(split, lambda s: F.struct(plain(F.get(s, F.lit(0))).alias("k"), plain(F.coalesce(F.get(s, F.lit(1)), F.lit(""))).alias("v")))
    kept = F.filter(pairs, lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(*TRACKING_KEYS)))
    one = lambda v: F.filter(F.array(F.struct(F.lit("v").alias("k"), v.alias("v"))), lambda p: p["v"] != "")
    short, tube = host == "youtu.be", host.isin("youtube.com", "m.youtube.com")
    clip = tube & path.startswith("/shorts/")
    query = F.when(short, one(F.regexp_extract(path, "^/*([^/]*)", 1))).when(clip, F.array(F.struct(F.lit("v").alias("k"), F.regexp_extract(path, "^/shorts/([^/]*)", 1).alias("v")))).when(tube & (path == "/watch"), F.filter(pairs, lambda p: p["k"] == "v")).otherwise(kept)
    bare = F.when(short | clip, "/watch").otherwise(F.regexp_replace(path, "/+$", ""))
    told = F.array_join(F.transform(F.array_sort(query), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), F.when(short | tube, "youtube.com").otherwise(host), F.when(bare == "", "/").otherwise(bare), F.when(told == "", "").otherwise(F.concat(F.lit("?"), told)))
    return F.when((scheme == "") | (net == ""), u).otherwise(whole)


def domain(url: Column) -> Column:
    """The host with its port, as written, every 'www.' taken out; the whole text if there is none, '' of null."""
    net = F.regexp_extract(url, r"^https?://([^/]+)/?", 1)
    return F.coalesce(F.when(net != "", F.replace(net, F.lit("www."), F.lit(""))).otherwise(url), F.lit(""))


def suffixes(host: Column) -> Column:
    """All label suffixes of a host: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
