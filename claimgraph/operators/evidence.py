"""What an article offers as evidence: whom it names, whom it quotes, what it links to, and the corpus's totals."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions import text as T
from claimgraph.functions.urls import hostname, suffixes
from claimgraph.operators.phrases import Pattern, spotted

# Words that attribute, sources without a name, spokespeople, and names that are no subject or no topic.
ATTRIB = r"\b(?:said|says|told|according to|confirmed|announced|wrote|claimed|estimates?|reported|argues?|added|noted)\b"
UNNAMED = r"\b(?:sources?|people familiar|insiders?|a person|someone|reports?|it is understood|rumou?rs?|leaks?)\b"
SPOKES = r"\b(?:a )?spokes(?:person|man|woman)\b"
BAD_ENTITY = r"^(none|null|n/?a|unknown|researchers?|scientists?|artists?|experts?|users?|ai (?:startups?|researchers?|companies|industry)|startups?|the )\.?$"
GENERIC_TAG = (
    r"^(ai|a\.i\.|artificial intelligence|tech|technology|news|policy|business|law|"
    r"books|music|entertainment|exclusive|gadgets|enterprise|security|startups|science|"
    r"research|analysis|opinion|features|reviews|culture|health|climate|energy|"
    r"government federal register.*)$"
)


def usable_entity(name: Column) -> Column:
    """True of a name of two characters or more that is no general noun and no bare domain."""
    return F.coalesce((F.length(name) >= 2) & ~F.trim(name).rlike(T.ANY_CASE + BAD_ENTITY) & (~name.contains(".") | name.contains(" ")), F.lit(False))


def aliases(name: Column, curated: Mapping[str, Sequence[str]]) -> Column:
    """The forms of a name to look for: itself, its first word and the curated ones, those of more than two characters; empty without a name."""
    more = F.coalesce(*[F.when(name == k, F.array(*map(F.lit, v))) for k, v in curated.items() if v], F.array().cast("array<string>"))
    own = F.filter(F.array_distinct(F.concat(F.array(name, F.split_part(name, F.lit(" "), F.lit(1))), more)), lambda x: F.length(x) > 2)
    return F.when(F.coalesce(name, F.lit("")) != "", own).otherwise(F.array().cast("array<string>"))


def attribution(sentences: Column, forms: Column, least: int = 30) -> Column:
    """struct<to_subject, to_others, unnamed>: attributing sentences, from a sentences array, by who is said to be the source; ``forms`` are the subject's."""
    names = lambda s: F.exists(forms, lambda f: s.contains(f))

    def kind(s: Column) -> Column:
        return F.when(s.rlike(T.ANY_CASE + UNNAMED) & ~names(s), "unnamed").when((F.size(forms) > 0) & (names(s) | s.rlike(T.ANY_CASE + SPOKES)), "to_subject").otherwise("to_others")

    told = F.filter(sentences, lambda s: (F.length(s) >= least) & s.rlike(T.ANY_CASE + ATTRIB))
    sorts = F.transform(told, lambda s: F.struct(kind(s).alias("kind"), s.alias("s")))
    of = lambda every, k: F.transform(F.filter(every, lambda x: x["kind"] == k), lambda x: x["s"]).alias(k)
    return F.transform(F.array(sorts), lambda every: F.struct(of(every, "to_subject"), of(every, "to_others"), of(every, "unnamed")))[0]


def within(host: Column, domains: Sequence[str]) -> Column:
    """True if the host is one of the domains or below it."""
    return F.arrays_overlap(suffixes(host), F.array(*map(F.lit, domains))) if domains else F.lit(False)


def link_kinds(links: Column, scope: Column, entity: Column, primary: Sequence[str], own: Mapping[str, Sequence[str]]) -> Column:
    """struct<primary, subject_own, other>: the links of an article by kind; those of a wider region than the article aren't counted."""
    kept = F.when(scope == "article", links).otherwise(F.array().cast("array<string>"))
    mine = lambda h: F.coalesce(*[F.when(entity == k, within(h, v)) for k, v in own.items()], F.lit(False))
    kind = lambda h: F.when(within(h, primary), "primary").when(mine(h), "subject_own").otherwise("other")
    # Each link's host is read once, however many sites it is held against and however often the result is named.
    told = F.transform(kept, lambda u: F.struct(u.alias("u"), T.let(hostname(u), kind).alias("kind")))

    def dealt(links: Column) -> Column:
        of = lambda k: F.transform(F.filter(links, lambda x: x["kind"] == k), lambda x: x["u"]).alias(k)
        return F.struct(of("primary"), of("subject_own"), of("other"))

    return T.let(told, dealt)


def named_source_figures(sentences: Column) -> Column:
    """struct<total, with_named_source>: figure sentences, and those among them that attribute."""
    return F.struct(F.size(sentences).alias("total"), F.size(F.filter(sentences, lambda s: s.rlike(T.ANY_CASE + ATTRIB))).alias("with_named_source"))


def publisher_topic(tags: Column) -> Column:
    """The first tag of 3 to 40 characters that names no section; '' if there is none."""
    fits = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: F.length(t).between(3, 40) & ~t.rlike(T.ANY_CASE + GENERIC_TAG))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(""))


def resolved(headline: Column, tags: Column, host: Column, orgs: Mapping[str, Sequence[str]], products: Mapping[str, str], sites: Mapping[str, str]) -> Column:
    """struct<entity, basis>: whom an item is about.

    The organisation whose form stands first in the headline (of equal places the longest form, then the name); else the
    owner of the longest product named there; else the one organisation that tags name, and none if they name several;
    else the site's own. Basis says which: headline, product:x, tag, tags-name-n-orgs, site, site:no-subject, unresolved.
    """
    forms = [(f, name) for name, fs in orgs.items() for f in fs]
    ranked = sorted(products.items(), key=lambda x: (-len(x[0]), x[0]))
    patterns = [Pattern(f, plural=False) for f, _ in forms] + [Pattern(p, plural=False) for p, _ in ranked]
    found = spotted(F.array(headline), patterns, "_")
    named = F.from_json(F.lit(json.dumps([{"n": -len(f), "name": name} for f, name in forms])), "array<struct<n:int,name:string>>")
    owners = F.from_json(F.lit(json.dumps([{"product": p, "owner": o} for p, o in ranked])), "array<struct<product:string,owner:string>>")
    met = F.array_min(F.transform(F.filter(found, lambda x: x["n"] < len(forms)), lambda x: F.struct(x["at"].alias("p"), F.get(named, x["n"])["n"].alias("n"), F.get(named, x["n"])["name"].alias("name"))))
    product = F.get(owners, F.array_min(F.transform(F.filter(found, lambda x: x["n"] >= len(forms)), lambda x: x["n"] - len(forms))))
    out = lambda entity, basis: F.struct((F.lit(entity) if isinstance(entity, str) else entity).alias("entity"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis"))
    told = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    tagged = F.filter(F.array(*[F.when(F.arrays_overlap(told, F.array(*[F.lit(f.lower()) for f in forms])), name) for name, forms in orgs.items()]), lambda x: x.isNotNull())
    n = F.size(tagged)
    result = F.when(met.isNotNull(), out(met["name"], "headline"))
    result = result.when(product.isNotNull(), out(product["owner"], F.concat(F.lit("product:"), product["product"])))
    result = result.when(n == 1, out(F.get(tagged, F.lit(0)), "tag")).when(n > 1, out("", F.concat(F.lit("tags-name-"), n.cast("string"), F.lit("-orgs"))))
    for domain, org in sites.items():
        result = result.when(within(host, [domain]), out(org, "site" if org else "site:no-subject"))
    return result.otherwise(out("", "unresolved"))


def basis_histogram(items: DataFrame, basis: str) -> DataFrame:
    """basis, n: how often each ground stands, what is in brackets left out, most first."""
    return items.groupBy(F.trim(F.split_part(basis, F.lit("("), F.lit(1))).alias("basis")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "basis")


def corpus_report(evidence: DataFrame) -> DataFrame:
    """One row of counts, each beside what it is counted among.

    ``evidence``: fetched, entity_usable, to_subject, to_others, unnamed, primary, subject_own, figures, sourced_figures,
    cites, cited_by (numbers).
    """
    ok, usable = F.col("fetched"), F.col("fetched") & F.col("entity_usable")
    none = (F.col("to_subject") + F.col("to_others") + F.col("unnamed")) == 0
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    total = lambda c, name: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long").alias(name)
    return evidence.agg(
        F.count(F.lit(1)).alias("items"), count(ok, "fetched"), count(usable, "usable"),
        count(usable & (F.col("to_subject") > 0) & (F.col("to_others") == 0), "only_subject"), count(ok & none, "unattributed"), count(ok & (F.col("unnamed") > 0), "with_unnamed"),
        count(ok & (F.col("primary") > 0), "with_primary"), count(ok & (F.col("subject_own") > 0), "with_own"), total("figures", "figures"), total("sourced_figures", "sourced_figures"),
        count(ok & ((F.col("cites") > 0) | (F.col("cited_by") > 0)), "in_chain"),
    )


def story_chains(items: DataFrame, url: str, links: str, scope: str) -> DataFrame:
    """citing, cited: pairs of different items by canonical URL, one of whose article links to the other."""
    own = items.select(F.col(url).alias("cited")).distinct()
    told = items.filter(F.col(scope) == "article").select(F.col(url).alias("citing"), F.explode(links).alias("cited")).distinct()
    return told.filter("citing <> cited").join(own, "cited").select("citing", "cited")


def item_block(number: Column, headline: Column, lead: Column, sentences: Column, most: int = 400) -> Column:
    """An item as lines of a prompt: headline, the lead's first ``most`` characters, and every figure sentence whole."""
    opening = F.when(F.coalesce(lead, F.lit("")) != "", F.concat(F.lit("   OPENING: "), F.substring(lead, 1, most)))
    found = F.when(F.size(sentences) > 0, F.transform(sentences, lambda s: F.concat(F.lit("   FIGURE SENTENCE: "), s))).otherwise(F.array(F.lit("   FIGURE SENTENCE: (none found in the article)")))
    lines = F.concat(F.array(F.concat(number.cast("string"), F.lit(". HEADLINE: "), F.coalesce(headline, F.lit(""))), opening), found)
    return F.array_join(lines, "\n")


def without_headlines(rows: DataFrame, sentence: str, own: str, headlines: DataFrame) -> DataFrame:
    """``rows`` but those whose ``sentence`` is the headline of another item, as rails of related stories have it; their ``own`` headline is no other's.

    Sentences are compared without regard to case, white space and character references. ``headlines`` has one column.
    Digests meet, not texts.
    """
    key = lambda c: F.sha2(T.sentence_key(c), 256)
    known = headlines.select(key(F.col(headlines.columns[0])).alias("headline_key")).distinct()
    marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), key(F.col(sentence)).alias("k"), key(F.col(own)).alias("mine"))
    met = marked.join(known, F.col("k") == F.col("headline_key"), "left")
    return met.filter("headline_key IS NULL OR k = mine").select("row.*")


def source_identity(sources: Column) -> Column:
    """The names and then the hosts of an item's sources, in lower case; neither paths nor headlines, which name others."""
    names = F.transform(sources, lambda s: F.coalesce(s["name"], F.lit("")))
    hosts = F.transform(sources, lambda s: F.coalesce(hostname(s["url"]), F.lit("")))
    return F.lower(F.array_join(F.concat(names, hosts), " "))
