"""Registry-driven rules: topics, mentions, scopes, ratings and tiers."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgraph.functions.text import word
from claimgraph.operators.phrases import Pattern, spotted


# Words of a scheduled event, and the forms of a date whose year counts.
SCHEDULED = r"(?i)\b(expir\w+|deadline|effective date|takes? effect|comes? into force|auction|hearing|ruling|verdict|comment period|consultation closes|moratorium|sunset|lock-?up|due to report|scheduled for)\b"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
DATED = rf"(?i)\b(?:{MONTHS})\b\s+[0-9]{{1,2}},?\s+(20[0-9]{{2}})|\b[0-9]{{1,2}}\s+(?:{MONTHS})\b\s+(20[0-9]{{2}})|\b(?:by|before|from|in|until|through|starting)\s+(20[0-9]{{2}})\b|\bQ[1-4]\s+(20[0-9]{{2}})\b"


def first_scheduled(text: Column, years: Sequence[int], most: int = 400) -> Column:
    """The first sentence, of at most ``most`` characters, that names a scheduled event and whose first date is in one of the years; null if there is none."""
    parts = F.split(F.regexp_replace(F.trim(text), r"\s+", " "), r"(?<=[.!?]) ")
    year = lambda s: F.coalesce(*[F.nullif(F.regexp_extract(s, DATED, g), F.lit("")) for g in (1, 2, 3, 4)])
    fits = lambda s: (F.length(s) <= most) & s.rlike(SCHEDULED) & F.coalesce(year(s).isin([str(y) for y in years]), F.lit(False))
    return F.get(F.filter(parts, fits), F.lit(0))


def deflation_spans(spans: Column, tier: Column, denominator: Column, most: int = 3) -> Column:
    """The first spans of a claim by an interested source that states no base; none of others."""
    return F.when(tier.isin(4, 5) & (denominator == "N"), F.slice(spans, 1, most)).otherwise(F.slice(spans, 1, 0))


def words_in(text: Column, words: Sequence[str]) -> Column:
    """Which of the lower-case ASCII words stand in the text, in one pass over it; empty of null."""
    kept = F.array(*[F.lit(w) for w in sorted(set(words))])
    return F.coalesce(F.array_intersect(F.split(F.lower(text), "[^a-z0-9]+"), kept), F.array().cast("array<string>"))


def topic_scores(df: DataFrame, ident: str, texts: dict[str, tuple[Column, int]], rules: Sequence[tuple[str, str, int]], least: int) -> DataFrame:
    """ident, topic, score: each rule counts once for each class of text, however often it occurs there, times the class's factor; a topic needs ``least``."""
    # Each text is read once for all rules that are words, or words to choose from; other patterns are tried one by one.
    plain = {rule: rule.split("|") for _, rule, _ in rules if re.fullmatch(r"[a-z0-9|]+", rule)}
    every = [w for ws in plain.values() for w in ws]
    held = df.select(F.col(ident).alias("id"), *[x for i, (text, _) in enumerate(texts.values()) for x in (words_in(text, every).alias(f"hits{i}"), text.alias(f"text{i}"))])

    def holds(i: int, rule: str) -> Column:
        return F.arrays_overlap(F.col(f"hits{i}"), F.array(*map(F.lit, plain[rule]))) if rule in plain else word(F.col(f"text{i}"), rule)

    hits = [F.when(holds(i, rule), F.struct(F.lit(topic).alias("topic"), F.lit(score * factor).alias("score"))) for topic, rule, score in rules for i, (_, factor) in enumerate(texts.values())]
    found = held.select(F.col("id").alias(ident), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h"))
    return found.groupBy(ident, F.col("h.topic").alias("topic")).agg(F.sum("h.score").cast("long").alias("score")).filter(F.col("score") >= least)


def anchors(scores: DataFrame, ident: str) -> DataFrame:
    """The best topic of each item if it is strictly ahead; ties abstain."""
    w = Window.partitionBy(ident).orderBy(F.desc("score"), "topic")
    ranked = scores.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return ranked.filter((F.col("r") == 1) & (F.col("next").isNull() | (F.col("score") > F.col("next")))).select(ident, "topic", "score")


#: A character that stands for one side of an edge of a word.
EDGE = "\x01"


def bound(value: Column, body) -> Column:
    """body(value), with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def first_mention(text: Column, forms: Sequence[tuple[str, str]]) -> Column:
    """The name whose form stands first in the text; of equal places the longest form, then the name."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    at = lambda form: F.regexp_instr(low, F.lit(f"[^a-z0-9]{form}[^a-z0-9]"))
    found = F.array(*[F.when(at(form) > 0, F.struct(at(form).alias("p"), F.lit(-len(form)).alias("n"), F.lit(name).alias("name"))) for name, form in forms])
    return F.array_min(F.filter(found, lambda x: x.isNotNull()))["name"]


def mention_counts(text: Column, forms: Sequence[tuple[str, str]], limit: int = 20_000) -> Column:
    """array<struct<name, n>>: occurrences in the leading part; overlapping forms of a name count each."""

    def counts(x: Column) -> Column:
        # Words stand between two spaces each, so that what one form takes isn't missing to the next.
        times = lambda form: ((F.length(x) - F.length(F.replace(x, F.lit(f" {form} "), F.lit("")))) / (len(form) + 2)).cast("int")
        return F.array(*[F.struct(F.lit(name).alias("name"), times(form).alias("n")) for name, form in forms])

    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.substring(text, 1, limit)), "[^a-z0-9]+", "  "), F.lit(" "))
    return F.transform(F.array(low), counts)[0]


def mentions(text: Column, host: Column, registry: Mapping[str, Sequence[str]], most: int = 6, limit: int = 20_000) -> Column:
    """array<struct<name, count>>: how often the forms of each name stand as words in the leading part, in any case.

    Overlapping forms count each. A publisher is no mention in its own text: a name is left out if one of its forms, without
    spaces, is in the host. The ``most`` frequent stay, of equal ones those that the registry has first. Each edge of a
    word is marked on either side in one pass, so that forms are counted as plain strings.
    """

    def marked(form: str) -> str:
        return re.sub(r"\b", EDGE * 2, form.lower())[1:-1]

    def counted(read: Column) -> Column:
        x, site = read["text"], read["host"]
        times = lambda form: F.floor((F.length(x) - F.length(F.replace(x, F.lit(marked(form)), F.lit("")))) / len(marked(form))).cast("int")
        own = lambda forms: F.coalesce(reduce(lambda p, q: p | q, [F.contains(site, F.lit(f.lower().replace(" ", ""))) for f in forms]), F.lit(False))
        n = lambda forms: F.when(own(forms), 0).otherwise(sum([times(f) for f in forms], F.lit(0)))
        each = F.array(*[F.struct((-n(forms)).alias("less"), F.lit(i).alias("place"), F.lit(name).alias("name")) for i, (name, forms) in enumerate(registry.items()) if forms])
        return F.slice(F.array_sort(F.filter(each, lambda m: m["less"] < 0)), 1, most)

    lead = F.replace(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, limit)), F.lit(EDGE), F.lit(" "))
    edged = F.regexp_replace(lead, r"(?U)\w+", f"{EDGE * 2}$0{EDGE * 2}")
    found = bound(F.struct(edged.alias("text"), F.lower(host).alias("host")), counted)
    return F.transform(found, lambda m: F.struct(m["name"].alias("name"), (-m["less"]).cast("long").alias("count")))


def rated(identity: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """blocked, caution, trusted or ok, in this precedence."""
    has = lambda kind: F.coalesce(*[F.when(identity.contains(p), True) for k, p in patterns if k == kind], F.lit(False))
    return F.when(has("blocked"), "blocked").when(has("caution"), "caution").when(has("trusted"), "trusted").otherwise("ok")


def claim_tier(owner: Column, entity: Column, holds: Column) -> Column:
    """5 if the publisher is the subject, 4 if it holds a stake in it, else unresolved (null)."""
    return F.when(owner.isNotNull() & (owner == entity), 5).when(owner.isNotNull() & holds, 4)


def market_band(change: Column) -> Column:
    return F.when(change >= 10, "breakout").when(change >= 5, "surge").when(change <= -5, "critical").when(change <= -3, "warning")


# How much a verdict asks for a person, most first.
VERDICTS = ("split", "tied", "majority", "unanimous", "single")


def verdict(readings: Column) -> Column:
    """Of an array of readings: single (one or none), unanimous, split (all differ), majority (one has most), or tied."""
    counts = F.array_sort(F.transform(F.array_distinct(readings), lambda v: -F.size(F.filter(readings, lambda x: x.eqNullSafe(v)))))
    return F.when(F.size(readings) < 2, "single").when(F.size(counts) == 1, "unanimous").when(F.size(counts) == F.size(readings), "split").when(F.get(counts, F.lit(0)) < F.get(counts, F.lit(1)), "majority").otherwise("tied")


def severity(said: Column) -> Column:
    """The place of a verdict in VERDICTS, from 0."""
    return F.array_position(F.array(*map(F.lit, VERDICTS)), said).cast("int") - 1


def macro_move(change: Column) -> Column:
    """True of an index that moved by 3 percent or more, up or down; false without a change."""
    return F.coalesce(F.abs(change) >= 3, F.lit(False))


#: What a pattern says for a topic: it is one of its rules, it silences the text it stands in, or it bars the topic from the headline.
RULE, SILENCES, BARS = 0, 1, 2


def topic_patterns(registry: Sequence[dict]) -> tuple[list[Pattern], list[list[dict]]]:
    """The distinct patterns of a registry of topics, and for each what it says: topic (by number), kind, rule (by number) and score."""
    said: dict[Pattern, list[dict]] = {}
    for t, spec in enumerate(registry):
        for i, r in enumerate(spec["rules"]):
            pattern = Pattern(regex=r["regex"]) if r.get("regex") else Pattern(r["phrase"])
            said.setdefault(pattern, []).append({"topic": t, "kind": RULE, "rule": i, "score": int(r.get("score", 1))})
        for kind, name in ((SILENCES, "exclude"), (BARS, "headline_exclude")):
            for phrase in spec.get(name, []):
                said.setdefault(Pattern(phrase), []).append({"topic": t, "kind": kind, "rule": 0, "score": 0})
    return list(said), list(said.values())


def topic_candidates(df: DataFrame, ident: str, headline: Column, tags: Column, sentences: Column, registry: Sequence[dict]) -> DataFrame:
    """ident, topic, score, on_headline, can_anchor: the topics of each item, from a headline and arrays of publisher tags and sentences.

    ``registry`` has dicts of topic, rules (dicts of phrase or regex, and score), and at will topic_min_score (2),
    anchor_min_score, anchors, exclude and headline_exclude (phrases). A headline with a phrase of headline_exclude has
    not the topic; a text with one of exclude says nothing for it. A rule counts once for each class of evidence, twice
    its score on the headline. A topic needs its least score and a rule that holds on the headline or a tag; to anchor,
    one on the headline, an anchor and anchor_min_score, without which it never anchors. Nulls are empty.

    Each text is read once for all phrases of all topics; what an item costs beyond that goes with the patterns that it
    has, not with those of the registry.
    """
    patterns, entries = topic_patterns(registry)
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    told = F.from_json(F.lit(json.dumps(entries)), "array<array<struct<topic:int,kind:int,rule:int,score:int>>>")
    least = [{"topic": s["topic"], "least": int(s.get("topic_min_score", 2)), "anchor": s.get("anchor_min_score") if s.get("anchors") else None} for s in registry]
    specs = F.from_json(F.lit(json.dumps(least)), "array<struct<topic:string,least:int,anchor:int>>")
    texts = F.concat(F.array(F.coalesce(headline, F.lit(""))), listed(tags), listed(sentences))
    read = df.select(F.col(ident).alias("id"), F.size(listed(tags)).alias("tags"), spotted(texts, patterns).alias("found"))
    of = lambda i: F.when(i == 0, 0).when(i <= F.col("tags"), 1).otherwise(2)
    of_hit = lambda x: F.transform(F.get(told, x["n"]), lambda e: F.struct(e["topic"].alias("topic"), e["kind"].alias("kind"), e["rule"].alias("rule"), e["score"].alias("score"), x["text"].alias("text"), of(x["text"]).alias("cls")))
    evidence = read.filter(F.size("found") > 0).select("id", F.flatten(F.transform("found", of_hit)).alias("e"))

    def judged(topic: Column) -> Column:
        def over(own: Column) -> Column:
            silent = F.transform(F.filter(own, lambda x: x["kind"] == SILENCES), lambda x: x["text"])
            barred = F.exists(own, lambda x: (x["kind"] == BARS) & (x["cls"] == 0))
            points = F.array_distinct(F.transform(F.filter(own, lambda x: (x["kind"] == RULE) & ~F.array_contains(silent, x["text"])), lambda x: F.struct(x["cls"].alias("cls"), x["rule"].alias("rule"), x["score"].alias("score"))))
            return F.struct(points.alias("points"), barred.alias("barred"))

        def said(x: Column) -> Column:
            score = F.aggregate(x["points"], F.lit(0).cast("long"), lambda a, p: a + p["score"] * F.when(p["cls"] == 0, 2).otherwise(1))
            on_headline = F.exists(x["points"], lambda p: p["cls"] == 0)
            spec = F.get(specs, topic)
            fits = ~x["barred"] & (score >= spec["least"]) & F.exists(x["points"], lambda p: p["cls"] < 2)
            return F.when(fits, F.struct(spec["topic"].alias("topic"), score.alias("score"), on_headline.alias("on_headline"), F.coalesce((score >= spec["anchor"]) & on_headline, F.lit(False)).alias("can_anchor")))

        return bound(bound(F.filter("e", lambda x: x["topic"] == topic), over), said)

    topics = F.array_distinct(F.transform("e", lambda x: x["topic"]))
    found = F.filter(F.transform(topics, judged), lambda x: x.isNotNull())
    return evidence.select(F.col("id").alias(ident), F.inline(found))


def trend_matches(text: Column, taxonomy: Mapping[str, Sequence[str]]) -> Column:
    """struct<categories, keywords>: which categories have a keyword that stands in the text as a word, and which keywords, both in the taxonomy's order. Keywords may be several words; case doesn't matter; a null text has none."""
    words = list(dict.fromkeys(k for keywords in taxonomy.values() for k in keywords))
    names = F.from_json(F.lit(json.dumps(words)), "array<string>")
    categories = F.from_json(F.lit(json.dumps([[i for i, ks in enumerate(taxonomy.values()) if w in ks] for w in words])), "array<array<int>>")
    labels = F.from_json(F.lit(json.dumps(list(taxonomy))), "array<string>")
    found = spotted(F.array(text), [Pattern(w, plural=False) for w in words], "word")
    return bound(found, lambda xs: F.struct(F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform(xs, lambda x: F.get(categories, x["n"]))))), lambda c: F.get(labels, c)).alias("categories"), F.transform(xs, lambda x: F.get(names, x["n"])).alias("keywords")))


def topic_anchors(candidates: DataFrame, ident: str) -> DataFrame:
    """Of the topics of each item that can anchor, the best if it is strictly ahead; ties abstain."""
    return anchors(candidates.filter("can_anchor"), ident)
