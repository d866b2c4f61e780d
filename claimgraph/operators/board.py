"""The integrity rules of a board: items held against their spans, evidence and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.urls import canonical_url
from claimgraph.operators import state

# Methods of a label that a machine gave.
MACHINE_METHODS = ("rule", "local-model")


#: What the rules look at, beside an item's ident.
USED = ("sources", "evidence_method", "denominator_stated", "evidence_coverage", "content_hash", "evidence_hash", "topics", "anchor", "anchor_ambiguous")


def board_violations(items: DataFrame, spans: DataFrame, evidence: DataFrame, topics: Sequence[str], source_types: dict[str, int], ident: str) -> DataFrame:
    """ident, rule, detail: a row for each of the 17 rules that an item breaks; the source rules give one for each source.

    ``items``: ident, sources array<struct<url, source_type, source_tier>>, evidence_method, denominator_stated,
    evidence_coverage struct<seen, total>, content_hash, evidence_hash, topics array<string>, anchor struct<topic>,
    anchor_ambiguous. ``spans``: a row for each url with fetch, spans (array), content_hash, evidence_hash.
    ``evidence``: a row for each url with claim_tier, claim_relationship, source_tier. An item's url is the first that
    is not blank among its sources; of items of one URL identity, all but that of the smallest ident break the rule.
    Nulls are absent values; items without a url have neither spans nor evidence, and share no identity.
    """
    items = items.select(ident, *[c for c in USED if c != ident])  # no other column's name can be one of those made here
    none = F.array()
    sources = F.coalesce("sources", none.cast(items.schema["sources"].dataType))
    url = F.get(F.filter(F.transform(sources, lambda s: s["url"]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    # Items without a url get keys of their own, so that the joins don't deal them all to one task.
    alone = F.concat(F.lit("\0"), F.coalesce(F.col(ident).cast("string"), F.lit("")))
    rows = items.withColumn("its_found", url).withColumn("its_url", F.coalesce("its_found", alone)).withColumn("its_same", F.when(F.col("its_found").isNotNull(), canonical_url(F.col("its_found"))).otherwise(alone))
    first = rows.filter("its_found is not null").groupBy("its_same").agg(F.min(ident).alias("its_first"), F.count(F.lit(1)).alias("its_n")).filter("its_n > 1").select("its_same", "its_first")
    recs = spans.filter("url <> ''").select(F.col("url").alias("its_url"), F.struct("fetch", F.size(F.coalesce("spans", none.cast(spans.schema["spans"].dataType))).alias("n"), "content_hash", "evidence_hash").alias("its_rec"))
    evs = evidence.filter("url <> ''").select(F.col("url").alias("its_url"), F.struct("claim_tier", "claim_relationship", "source_tier").alias("its_ev"))
    joined = rows.join(first, "its_same", "left").join(recs, "its_url", "left").join(evs, "its_url", "left")

    tiers = F.create_map(*[F.lit(x) for pair in source_types.items() for x in pair]) if source_types else F.create_map().cast("map<string,int>")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    fault = lambda bad, rule, detail=F.lit(""): F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))

    def source(s: Column) -> Column:
        kind = F.coalesce(s["source_type"], F.lit("other"))
        due = F.try_element_at(tiers, kind)
        return F.coalesce(fault(due.isNull(), "unknown source type", kind), fault(~s["source_tier"].eqNullSafe(due), "tier mismatch", F.concat(text(s["source_tier"]), F.lit(" for "), kind)))

    rec, ev, anchor = F.col("its_rec"), F.col("its_ev"), F.col("anchor")
    fetched = F.coalesce(rec["fetch"] == "ok", F.lit(False))
    total = F.when(fetched, rec["n"]).otherwise(0)
    seen, stated = F.coalesce(F.col("evidence_coverage")["seen"], F.lit(0)), F.coalesce(F.col("evidence_coverage")["total"], F.lit(0))
    machine = F.col("evidence_method").isin(*MACHINE_METHODS)
    read = F.concat(text(seen), F.lit("/"), text(stated))
    lost = {h: blank(rec[f"{h}_hash"]) | blank(F.col(f"{h}_hash")) for h in ("content", "evidence")}
    held = F.coalesce("topics", none.cast("array<string>"))
    unknown = F.filter(held, lambda x: ~F.coalesce(x.isin(*topics), F.lit(False)))
    faults = [
        fault(F.col("its_first") != F.col(ident), "duplicate URL", F.concat(text(F.col("its_first")), F.lit(" "), F.col("its_same"))),
        fault((seen < 0) | (stated < 0) | (seen > stated), "invalid coverage", read),
        fault((F.col("denominator_stated") == "n/a") & (total > 0), "n/a with spans", text(total)),
        fault(machine & ~fetched, "label without article"),
        fault(machine & ((seen != total) | (stated != total)), "partial coverage", F.concat(read, F.lit(" of "), text(total))),
    ]
    for h, missing in lost.items():
        faults += [fault(machine & missing, f"missing {h} hash"), fault(machine & ~missing & (rec[f"{h}_hash"] != F.col(f"{h}_hash")), f"stale {h} hash")]
    faults += [
        fault((F.col("evidence_method") == "unassessed") & (seen != 0), "unassessed with spans read", text(seen)),
        fault(F.size(unknown) > 0, "unknown topics", F.array_join(unknown, ", ", "none")),
        fault(anchor.isNotNull() & F.col("anchor_ambiguous"), "ambiguous anchor"),
        fault(anchor.isNotNull() & ~F.coalesce(F.exists(held, lambda x: x == anchor["topic"]), F.lit(False)), "anchor not in topics", text(anchor["topic"])),
        fault(ev["claim_tier"].isNotNull() & (F.coalesce(ev["claim_relationship"], F.lit("unresolved")) == "unresolved"), "unresolved claim tier", text(ev["claim_tier"])),
        fault((F.size(sources) > 0) & ev.isNotNull() & (F.coalesce(ev["source_tier"], F.lit(-1)) != F.coalesce(F.get(sources, F.lit(0))["source_tier"], F.lit(-2))), "stale evidence tier", text(ev["source_tier"])),
    ]
    broken = F.filter(F.concat(F.transform(sources, source), F.array(*faults)), lambda x: x.isNotNull())
    return joined.select(ident, F.inline(broken))


def publishable(items: DataFrame, spans: DataFrame, evidence: DataFrame, topics: Sequence[str], source_types: dict[str, int], ident: str) -> DataFrame:
    """``items`` as they are, if they break no rule; else raises."""
    state.require_clean(board_violations(items, spans, evidence, topics, source_types, ident))
    return items
