"""Clusters of briefing items: records of one story joined where identity and content agree, and one of them put before the others.

Two records are joined by a common external id, canonical url or model cluster, but only if they are also of one day and say the same (the same claim, or
without one the same title): these are parts of the key, so components of keys join nothing that differs in them. Then clusters whose representative
makes the same sure claim are joined by it, by equality alone, so no title links two stories over a third.

The representative is the record of the best source tier, then impact, then latest publication; where records are revisions of one document, that of
the best tier and evidence, then the latest. Impact is the strongest of the cluster, except that a revision keeps its own unless that is unknown.

Defined cases: records without any key stay alone; nulls are empty; equal records are one cluster only if they share a key; item ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import claims
from .stories import alias_classes

#: Ranks, the greater the better. Fixed values.
IMPACTS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "none": 0, "unknown": 0}
TIERS = {"official": 3, "first_party": 3, "reporting": 1, "discovery": 0}
EVIDENCE = {"official_body": 3, "indicator_data": 3, "post_text": 3, "title_and_snippet": 2, "title": 1, "title_only": 1}
_SPLIT = "\u001f"


def rank(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, n in ranks.items():
        out = F.when(F.lower(value) == name, n).otherwise(out)
    return out


def _key(*parts: Column) -> Column:
    """Parts joined, null if one is null or empty."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & (F.coalesce(p, F.lit("")) != "")
    return F.when(whole, F.concat_ws(_SPLIT, *parts))


def keyed(items: DataFrame) -> DataFrame:
    """items(item_id, title, published_at, external_id, canonical_url, cluster_key, person, assets, tier, evidence, impact, observed_at) with claim, compatible, day and the three keys.

    published_at is a verified publication or null.
    """
    rows = items.withColumn("_text", claims.plain(F.col("title")))
    rows = rows.withColumn("claim", claims.signature(F.col("_text"), F.col("published_at"), F.col("assets"), F.col("person"))).withColumn("day", claims.day(F.col("published_at")))
    named = claims.briefing_title(F.col("_text"))
    compatible = F.when(F.col("claim").isNotNull(), F.concat_ws(_SPLIT, F.lit("semantic"), F.slice("claim", 2, 3))).otherwise(F.concat(F.lit("title" + _SPLIT), F.nullif(named, F.lit(""))))
    rows = rows.withColumns({"compatible": compatible, "named": named}).drop("_text")
    return rows.withColumns({
        "stable": _key(F.col("external_id"), F.col("day"), F.col("compatible")), "located": _key(F.col("canonical_url"), F.col("day"), F.col("compatible")),
        "model": F.when((F.coalesce("cluster_key", F.lit("")) != "") & F.col("claim").isNotNull(), F.concat_ws(_SPLIT, "cluster_key", "claim")),
    })


_BASE = ("item_id", "title", "claim", "day", "compatible", "impact", "tier", "evidence")


def _story(first: Column, stable: Column, url: Column, model: Column, named: Column, days: Column) -> Column:
    """The name of a cluster by its least external id, else url, else model cluster, else title."""
    compatible = F.coalesce(first["compatible"], F.lit(""))
    identity = (
        F.when(stable.isNotNull(), F.concat_ws(_SPLIT, F.lit("stable"), stable, F.coalesce(first["day"], F.lit("")), compatible))
        .when(url.isNotNull(), F.concat_ws(_SPLIT, F.lit("url"), url, F.coalesce(days, F.lit("")), compatible))
        .when(model.isNotNull(), F.concat_ws(_SPLIT, F.lit("cluster"), model)).otherwise(F.concat_ws(_SPLIT, F.lit("title"), F.coalesce(named, F.lit("unknown"))))
    )
    return F.concat(F.lit("story_"), F.left(F.sha2(identity, 256), F.lit(24)))


def _merged(rows: DataFrame, by: list[str], revisions: bool) -> DataFrame:
    """One row of each group. First within a group's records of equal trust, then over these, so that what is asked of the representative's peers is at hand."""
    t, e, i = F.col("_tier"), F.col("_evidence"), F.col("_impact")
    late = -F.coalesce(F.unix_micros("published_at"), F.lit(-1 << 62))
    primary = F.struct(-t, -i, late.alias("late"), F.coalesce("canonical_url", F.lit("")).alias("url"), F.col("item_id").alias("id"))
    revised = F.struct(-t, -e, late.alias("late"), (-F.coalesce(F.unix_micros("observed_at"), F.lit(-1 << 62))).alias("seen"), -i, F.col("item_id").alias("id"))
    base = F.struct(*_BASE)
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    peers = rows.groupBy(*by, "_tier", "_evidence").agg(
        F.min(F.struct(primary.alias("rank"), base.alias("base"))).alias("primary"), F.min(F.struct(revised.alias("rank"), base.alias("base"))).alias("revised"), F.max("observed_at").alias("observed"),
        F.max(F.struct(i.alias("rank"), F.col("impact").alias("impact"))).alias("strong"), F.sum("members").alias("members"), F.collect_set("canonical_url").alias("urls"), F.min(F.struct("item_id", "day", "compatible")).alias("first"),
        F.min(blank("external_id")).alias("s"), F.min(blank("canonical_url")).alias("u"), F.min(blank("cluster_key")).alias("m"), F.min(blank("named")).alias("n"), F.min("day").alias("days"), F.count("*").alias("size"),
        F.count("stable").alias("s_all"), F.collect_set("stable").alias("s_set"), F.count("located").alias("l_all"), F.collect_set("located").alias("l_set"),
    )
    own = F.struct("observed", "strong")
    united = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    groups = peers.groupBy(*by).agg(
        F.min(F.struct("primary", own.alias("own"))).alias("p"), F.min(F.struct("revised", own.alias("own"))).alias("r"), F.max("strong").alias("strong"), F.sum("members").alias("members"), F.size(united("urls")).alias("urls"),
        F.min("first").alias("first"), F.min("s").alias("s"), F.min("u").alias("u"), F.min("m").alias("m"), F.min("n").alias("n"), F.min("days").alias("days"), F.sum("size").alias("size"),
        (F.sum("s_all") > F.size(united("s_set"))).alias("same_id"), (F.sum("l_all") > F.size(united("l_set"))).alias("same_url"),
    )
    revising = (F.col("same_id") | F.col("same_url")) if revisions else F.lit(False)
    chosen = F.when(revising, F.col("r.revised.base")).otherwise(F.col("p.primary.base"))
    peer = F.when(revising, F.col("r.own")).otherwise(F.col("p.own"))
    unknown = F.coalesce(F.lower(chosen["impact"]), F.lit("unknown")) == "unknown"
    impact = F.when(~revising, F.col("strong.impact")).when(unknown, peer["strong"]["impact"]).otherwise(chosen["impact"])
    return groups.select(
        *by, chosen.alias("base"), impact.alias("impact"), peer["observed"].alias("observed_at"), F.col("members"), F.greatest("urls", F.col("size").cast("int")).alias("source_count"),
        _story(F.col("first"), F.col("s"), F.col("u"), F.col("m"), F.col("n"), F.col("days")).alias("story_key"), F.col("first.item_id").alias("first_id"), "s", "u", "m", "n",
    )


def cluster(items: DataFrame) -> DataFrame:
    """keyed's items -> (story_key, base_id, title, impact, members, source_count, observed_at, claim) of each story."""
    rows = keyed(items).withColumns({"_tier": rank(F.col("tier"), TIERS), "_evidence": rank(F.col("evidence"), EVIDENCE), "_impact": rank(F.col("impact"), IMPACTS), "members": F.lit(1).cast("bigint")})
    keys = F.array(*[F.concat(F.lit(c[0] + _SPLIT), F.col(c)) for c in ("stable", "located", "model")])
    aliases = rows.select("item_id", F.explode_outer(F.array_compact(keys)).alias("alias"))
    classes = alias_classes(aliases.select("item_id", F.sha2("alias", 256).alias("alias")))
    exact = _merged(rows.join(classes, "item_id"), ["class_id"], True)
    back = exact.join(rows.select(F.col("item_id").alias("_of"), "published_at", "canonical_url", "external_id", "cluster_key", "named"), F.col("base.item_id") == F.col("_of"))
    again = back.select(
        F.col("base.item_id").alias("item_id"), "base.title", "base.claim", "base.day", "base.compatible", "base.tier", "base.evidence", "impact", "published_at", "canonical_url", "external_id", "cluster_key", "named", "observed_at", "members",
        F.lit(None).cast("string").alias("stable"), F.lit(None).cast("string").alias("located"), F.coalesce(F.array_join("base.claim", _SPLIT), F.concat(F.lit("class" + _SPLIT), F.col("class_id").cast("string"))).alias("_by"),
        "source_count", "story_key",
    ).withColumns({"_tier": rank(F.col("tier"), TIERS), "_evidence": rank(F.col("evidence"), EVIDENCE), "_impact": rank(F.col("impact"), IMPACTS)})
    counts = again.groupBy("_by").agg(F.max("source_count").alias("reported"), F.count("*").alias("clusters"), F.first("story_key").alias("own_key"))
    final = _merged(again.drop("source_count", "story_key"), ["_by"], False).join(counts, "_by")
    alone = F.col("clusters") == 1
    return final.select(
        F.when(alone, F.col("own_key")).otherwise(F.col("story_key")).alias("story_key"), F.col("base.item_id").alias("base_id"), F.col("base.title").alias("title"), "impact", "members",
        F.greatest("source_count", "reported").alias("source_count"), "observed_at", F.array_join("base.claim", "|").alias("claim"),
    )
