"""Briefings: items ordered in their sections, a place for a publisher, highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = {"official": 3, "first_party": 3, "reporting": 1, "discovery": 0}
IMPACTS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SECTION, HIGHLIGHTS = 6, 5


def _rank(value: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, n in table.items():
        out = F.when(value == name, n).otherwise(out)
    return out


def ranked(items: DataFrame) -> DataFrame:
    """items(item_id, section, impact, tier, curated, age_minutes, heat) with impact_rank, class and the place in their section."""
    tier, fresh = _rank(F.col("tier"), TIERS), F.col("age_minutes") <= 90
    kind = F.when(fresh & (tier >= 1), 0).when(F.col("curated") & (F.col("age_minutes") <= 1440), 1).when(tier >= 1, 2).when(fresh, 3).otherwise(4)
    order = [F.desc("impact_rank"), F.asc("kind"), F.desc("tier_rank"), F.desc("heat"), F.asc("age_minutes"), F.asc("item_id")]
    r = items.withColumns({"impact_rank": _rank(F.col("impact"), IMPACTS), "tier_rank": tier, "kind": kind})
    return r.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order)))


def sections(items: DataFrame, most: int = SECTION) -> DataFrame:
    """The first items of each section. If none of them is a publisher's, the section's best publisher item takes the place of the last one that is neither of high impact nor official."""
    r = ranked(items)
    best = r.where("tier = 'reporting'").groupBy("section").agg(F.min("place").alias("best_publisher"))
    top = r.where(F.col("place") <= most).groupBy("section").agg(F.bool_or(F.col("tier") == "reporting").alias("has"), F.max(F.when((F.col("impact_rank") < 3) & (F.col("tier_rank") < 3), F.col("place"))).alias("weak"))
    swap = top.join(best, "section", "left").withColumn("swaps", ~F.col("has") & F.col("weak").isNotNull() & F.col("best_publisher").isNotNull())
    j = r.join(swap, "section")
    keeps = (F.col("place") <= most) & ~(F.col("swaps") & (F.col("place") == F.col("weak")))
    enters = F.col("swaps") & (F.col("place") == F.col("best_publisher"))
    return j.where(keeps | enters).select("section", "item_id", F.when(enters, F.col("weak")).otherwise(F.col("place")).alias("place"))


def highlights(items: DataFrame, most: int = HIGHLIGHTS) -> DataFrame:
    """Critical items first, then the first of each section without one, then the rest: (item_id, section, tier_of_choice)."""
    r = ranked(items).withColumn("_major", F.max((F.col("impact") == "critical").cast("int")).over(Window.partitionBy("section")))
    choice = F.when(F.col("impact") == "critical", 0).when((F.col("_major") == 0) & (F.col("place") == 1), 1).otherwise(2)
    order = ["choice", F.desc("impact_rank"), "kind", F.desc("heat"), "item_id"]
    return r.withColumn("choice", choice).orderBy(*order).limit(most).select("item_id", "section", "choice")
