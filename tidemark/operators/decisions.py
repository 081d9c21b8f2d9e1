"""Decision cards: edges from topics to assets aggregated, checked against the market, ordered and selected."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rounding import nearest

#: Oldest age in hours of an event edge, by horizon; samples that make a window complete; the window a horizon asks for.
MAX_AGE = {"intraday": 72, "short": 72, "medium": 168, "unknown": 168, "long": 336, "mixed": 336}
SAMPLES = {"1D": 2, "3D": 4, "5D": 6}
REQUIRED = {"short": "1D", "intraday": "1D", "medium": "3D", "unknown": "3D", "long": "5D", "mixed": "5D"}
CONFIRMED_SCORE = {"1D": 0.55, "3D": 0.80, "5D": 1.0}


def _by(column: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def mean4(value: Column) -> Column:
    """Mean of ten-thousandths, to four places: whole numbers are summed, so the order of the rows doesn't matter at a tie."""
    return nearest(F.sum(F.round(value * 10_000).cast("long")) / (F.count(value) * F.lit(10_000.0)), 4)


def eligible(edges: DataFrame, now: Column) -> DataFrame:
    """Macro edges always; event edges of an age from 0 to the most for their horizon. Adds age_days."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("event_ts").cast("timestamp"))) / 86_400e6
    ok = (F.col("source_type") != "event") | ((age >= 0) & (age * 24 <= _by(F.col("horizon"), MAX_AGE, 168)))
    return edges.withColumn("age_days", age).where(ok)


def classification(positive: Column, negative: Column) -> Column:
    return F.when(positive & ~negative, "opportunity").when(negative & ~positive, "risk").otherwise("conflict")


def dominant(edges: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group, `mixed` at a tie."""
    counts = edges.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.max("_n").alias("_most"), F.max_by(value, "_n").alias("_value"), F.collect_list("_n").alias("_all"))
    tie = F.size(F.filter("_all", lambda n: n == F.col("_most"))) > 1
    return best.select(*keys, F.when(tie, "mixed").otherwise(F.col("_value")).alias(name))


def market_validation(edges: DataFrame, reactions: DataFrame, keys: tuple[str, str] = ("topic", "asset")) -> DataFrame:
    """(topic, asset) -> verdict of the reactions to the agreeing event edges: phase, veto, abstain, confirmed, market_score.

    edges need horizon (of the group) and direction; reactions(source_id, asset, window, status, sample_count, direction).
    """
    t, a = keys
    groups = edges.groupBy(t, a).agg(
        F.bool_or(F.col("direction") == "positive").alias("pos"), F.bool_or(F.col("direction") == "negative").alias("neg"), F.bool_or(F.col("source_type") == "event").alias("has_event"),
        F.first("group_horizon").alias("horizon"),
    )
    kind = classification(F.col("pos"), F.col("neg"))
    groups = groups.withColumn("expected", F.when(kind == "opportunity", "up").when(kind == "risk", "down")).withColumn("required", _by(F.col("horizon"), REQUIRED, "3D"))
    way = F.when(F.col("direction") == "positive", "up").when(F.col("direction") == "negative", "down")
    agreeing = edges.where("source_type = 'event'").withColumn("_way", way).join(groups.select(t, a, "expected", "required"), [t, a]).where(F.col("_way") == F.col("expected"))
    # Only whether there are such rows counts, so edges of one source meet the reactions once.
    agreeing = agreeing.select(t, a, "expected", "required", "source_id").distinct()
    matched = agreeing.select(t, a, "expected", "required", "source_id").join(reactions.withColumnRenamed("direction", "observed"), ["source_id", a])
    complete = (F.col("status") == "complete") & (F.col("sample_count") >= _by(F.col("window"), SAMPLES, 99))
    agrees = F.when(F.col("observed").isin("up", "down"), F.col("observed") == F.col("expected"))
    windows = matched.withColumn("_complete", complete).withColumn("_ok", F.when(complete, agrees)).groupBy(t, a, "window", "required").agg(
        F.bool_or(F.coalesce(F.col("_ok") == F.lit(False), F.lit(False))).alias("contrary"), F.bool_or(F.col("_complete") & F.col("_ok").isNull()).alias("unclear"),
        F.bool_and(F.coalesce("_ok", F.lit(False))).alias("confirms"), F.bool_and(F.col("_complete")).alias("complete"),
        F.bool_or((F.col("status") == "unavailable") & (F.col("window") <= F.col("required"))).alias("lost"), F.bool_or(F.col("status") == "pending").alias("pending"),
    )
    verdict = windows.groupBy(t, a).agg(
        F.bool_or("contrary").alias("contrary"), F.bool_or("unclear").alias("unclear"), F.bool_or("lost").alias("lost"), F.max(F.when(F.col("confirms"), F.col("window"))).alias("confirmed"),
        F.bool_or((F.col("window") == F.col("required")) & F.col("complete")).alias("required_done"), F.bool_and("pending").alias("all_pending"),
    )
    j = groups.join(verdict, [t, a], "left").join(agreeing.select(t, a).distinct().withColumn("_agrees", F.lit(True)), [t, a], "left")
    no_direction = F.col("expected").isNull() | F.col("_agrees").isNull()
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    veto = ~F.col("has_event") | no_direction | yes("contrary") | yes("unclear") | yes("lost")
    phase = (
        F.when(~F.col("has_event"), "no_event_anchor").when(no_direction, "direction_unavailable").when(yes("contrary"), "contrary").when(yes("unclear"), "inconclusive")
        .when(F.col("confirmed").isNotNull(), F.concat(F.lit("confirmed_"), F.lower("confirmed"))).when(yes("all_pending"), "awaiting_1d").otherwise("unavailable")
    )
    return j.select(
        t, a, phase.alias("phase"), veto.alias("veto"), (veto | F.col("confirmed").isNull() | ~yes("required_done")).alias("abstain"), yes("required_done").alias("required_done"),
        F.when(~veto, _by(F.col("confirmed"), CONFIRMED_SCORE, 0.0)).otherwise(F.lit(0.0)).alias("market_score"),
    )


def decision_cards(edges: DataFrame, reactions: DataFrame, now: Column, coverage: float) -> DataFrame:
    """Edges(edge_id, source_type, source_id, topic, asset, direction, strength, confidence, horizon, event_ts) -> a card for each topic and asset."""
    keys = ["topic", "asset"]
    kept = eligible(edges, now)
    kept = kept.join(dominant(kept, keys, "horizon", "group_horizon"), keys)
    sure = F.col("confidence") * F.when(F.col("source_type") == "event", 1.0).otherwise(0.5 + 0.5 * coverage)
    cards = kept.groupBy(*keys).agg(
        F.bool_or(F.col("direction") == "positive").alias("pos"), F.bool_or(F.col("direction") == "negative").alias("neg"), F.first("group_horizon").alias("horizon"), F.count("*").alias("edges"),
        mean4(F.col("strength")).alias("c_strength"), mean4(sure).alias("c_confidence"), mean4(rules.freshness(F.col("age_days"))).alias("c_freshness"),
        F.round(rules.corroboration(F.count_distinct("source_type", "source_id")), 4).alias("c_corroboration"),
    )
    checked = cards.join(market_validation(kept, reactions), keys).withColumn("classification", classification(F.col("pos"), F.col("neg")))
    w = rules.WEIGHTS
    total = sum((F.col(f"c_{k}") * w[k] for k in ("strength", "confidence", "freshness", "corroboration")), F.lit(0.0)) + F.col("market_score") * w["market"] + F.lit(round(coverage, 4)) * w["coverage"]
    scored = checked.withColumn("score", nearest(total, 4))
    ready = ~F.col("abstain") & ~F.col("veto") & F.col("required_done")
    stage = F.when((F.col("classification") != "conflict") & ready & (F.col("score") >= 0.70), F.when(F.col("classification") == "opportunity", "scale_in").otherwise("reduce_or_hedge")).when(F.col("score") >= 0.45, "verify").otherwise("observe")
    return scored.withColumn("stage", stage).drop("pos", "neg")


def card_order_keys() -> list[Column]:
    """Stage, whether the market bears it out, score, topic, asset."""
    stage = F.when(F.col("stage").isin("scale_in", "reduce_or_hedge"), 0).when(F.col("stage") == "verify", 1).otherwise(2)
    market = F.when(~F.col("abstain"), 0).when(~F.col("veto"), 1).otherwise(2)
    return [stage, market, F.col("score"), F.col("topic"), F.col("asset")]


def card_order() -> list[Column]:
    stage, market, score, topic, asset = card_order_keys()
    return [stage.asc(), market.asc(), score.desc(), topic.asc(), asset.asc()]


def _order_values() -> list[Column]:
    """card_order as values that all ascend."""
    stage, market, score, topic, asset = card_order_keys()
    return [stage, market, -score, topic, asset]


def overview(cards: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return cards.agg(
        F.count("*").alias("total"), n(F.col("classification") == "opportunity").alias("opportunities"), n(F.col("classification") == "risk").alias("risks"), n(F.col("classification") == "conflict").alias("conflicts"),
        n(F.col("stage").isin("scale_in", "reduce_or_hedge")).alias("candidates"), n(F.col("stage") == "verify").alias("to_verify"), n("veto").alias("vetoed"), n(~F.col("abstain")).alias("confirmed"),
    )


def impact_matrix(cards: DataFrame, assets: list[str]) -> DataFrame:
    """A row for each topic, a column for each asset, the score or null."""
    return cards.groupBy("topic").pivot("asset", assets).agg(F.first("score"))


def select_summary(cards: DataFrame, k: int = 12) -> DataFrame:
    """k cards: the two first, then in order those within the quotas of their topic and asset, then the first of the rest, in order again.

    The choice of each depends on those before it, but only some can be chosen: a full topic or asset stays full, and at most k cards fill any, so the first cards of
    each topic with each asset, of each topic, of each asset and of all, in numbers that follow from k, hold every choice. They are limited before each shuffle
    and go through one fold, an array in one task (15,500 cards for k = 50), not through the driver. Cards of equal order and content are as good as one another.
    """
    topic_quota, asset_quota = max(2, math.ceil(k / 4)), max(1, math.ceil(k / 6))
    full_topics, full_assets = k // topic_quota, k // asset_quota
    of_topic, of_asset = 2 * k * (full_assets + topic_quota), 2 * k * (full_topics + asset_quota)
    rows = cards.withColumns({f"_o{i}": key for i, key in enumerate(_order_values())}).withColumn("_card", F.struct(*cards.columns))
    order = [F.asc(f"_o{i}") for i in range(5)]
    for by, most in ((["topic", "asset"], 2 * k), (["topic"], of_topic), (["asset"], of_asset)):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    first = rows.orderBy(*order).limit(2 * k + full_topics * of_topic + full_assets * of_asset)
    keyed = F.struct(*[f"_o{i}" for i in range(5)], "topic", "asset", "_card")
    listed = first.groupBy().agg(F.array_sort(F.collect_list(keyed)).alias("all"))
    places = "array<struct<place: int, topic: string, asset: string>>"
    cards_in_order = F.transform("all", lambda x, i: F.struct(i.alias("place"), x["topic"].cast("string").alias("topic"), x["asset"].cast("string").alias("asset")))

    def within(chosen: Column, card: Column, name: str, quota: int) -> Column:
        return F.size(F.filter(chosen, lambda c: c[name].eqNullSafe(card[name]))) < quota

    def take(chosen: Column, card: Column) -> Column:
        fits = (card["place"] < 2) | (within(chosen, card, "topic", topic_quota) & within(chosen, card, "asset", asset_quota))
        return F.when((F.size(chosen) < k) & fits, F.concat(chosen, F.array(card))).otherwise(chosen)

    chosen = listed.select("all", F.transform(F.aggregate(cards_in_order, F.array().cast(places), take), lambda c: c["place"]).alias("chosen"))
    others = F.filter(F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0))), lambda i: ~F.array_contains("chosen", i) & (i < F.size("all")))
    filled = F.array_sort(F.concat("chosen", F.slice(others, F.lit(1), F.lit(k) - F.size("chosen"))))
    return chosen.select("all", F.explode(filled).alias("i")).select(F.get("all", F.col("i"))["_card"].alias("c")).select("c.*")
